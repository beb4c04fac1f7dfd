"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import chat, decontaminate, fingerprint, language, licences, mixing, pii, sharding, simhash, substrings
from factloom.runtime import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~held))
    return language.predict(docs.select("doc_id", held.alias("held_out"), "text"), model)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "first_word", "n_shingles").distinct()


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    columns = ["doc_id", sharding.byte_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    placed = sharding.shard(table(spark, sf_dir, "documents"), 40, keep=columns)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", simhash.hex_word("fp").alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(table(spark, sf_dir, "documents"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_suffix_dedup,
            op2_language_id,
            op3_decontamination,
            op4_sharding,
            op5_chat_formatting,
            op6_simhash_dedup,
            op7_pii,
            op8_mixing,
            op9_fingerprints,
            op10_licence_scan,
        )
    }


def oracle_sql() -> dict[str, str]:
    """The other operators are held against brute force in ``tests/llm``."""
    return {"op3_decontamination": decontaminate.ORACLE_SQL, "op5_chat_formatting": chat.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL, "op10_licence_scan": licences.oracle_sql()}
