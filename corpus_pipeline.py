"""A corpus pipeline: language, near-duplicates, benchmark leaks, source mix, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, language, mixing, sharding, simhash
from factloom.runtime import ensure_checkpoint_dir, remove, table

SHARDS = 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language that the model can tell go.

    The model is fitted on the labelled rows of ``docs`` (``language.fit``). Null texts and
    texts without letters go, as do all rows where no row has a label; ties go to the first
    language, which keeps the row; repeated rows are kept or go together; very long texts are
    read whole.
    """
    return language.keep(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the least id's, null ids last.

    Texts are linked at a Jaccard similarity of 0.8 of their five-word shingles. Null and blank
    texts are one class, equal rows one row; of rows with equal ids and similar texts one
    stays; very long texts are compared whole.
    """
    return simhash.keep_one(docs, words=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an item of the benchmark go.

    Null and wordless texts stay; repeated rows stay or go together; an empty benchmark drops
    nothing; a document of any length is searched whole.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, as so many equal rows.

    Null sources form one source; null and blank texts have no words and are taken with their
    source's whole epochs; rows with equal id and text are taken together.
    """
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*docs.columns)


def make_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in shuffled order over the shards, with ``shard`` and ``slot``.

    Null ids and texts are rows like any other; repeated rows are spread like others.
    """
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", make_shards),
]

#: The first three stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")  # nothing reads it any more
    return docs
