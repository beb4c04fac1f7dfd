"""Entity resolution: block, score, cluster, un-merge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.functions.scalars import jaro_winkler_column
from factloom.operators.components import connected_components


@dataclass(frozen=True)
class Config:
    """Weights and tolerances; each comparator gives its weight or its penalty."""

    id_agrees: float = 8.0
    near: float = 3.2
    far: float = -4.0
    metres: float = 100_000.0
    same_time: float = 3.0
    other_time: float = -5.0
    seconds: float = 90.0
    same_magnitude: float = 1.1
    other_magnitude: float = -0.8
    magnitude: float = 0.7
    same_name: float = 0.7
    other_name: float = -0.1
    name: float = 0.75
    threshold: float = 5.0
    cell_bits: int = 40
    bucket_seconds: int = 600
    largest_block: int = 200


def records(facts: DataFrame, geo_attr: str, scalar_attr: str) -> DataFrame:
    """One record per entity with a position now: its first position, and its last numeric scalar."""
    latest = C.visible(C.TIME_MAX - 1, C.OPEN_SYSTEM - 1)
    rows = facts.where(latest & F.col("attr").isin(geo_attr, scalar_attr))
    is_geo = (F.col("attr") == geo_attr) & (F.col("kind") == C.GEO)
    place = F.struct("v_lat_e7", "v_lon_e7", "source", "valid_from", "morton")
    value = F.when((F.col("attr") == scalar_attr) & F.col("kind").isin(C.F64, C.I64), C.number())
    per = rows.groupBy("entity").agg(
        F.min_by(F.when(is_geo, place), F.when(is_geo, F.col("fact_id"))).alias("p"),
        F.max_by(value, F.when(value.isNotNull(), F.col("fact_id"))).alias("magnitude"),
    )
    return per.where("p IS NOT NULL").select(
        F.col("entity").alias("id"), "p.source", (F.col("p.v_lat_e7") / 1e7).alias("lat"), (F.col("p.v_lon_e7") / 1e7).alias("lon"),
        F.col("p.valid_from").alias("time"), "magnitude", F.col("p.morton").alias("morton"), F.lit(None).cast("string").alias("external_id"), F.lit(None).cast("string").alias("label"),
    )


def block_keys(recs: DataFrame, config: Config = Config()) -> DataFrame:
    """``(family, key, ...)`` rows: a record's Z-order cell and its time bucket (division truncates toward zero)."""
    keys = F.array(
        F.struct(F.lit("cell").alias("family"), F.shiftright("morton", config.cell_bits).alias("key")),
        F.struct(F.lit("time").alias("family"), F.expr(f"time div {config.bucket_seconds}").cast("long").alias("key")),
    )
    return recs.withColumn("k", F.explode(keys)).select("k.family", "k.key", "id", "source")


def candidate_pairs(recs: DataFrame, config: Config = Config()) -> DataFrame:
    """Distinct ``(a, b)`` of different sources that share a block of at most ``largest_block`` records.

    The block bound is the operator's own rule: larger blocks are skipped and counted, and it
    keeps each block's pairs bounded.
    """
    keys = block_keys(recs, config)
    fine = keys.groupBy("family", "key").agg(F.count("*").alias("n")).where(F.col("n").between(2, config.largest_block)).drop("n")
    kept = keys.join(fine, ["family", "key"])
    left = kept.select("family", "key", F.col("id").alias("a"), F.col("source").alias("source_a"))
    right = kept.select("family", "key", F.col("id").alias("b"), F.col("source").alias("source_b"))
    met = left.join(right, ["family", "key"]).where("a < b AND source_a <> source_b")
    return met.select("a", "b").distinct()


def _decay(agrees: Column, gap: Column, tolerance: float, weight: float, penalty: float) -> Column:
    close = F.lit(1.0) - F.least(gap / tolerance, F.lit(1.0))
    return F.when(agrees, (close * 0.6 + 0.4) * weight).otherwise(F.lit(penalty))


def score(pairs: DataFrame, recs: DataFrame, config: Config = Config(), names: bool = False) -> DataFrame:
    """Pairs with their evidence by comparator, the score as its sum, and whether it reaches the threshold."""
    a = recs.select([F.col(c).alias(f"{c}_a") for c in recs.columns])
    b = recs.select([F.col(c).alias(f"{c}_b") for c in recs.columns])
    both = pairs.join(a, F.col("a") == F.col("id_a")).join(b, F.col("b") == F.col("id_b"))
    metres = C.haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    seconds = F.abs(F.col("time_a").cast("double") - F.col("time_b").cast("double"))
    both = both.withColumns({"metres": metres, "seconds": seconds, "magnitudes": F.abs(F.col("magnitude_a") - F.col("magnitude_b"))})
    if names:  # few names make many pairs: each two are compared once
        told = both.select("label_a", "label_b").where("label_a IS NOT NULL AND label_b IS NOT NULL").distinct()
        told = told.withColumn("names", jaro_winkler_column("label_a", "label_b"))
        both = both.join(told, ["label_a", "label_b"], "left")
    else:
        both = both.withColumn("names", F.lit(None).cast("double"))

    def row(name: str, present: Column, agrees: Column, weight: Column, left: Column, right: Column) -> Column:
        made = F.struct(F.lit(name).alias("comparator"), left.alias("a_value"), right.alias("b_value"), weight.alias("contribution"), agrees.alias("agree"))
        return F.when(present, made)

    near, soon = F.col("metres") <= config.metres, F.col("seconds") <= config.seconds
    alike = F.col("magnitudes") <= config.magnitude
    named = F.col("names") >= config.name
    both_named = (F.length("label_a") > 0) & (F.length("label_b") > 0) & F.col("names").isNotNull()
    evidence = F.filter(
        F.array(
            row("external_id", F.col("external_id_a") == F.col("external_id_b"), F.lit(True), F.lit(config.id_agrees), F.col("external_id_a"), F.col("external_id_b")),
            row("geo_distance", F.lit(True), near, _decay(near, F.col("metres"), config.metres, config.near, config.far),
                F.format_string("%.1f km apart", F.col("metres") / 1000), F.lit(f"tolerance {config.metres / 1000:.0f} km")),
            row("time_delta", F.lit(True), soon, _decay(soon, F.col("seconds"), config.seconds, config.same_time, config.other_time),
                F.format_string("%.0f s apart", "seconds"), F.lit(f"tolerance {config.seconds:.0f} s")),
            row("magnitude_delta", F.col("magnitudes").isNotNull(), alike, F.when(alike, config.same_magnitude).otherwise(config.other_magnitude),
                F.format_string("%.1f", "magnitude_a"), F.format_string("%.1f", "magnitude_b")),
            row("name_similarity", both_named, named, F.when(named, F.col("names") * config.same_name).otherwise(config.other_name), F.col("label_a"), F.col("label_b")),
        ),
        lambda e: e.isNotNull(),
    )
    scored = both.select("a", "b", evidence.alias("evidence"))
    total = F.aggregate("evidence", F.lit(0.0), lambda s, e: s + e["contribution"])
    return scored.withColumn("score", total).withColumn("accepted", F.col("score") >= config.threshold)


def clusters(recs: DataFrame, accepted: DataFrame) -> DataFrame:
    """``(id, root, cluster_id)``: closure of the accepted pairs; cluster ids are dense by least member."""
    found = connected_components(accepted.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rooted = recs.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("root"))
    from factloom.operators.store import dense_ids

    ranked = dense_ids(rooted.select("root").distinct().withColumn("at", F.col("root")), "root", "at")
    return rooted.join(ranked.select("root", F.col("entity_id").alias("cluster_id")), "root").select("id", "root", "cluster_id")


def unmerge(accepted: DataFrame, position: int) -> DataFrame:
    """Accepted pairs, in order of ``(a, b)``, without the one at ``position``; out of range changes nothing."""
    if position < 0:
        return accepted
    one = accepted.select(F.col("a").alias("x"), F.col("b").alias("y")).orderBy("x", "y").offset(position).limit(1)
    return unmerge_pair(accepted, one)


def unmerge_pair(accepted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Accepted pairs without those in ``pairs(x, y)``."""
    return accepted.join(pairs, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti")


def stats(recs: DataFrame, scored: DataFrame, found: DataFrame, config: Config = Config()) -> DataFrame:
    """One row: records, blocks, blocks skipped, pairs compared and accepted, clusters, merged records."""
    sizes = block_keys(recs, config).groupBy("family", "key").agg(F.count("*").alias("n"))
    blocks = sizes.agg(F.count("*").alias("blocks"), F.count_if(F.col("n") > config.largest_block).alias("blocks_skipped"))
    pairs = scored.agg(F.count("*").alias("pairs_compared"), F.count_if("accepted").alias("pairs_accepted"))
    groups = found.groupBy("root").agg(F.count("*").alias("n"))
    grouped = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("clusters"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("merged_records"))
    return blocks.crossJoin(pairs).crossJoin(grouped)


def evidence_json(scored: DataFrame, limit: int = 25) -> DataFrame:
    """The first accepted pairs as JSON documents."""
    kept = scored.where("accepted").orderBy("a", "b").limit(limit)
    return kept.select("a", "b", F.to_json(F.struct("a", "b", "score", "evidence")).alias("json"))
