"""Mixing sources to target weights by nested hash-threshold histograms.

Targets share the mix by source weight; no source gives more than ``most`` times its own
size, and what it can't give is shared among the others (water filling). A source gives
whole epochs of all its documents and, for the rest of its target, the documents whose
hash lies under a threshold. The threshold comes from token sums by hash bucket: only the
bucket where the running sum passes the budget is split further, so nothing is sorted and
no row leaves its task for it.

Edge cases: a null or blank text has size 0; null sources form one source, last in order;
sources of size 0 have target 0 and their documents count as taken with the whole epochs
(0 words either way); rows with equal id and text share a hash and are taken together; an
empty table gives an empty result; columns named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.runtime import cut_lineage

#: Hash bits, and the bits that each histogram adds.
HASH_BITS = 32
LEVELS = (12, 10, 10)
#: The table of sources is broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_SOURCES = 100_000
ADDED = ("size", "source_size", "target", "epochs", "threshold", "copies", "taken", "mix_hash")
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def mix_hash(seed: int, doc_id: Column, text: Column) -> Column:
    """An unsigned 32-bit hash that SQL engines agree on."""
    whole = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``(source, source_size, target)`` of ``sizes(source, source_size)``; a row per source, so one small sort."""
    every = Window.partitionBy()
    ranked = sizes.withColumn("place", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # by rising cap per weight, those before a source are capped if it is the first that isn't
    rising = every.orderBy(F.col("cap") / F.col("weight"), "place")
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - before) / onward
    ranked = ranked.withColumn("level", level)
    fine = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    ranked = ranked.withColumn("level", F.max(fine).over(every))
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return ranked.select("source", "source_size", target.alias("target"))


def _as_is(df: DataFrame) -> DataFrame:
    return df


def thresholds(hashed: DataFrame, goals: DataFrame, hint: Callable[[DataFrame], DataFrame] = _as_is) -> DataFrame:
    """``goals`` with ``epochs`` and ``threshold``, from ``hashed(source, size, mix_hash)``; ``hint`` is put on tables by source."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    edge = goals.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("under"))
    done = 0
    for bits in LEVELS:
        inside = F.shiftright("mix_hash", HASH_BITS - done) == F.col("prefix")
        rows = hashed.join(hint(edge), F.col("source").eqNullSafe(F.col("s")) & inside)
        done += bits
        sums = rows.groupBy("s", "rest", "under", F.shiftright("mix_hash", HASH_BITS - done).alias("next")).agg(F.sum("size").alias("own"))
        running = F.sum("own").over(Window.partitionBy("s").orderBy("next")) + F.col("under")
        passed = sums.withColumn("running", running).where(F.col("running") > F.col("rest"))
        first = passed.groupBy("s", "rest").agg(F.min(F.struct("next", "running", "own")).alias("first"))
        edge = first.select(
            "s", "rest", F.col("first.next").alias("prefix"), (F.col("first.running") - F.col("first.own")).alias("under"), F.col("first.own").alias("own")
        )
        edge = cut_lineage(edge)
    # the hash value that passes the budget goes in if that is nearer
    nearer = F.col("under") + F.col("own") - F.col("rest") < F.col("rest") - F.col("under")
    limits = edge.select("s", (F.col("prefix") + nearer.cast("long")).alias("threshold"))
    out = goals.join(limits, F.col("source").eqNullSafe(F.col("s")), "left")
    full = F.when(F.col("rest") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(0)).cast("long")
    return out.select("source", "source_size", "target", "epochs", F.coalesce("threshold", full).alias("threshold"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 8) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``: how often the mix takes each document."""
    rest = [c for c in docs.columns if c not in ADDED]
    sized = docs.select(*rest, word_count(F.col("text")).alias("size"), mix_hash(seed, F.col("doc_id"), F.col("text")).alias("mix_hash"))
    hashed = cut_lineage(sized.select("source", "size", "mix_hash"))
    return _mixed(sized, hashed, weights, share, most)


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 8) -> DataFrame:
    """As ``mix``, without the texts and so in one pass over them: ``(doc_id, source, ...)``."""
    columns = [F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), mix_hash(seed, F.col("doc_id"), F.col("text")).alias("mix_hash")]
    sized = cut_lineage(docs.select(*columns))
    return _mixed(sized, sized.select("source", "size", "mix_hash"), weights, share, most)


def _mixed(sized: DataFrame, hashed: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    sizes = cut_lineage(hashed.groupBy("source").agg(F.sum("size").alias("source_size")))
    hint = F.broadcast if sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else _as_is
    goals = cut_lineage(targets(sizes, weights, share, most))
    limits = cut_lineage(thresholds(hashed, goals, hint)).withColumnRenamed("source", "__source")
    out = sized.join(hint(limits), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    out = out.withColumn("copies", F.col("epochs") + (F.col("mix_hash") < F.col("threshold")).cast("long"))
    return out.withColumn("taken", F.col("size") * F.col("copies")).drop("epochs", "threshold", "mix_hash")


ORACLE_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5('8:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 8))::BIGINT AS h
    FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sizes),
weighed AS (SELECT *, CASE place % 3 WHEN 1 THEN 3.0 WHEN 2 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked),
levels AS (
    SELECT *, ((SELECT sum(source_size) FROM sizes)::DOUBLE * 1.5::DOUBLE
               - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed),
filled AS (SELECT max(level) AS level FROM levels WHERE level * weight <= cap),
goals AS (
    SELECT source, source_size, coalesce(least(cap, filled.level * weight), cap) AS target
    FROM weighed CROSS JOIN filled),
parts AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM goals),
sums AS (SELECT source, h, sum(size) AS own FROM sized GROUP BY source, h),
running AS (SELECT *, sum(own) OVER (PARTITION BY source ORDER BY h) AS upto FROM sums),
taken AS (
    SELECT r.source, r.h, r.upto <= p.target - p.epochs * p.source_size
        OR (r.upto - r.own <= p.target - p.epochs * p.source_size
            AND r.upto - (p.target - p.epochs * p.source_size) < (p.target - p.epochs * p.source_size) - (r.upto - r.own)) AS more
    FROM running r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.epochs + CASE WHEN t.more AND p.target - p.epochs * p.source_size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
JOIN taken t ON d.source IS NOT DISTINCT FROM t.source AND d.h = t.h
"""
