"""Global shuffling into shards in two passes.

The first pass scatters rows over buckets by a seeded hash; buckets are sized in bytes and
in rows, so that each fits in memory. The second pass takes each bucket whole and permutes
it by a Fisher-Yates shuffle, whose draws are hashes of the seed, the bucket's number and
the step alone. Row p of the shuffled order is slot ``p div n`` of shard ``p mod n``, so
shards differ by one row at most. The result depends on the rows and the seed, not on
partitions, their order or the size of the cluster.

Rows that agree in all columns are interchangeable: they are counted first, one of them is
kept, and its copies, numbered, are scattered like other rows. So repeated rows, whatever
their share of the table, neither fill a bucket nor make a run differ from another.

Edge cases: a null text counts as empty; null ids are rows like any other; a very long text
is a bucket's main content (a bucket holds at least one row); an empty table gives an empty
result; ties don't arise, as copies are numbered; columns named as the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.runtime import cut_lineage

BUCKET_BYTES, BUCKET_ROWS = 8 << 20, 1024
#: Tables of buckets or of repeated rows are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 100_000
#: Copies that one task makes of a repeated row at most.
COPIES_AT_ONCE = 100_000
#: Buckets whose running sums are taken together.
GROUP = 4096


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text and 16 for the record."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _numbered(docs: DataFrame, rest: list[str | Column]) -> DataFrame:
    """``(k1, k2, copy, row)``: each row under a digest of all its columns, its copies numbered from 0."""
    keyed = docs.select(F.xxhash64(*docs.columns).alias("k1"), F.xxhash64(F.lit(1), *docs.columns).alias("k2"), F.struct(*rest).alias("row"))
    again = cut_lineage(keyed.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1"))
    few = again.limit(BROADCAST_ROWS + 1).count()
    if not few:
        return keyed.select("k1", "k2", F.lit(0).cast("long").alias("copy"), "row")
    if few <= BROADCAST_ROWS:
        hint = F.broadcast(again)
        once = keyed.join(hint, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(0).cast("long").alias("copy"), "row")
        first = keyed.join(hint, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row"), F.count("*").alias("n"))
    else:  # many are repeated: one shuffle of all rows, copies joined before it
        once = None
        first = keyed.groupBy("k1", "k2").agg(F.first("row").alias("row"), F.count("*").alias("n"))
    step = F.lit(COPIES_AT_ONCE)
    blocks = first.select("k1", "k2", "n", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step.cast("long"))).alias("low"))
    if not again.where(F.col("n") > COPIES_AT_ONCE).isEmpty():
        blocks = blocks.repartition("k1", "low")
    copies = F.sequence(F.col("low"), F.least(F.col("n"), F.col("low") + step) - 1)
    copies = blocks.select("k1", "k2", F.explode(copies).alias("copy"), "row")
    return copies if once is None else once.unionByName(copies)


def _permutation(size: Column, bucket: Column, seed: int) -> Column:
    """Places 0 to size - 1 in Fisher-Yates order: each step draws one of the places left and moves the last one there."""

    def step(state: Column, last: Column) -> Column:
        left = state["left"]
        drawn = F.pmod(F.xxhash64(F.lit(seed), bucket, last), last + 1).cast("int")
        moved = F.when(drawn == last, F.slice(left, F.lit(1), last)).otherwise(
            F.concat(F.slice(left, F.lit(1), drawn), F.slice(left, last + 1, F.lit(1)), F.slice(left, drawn + 2, F.greatest(last - drawn - 1, F.lit(0))))
        )
        return F.struct(moved.alias("left"), F.concat(state["out"], F.array(F.get(left, drawn))).alias("out"))

    start = F.struct(F.sequence(F.lit(0), size - 1).alias("left"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.sequence(size - 1, F.lit(0), F.lit(-1)), start, step)["out"]


def _offsets(counts: DataFrame) -> DataFrame:
    """``(bucket, before)``: rows in the buckets before each; running sums by groups of buckets, then of groups."""
    grouped = counts.withColumn("group", F.floor(F.col("bucket") / GROUP))
    totals = grouped.groupBy("group").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a row per GROUP buckets
    totals = totals.select(F.col("group").alias("g"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    grouped = grouped.select("group", "bucket", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("own"))
    return grouped.join(totals, F.col("group") == F.col("g")).select("bucket", (F.col("base") + F.col("own")).alias("before"))


def shard(docs: DataFrame, shards: int, seed: int = 4, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, keep: list[str | Column] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep`` of it) with ``shard`` and ``slot``."""
    rest = keep if keep is not None else [c for c in docs.columns if c not in ("shard", "slot")]
    total, rows = docs.agg(F.sum(byte_size(F.col("text"))), F.count("*")).first()
    buckets = max(1, -(-int(total or 0) // bucket_bytes), -(-rows // bucket_rows))
    numbered = _numbered(docs, rest)
    spread = numbered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "k1", "k2", "copy"), F.lit(buckets)).cast("long"))
    offsets = _offsets(spread.groupBy("bucket").agg(F.count("*").alias("n")))
    offsets = cut_lineage(offsets)
    if buckets <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    gathered = spread.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("k1", "k2", "copy", "row"))).alias("rows"))
    order = _permutation(F.size("rows"), F.col("bucket"), seed)
    shuffled = gathered.select("bucket", "rows", order.alias("order")).select("bucket", F.transform("order", lambda k: F.get("rows", k)["row"]).alias("rows"))
    placed = shuffled.join(offsets, "bucket").select("before", F.posexplode("rows").alias("at", "row"))
    place = F.col("before") + F.col("at")
    return placed.select("row.*", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Write the shards as folders ``shard=k``; a file holds a run of ``rows_per_file`` slots in order."""
    run = F.floor(F.col("slot") / rows_per_file)
    sharded.repartition("shard", run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
