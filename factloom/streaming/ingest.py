"""From normalised records to committed facts: transactions, clamping, duplicate guard.

Records are ``(source, entity, attr, kind, v_*, valid_from, valid_to, system_unix, seq)``;
``seq`` is the order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.fixtures import FACT_SCHEMA
from factloom.operators import store
from factloom.runtime import ensure_checkpoint_dir

BUCKET_SECONDS = 60
#: Values of ``seq`` whose running maximum one task takes.
CLAMP_RANGE = 65_536
#: Files of facts after which an ingestor merges them.
COMPACT_FILES = 64
IDENTITY_SCHEMA = "source int, entity long, attr string, valid_from int, valid_to int, stamp long, cycle long"
IDENTITY = ("source", "entity", "attr", "valid_from", "valid_to", "stamp")


def bucket(system_unix: Column, seconds: int = BUCKET_SECONDS) -> Column:
    """Start of the tumbling window that a record becomes known in."""
    return F.floor(system_unix / seconds) * seconds


def batches(records: DataFrame, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``(wall_clock_unix, n)`` per bucket, in ascending order."""
    return records.groupBy(bucket(F.col("system_unix"), seconds).alias("wall_clock_unix")).agg(F.count("*").alias("n")).orderBy("wall_clock_unix")


def with_identity(records: DataFrame, fetch_time_sources: Iterable[int] = (), seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Records with their bucket and the stamp that makes a revision differ from a repeat.

    The stamp is the record's own bucket, not the clamped clock, and is left out for sources
    whose system time is only when they were fetched. The value is no part of the identity.
    """
    rows = records.withColumn("bucket", bucket(F.col("system_unix"), seconds))
    invented = list(fetch_time_sources)
    stamp = F.when(F.col("source").isin(*invented), F.lit(-1)).otherwise(F.col("bucket")) if invented else F.col("bucket")
    return rows.withColumn("stamp", stamp.cast("long"))


def fresh(records: DataFrame, committed: DataFrame) -> DataFrame:
    """Records whose identity isn't in ``committed``, one of each: of repeats the first to arrive.

    Nulls are the same as each other. A record without ``seq`` comes last, and of those that
    arrived at once the least by its other columns is taken. Repeats are reduced before the
    shuffle, so an identity sent very often sends a row per task.
    """
    rest = [c for c in records.columns if c not in IDENTITY and c != "seq"]
    first = F.min(F.struct(F.col("seq").isNull().alias("__unplaced"), "seq", *rest)).alias("__first")
    firsts = records.groupBy(*IDENTITY).agg(first).select(*IDENTITY, "__first.*")
    known = committed.select(*[F.col(name).alias(f"__{name}") for name in IDENTITY])
    same = F.lit(True)
    for name in IDENTITY:
        same = same & F.col(name).eqNullSafe(F.col(f"__{name}"))
    return firsts.join(known, same, "left_anti").select(*records.columns)


def clamp(walls: DataFrame, last_wall: int | None = None) -> DataFrame:
    """``walls(seq, wall_clock_unix)`` with ``clamped_wall`` that never runs backwards, and whether it was moved.

    The running maximum is taken within ranges of ``seq`` and over these ranges, so no task
    sees all rows.
    """
    floor = F.lit(last_wall if last_wall is not None else -(1 << 62))
    ranged = walls.withColumn("__range", F.floor(F.col("seq") / CLAMP_RANGE))
    most = ranged.groupBy(F.col("__range").alias("__r")).agg(F.max("wall_clock_unix").alias("__most"))
    before = F.max("__most").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.max("wall_clock_unix").over(Window.partitionBy("__range").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.withColumn("__inside", inside).join(most.select("__r", before.alias("__before")), F.col("__range") == F.col("__r"))
    out = out.withColumn("clamped_wall", F.greatest("__inside", "__before", floor)).drop("__range", "__r", "__inside", "__before")
    return out.withColumn("was_clamped", F.col("clamped_wall") > F.col("wall_clock_unix"))


class Ingestor:
    """Commits cycles of records to Parquet tables ``facts``, ``txns`` and ``identities`` under a folder.

    One writer per folder. A cycle is idempotent by its id: what a failed try has written is
    not listed in ``txns`` and is passed over by readers, and a repeated id changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, fetch_time_sources: Iterable[int] = (), seconds: int = BUCKET_SECONDS):
        self.spark, self.folder, self.seconds = spark, folder, seconds
        self.fetch_time_sources = tuple(fetch_time_sources)
        ensure_checkpoint_dir(spark)

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    @property
    def txns(self) -> DataFrame:
        return self._read("txns", "txn_id long, wall_clock_unix long, fact_count long, first_fact long, cycle long")

    @property
    def facts(self) -> DataFrame:
        cycles = self.txns.select("cycle").distinct()
        return self._read(self._current("facts"), FACT_SCHEMA + ", cycle long").join(cycles, "cycle", "left_semi").drop("cycle")

    @property
    def identities(self) -> DataFrame:
        cycles = self.txns.select("cycle").distinct()
        schema = IDENTITY_SCHEMA
        return self._read(self._current("identities"), schema).join(cycles, "cycle", "left_semi")

    def _generations(self) -> list[int]:
        """Numbers of the merged copies that are complete; the last holds all cycles before it."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/generations")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()) for s in system.listStatus(path)) if system.exists(path) else []

    def _current(self, name: str) -> str:
        done = self._generations()
        return f"{name}-{done[-1]}" if done else name

    def compact(self) -> int:
        """Merge the cycles' small files into tables in system order; returns the number of the copy.

        The copy is written beside what is read and named last, so a failed try changes nothing
        and readers see the one or the other; later cycles append to the copy. Copies before
        the one that it replaces are removed, so that reads that have begun can end.
        """
        done = self._generations()
        number = (done[-1] if done else 0) + 1
        for name, schema, keys in (("facts", FACT_SCHEMA + ", cycle long", ("sys_from", "fact_id")), ("identities", IDENTITY_SCHEMA, ("entity", "attr"))):
            cycles = self.txns.select("cycle").distinct()
            rows = self._read(self._current(name), schema).join(cycles, "cycle", "left_semi")
            rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{self.folder}/{name}-{number}")
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        mark = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/generations/{number}")
        system = mark.getFileSystem(conf)
        system.mkdirs(mark)
        for name in ("facts", "identities"):
            old = [name] if len(done) == 1 else [f"{name}-{n}" for n in done[:-1]]
            for path in old if done else []:
                system.delete(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}"), True)
        return number

    def files(self) -> int:
        """Files of facts that a reader opens now."""
        return len(self._read(self._current("facts"), FACT_SCHEMA + ", cycle long").inputFiles())

    def cycle(self, records: DataFrame, cycle_id: int) -> dict[str, int]:
        """Commit one cycle; returns counts of transactions, facts, duplicates and clamped batches."""
        nothing = {"committed": 0, "facts": 0, "duplicates": 0, "clamped": 0}
        if not self.txns.where(F.col("cycle") == cycle_id).isEmpty():
            return nothing
        rows = with_identity(records, self.fetch_time_sources, self.seconds).where(store.accepted(records))
        total = rows.count()
        new = fresh(rows, self.identities).checkpoint()
        last = self.txns.agg(F.max("txn_id").alias("t"), F.max("wall_clock_unix").alias("w"), F.sum("fact_count").alias("n")).first()
        per = new.groupBy(F.col("bucket").alias("wall_clock_unix")).agg(F.count("*").alias("fact_count"))
        walls = clamp(per.withColumn("seq", F.col("wall_clock_unix")), last["w"])
        order = Window.orderBy("wall_clock_unix")
        before = F.coalesce(F.sum("fact_count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        made = walls.withColumn("txn_id", F.row_number().over(order).cast("long") + (last["t"] or 0)).withColumn("first_fact", before + (last["n"] or 0)).checkpoint()
        counts = made.agg(F.count("*").alias("txns"), F.count_if("was_clamped").alias("clamped"), F.coalesce(F.sum("fact_count"), F.lit(0)).alias("facts")).first()
        if not counts["txns"]:
            return nothing | {"duplicates": total}
        placed = new.join(F.broadcast(made.select(F.col("wall_clock_unix").alias("b"), "txn_id", "first_fact")), F.col("bucket") == F.col("b"))
        placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("txn_id").orderBy("seq")) - 1)
        facts = store.as_facts(placed, F.col("txn_id"), F.col("first_fact") + F.col("place"))
        facts.withColumn("cycle", F.lit(cycle_id).cast("long")).sortWithinPartitions("fact_id").write.mode("append").parquet(f"{self.folder}/{self._current('facts')}")
        new.select(*IDENTITY).withColumn("cycle", F.lit(cycle_id).cast("long")).write.mode("append").parquet(f"{self.folder}/{self._current('identities')}")
        # the list of transactions is written last: it makes the cycle visible
        made.select("txn_id", F.col("clamped_wall").alias("wall_clock_unix"), F.col("fact_count").cast("long"), F.col("first_fact").cast("long"), F.lit(cycle_id).cast("long").alias("cycle")).coalesce(1).write.mode("append").parquet(f"{self.folder}/txns")
        if self.files() > COMPACT_FILES:
            self.compact()
        return {"committed": counts["txns"], "facts": counts["facts"], "duplicates": total - counts["facts"], "clamped": counts["clamped"]}

    def follow(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None):
        """Commit each micro-batch of a stream of records as one cycle."""

        def commit(batch: DataFrame, batch_id: int) -> None:
            self.cycle(prepare(batch) if prepare else batch, batch_id)

        return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def merge_latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, where a new row replaces the old one."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), "__age").alias("r")).select(key, "r.*").select(*old.columns)


def due(sources: DataFrame, now: int, viewport: bool = True) -> DataFrame:
    """Sources to poll: ``(key, poll_seconds, last_unix, needs_viewport)``; without a poll time only the first time."""
    never = F.col("last_unix").isNull()
    again = F.col("poll_seconds").isNotNull() & (F.col("last_unix") + F.col("poll_seconds") <= now)
    rows = sources.where(never | again)
    return rows if viewport else rows.where(~F.col("needs_viewport"))


def recompute(ingestor: Ingestor, payloads: DataFrame, derive: Callable[[DataFrame, int], DataFrame], at_unix: int, cycle_id: int) -> dict[str, int]:
    """Commit what a derived source (such as orbits) gives for another instant from the payload that is already there."""
    return ingestor.cycle(derive(payloads, at_unix), cycle_id)


def windowed_counts(stream: DataFrame, late: str = "2 hours", window: str = "60 seconds") -> DataFrame:
    """Records per source and window of event time, with late ones taken up to ``late``."""
    at = F.timestamp_seconds("system_unix")
    return stream.withColumn("at", at).withWatermark("at", late).groupBy("source", F.window("at", window)).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, late: str = "2 hours", fetch_time_sources: Iterable[int] = ()) -> DataFrame:
    """The duplicate guard with bounded state: identities are forgotten once they are ``late``."""
    rows = with_identity(stream, fetch_time_sources).withColumn("at", F.timestamp_seconds("system_unix"))
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(list(IDENTITY))
