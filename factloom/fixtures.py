"""The driver's event tables as facts: three per event, with late knowledge and retractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.runtime import table

FACT_COLUMNS = (
    "fact_id", "entity", "attr", "kind", "v_bool", "v_i64", "v_f64", "v_str", "v_lat_e7", "v_lon_e7", "v_time", "v_ref",
    "valid_from", "valid_to", "sys_from", "sys_to", "source", "morton", "chunk",
)
FACT_SCHEMA = (
    "fact_id long, entity long, attr string, kind int, v_bool boolean, v_i64 long, v_f64 double, v_str string, v_lat_e7 int, v_lon_e7 int, "
    "v_time int, v_ref long, valid_from int, valid_to int, sys_from long, sys_to long, source int, morton long, chunk long"
)
LATE_BY, RETRACT_AFTER, RETRACT_WITHIN, BUCKET = 7200, 3600, 604_800, 60


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("u", F.unix_seconds(F.col("ts").cast("timestamp")))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the start of the minute in which they became known."""
    wall = F.col("u") + (F.col("event_id") * 7919) % LATE_BY
    return events(spark, sf_dir).withColumn("wall", wall).withColumn("bucket", F.col("wall") - F.col("wall") % BUCKET)


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(txn_id, wall_clock_unix, fact_count, first_fact)``; a row per minute, so one narrow sort."""
    per = buckets(spark, sf_dir).groupBy("bucket").agg((F.count("*") * 3).alias("fact_count"))
    order = Window.orderBy("bucket")
    before = F.coalesce(F.sum("fact_count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.select(
        F.row_number().over(order).cast("long").alias("txn_id"), F.col("bucket").alias("wall_clock_unix"), "fact_count", before.alias("first_fact")
    )


def facts(spark: SparkSession, sf_dir: str, entity: str = "user_id") -> DataFrame:
    """Position, magnitude and label of each event.

    Transactions are numbered over the distinct minutes alone; within one, facts follow the
    event and the attribute, so fact ids need a sort per transaction, not of the table.
    """
    known = txns(spark, sf_dir)
    later = Window.orderBy("wall_clock_unix").rangeBetween(RETRACT_AFTER, RETRACT_AFTER + RETRACT_WITHIN - 1)
    known = known.select(F.col("wall_clock_unix").alias("b"), "txn_id", "first_fact", F.min("txn_id").over(later).alias("retracted"))
    rows = buckets(spark, sf_dir).join(known, F.col("bucket") == F.col("b"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("txn_id").orderBy("event_id")) - 1)
    lat = ((F.col("event_id") * 7919) % 18_001 * 100_000 - 900_000_000).cast("int")
    lon = ((F.col("event_id") * 104_729) % 36_001 * 100_000 - 1_800_000_000).cast("int")
    attrs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("attr"), F.lit(k).alias("kind")) for i, (a, k) in enumerate((("position", C.GEO), ("magnitude", C.F64), ("label", C.SYM)))])
    rows = rows.withColumn("a", F.explode(attrs))
    at = lambda i, value: F.when(F.col("a.ord") == i, value)
    born = (F.col("u") - C.EPOCH_2000).cast("int")
    fact_id = (F.col("first_fact") + F.col("place") * 3 + F.col("a.ord")).cast("long")
    return rows.select(
        fact_id.alias("fact_id"),
        F.col(entity).alias("entity"),
        F.col("a.attr").alias("attr"),
        F.col("a.kind").alias("kind"),
        F.lit(None).cast("boolean").alias("v_bool"),
        F.lit(None).cast("long").alias("v_i64"),
        at(1, F.col("value")).alias("v_f64"),
        at(2, F.col("event_type")).alias("v_str"),
        at(0, lat).alias("v_lat_e7"),
        at(0, lon).alias("v_lon_e7"),
        F.lit(None).cast("int").alias("v_time"),
        F.lit(None).cast("long").alias("v_ref"),
        born.alias("valid_from"),
        F.when(F.col("event_type") == "view", born + 86_400).otherwise(F.lit(C.OPEN_VALID)).cast("int").alias("valid_to"),
        F.col("txn_id").alias("sys_from"),
        F.when(F.col("event_type") == "error", F.coalesce("retracted", F.lit(C.OPEN_SYSTEM))).otherwise(F.lit(C.OPEN_SYSTEM)).cast("long").alias("sys_to"),
        (F.col("event_id") % 2).cast("int").alias("source"),
        at(0, C.morton(lat, lon)).alias("morton"),
        F.shiftright(fact_id, C.CHUNK_BITS).alias("chunk"),
    )


#: The same facts in DuckDB, as CTEs that end in ``facts`` and ``txns``.
FACTS_SQL = """
b AS (SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS u FROM events),
k AS (SELECT *, (u + (event_id * 7919) % 7200) - (u + (event_id * 7919) % 7200) % 60 AS bucket FROM b),
t AS (SELECT *, dense_rank() OVER (ORDER BY bucket) AS txn FROM k),
r AS (SELECT bucket, min(txn) AS txn, count(*) * 3 AS fact_count FROM t GROUP BY bucket),
q AS (SELECT x.bucket, min(y.txn) AS rt FROM r x JOIN r y ON y.bucket >= x.bucket + 3600 AND y.bucket < x.bucket + 3600 + 604800 GROUP BY x.bucket),
s AS (SELECT t.*, coalesce(q.rt, 4294967295) AS rtxn FROM t LEFT JOIN q ON q.bucket = t.bucket),
a AS (SELECT s.*, x.ord FROM s CROSS JOIN (SELECT 0 AS ord UNION ALL SELECT 1 UNION ALL SELECT 2) x),
facts AS (
    SELECT row_number() OVER (ORDER BY txn, event_id, ord) - 1 AS fact_id, user_id AS entity, event_id,
           CASE ord WHEN 0 THEN 'position' WHEN 1 THEN 'magnitude' ELSE 'label' END AS attr,
           CASE ord WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 4 END AS kind,
           CASE WHEN ord = 1 THEN value END AS v_f64, CASE WHEN ord = 2 THEN event_type END AS v_str,
           CASE WHEN ord = 0 THEN (event_id * 7919) % 18001 * 100000 - 900000000 END AS v_lat_e7,
           CASE WHEN ord = 0 THEN (event_id * 104729) % 36001 * 100000 - 1800000000 END AS v_lon_e7,
           u - 946684800 AS valid_from,
           CASE WHEN event_type = 'view' THEN u - 946684800 + 86400 ELSE 2147483647 END AS valid_to,
           txn AS sys_from, CASE WHEN event_type = 'error' THEN rtxn ELSE 4294967295 END AS sys_to, event_id % 2 AS source
    FROM a),
txns AS (SELECT txn AS txn_id, bucket AS wall_clock_unix, fact_count FROM r)
"""
