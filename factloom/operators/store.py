"""The bitemporal fact table: slices, history, transactions, retraction, zone statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.fixtures import FACT_COLUMNS
from factloom.functions import columns as C
from factloom.runtime import cut_lineage

VALUE_COLUMNS = ("v_bool", "v_i64", "v_f64", "v_str", "v_lat_e7", "v_lon_e7", "v_time", "v_ref")
FACT_BYTES = 35


def slice_at(facts: DataFrame, valid_at: int, sys_at: int) -> DataFrame:
    """Facts visible at (valid time, transaction): four comparisons that reach the scan."""
    return facts.where(C.visible(valid_at, sys_at))


def entity_slice(facts: DataFrame, entity: int, valid_at: int, sys_at: int) -> DataFrame:
    return slice_at(facts.where(F.col("entity") == entity), valid_at, sys_at)


def history(facts: DataFrame, entity: int) -> DataFrame:
    """All facts of an entity whatever their time, in the order in which they became known."""
    return facts.where(F.col("entity") == entity).orderBy("fact_id")


def known_rows(facts: DataFrame, sys_at: int) -> DataFrame:
    """Number of facts that were asserted up to a transaction."""
    return facts.where(F.col("sys_from") <= sys_at).agg(F.count("*").alias("known_rows"))


def revisions(facts: DataFrame, entity: Column | None = None) -> DataFrame:
    """Attributes of an entity with at least two versions in its history."""
    rows = facts if entity is None else facts.where(entity)
    return rows.groupBy("entity", "attr").agg(F.count("*").alias("versions"), F.min("fact_id").alias("first_fact"), F.max("fact_id").alias("last_fact")).where("versions >= 2")


def txn_table(facts: DataFrame) -> DataFrame:
    """``(txn_id, fact_count, first_fact)`` as far as facts show it."""
    return facts.groupBy(F.col("sys_from").alias("txn_id")).agg(F.count("*").alias("fact_count"), F.min("fact_id").alias("first_fact"))


def txn_at_or_before(txns: DataFrame, wall_clock: int) -> DataFrame:
    """The last transaction at or before an instant; 0 (nothing known) where there is none."""
    return txns.where(F.col("wall_clock_unix") <= wall_clock).agg(F.coalesce(F.max("txn_id"), F.lit(0)).alias("txn_id"))


def txn_asof(instants: DataFrame, txns: DataFrame, key: str, wall: str) -> DataFrame:
    """``(key, txn_id)``: the last transaction at or before each instant.

    Instants and transactions are cut into minutes: the running maximum is taken within a
    minute, over the minutes of a day and over days, so no task sees a busy day's rows or the
    whole line of time.
    """
    day, minute = 86_400, 60
    marks = txns.select(F.col("wall_clock_unix").alias("at"), F.lit(0).alias("side"), "txn_id", F.lit(None).cast("long").alias("k"))
    asked = instants.select(F.col(wall).alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("txn_id"), F.col(key).cast("long").alias("k"))
    both = marks.unionByName(asked).withColumn("minute", F.floor(F.col("at") / minute))
    inside = F.max("txn_id").over(Window.partitionBy("minute").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    minutes = both.groupBy("minute").agg(F.max("txn_id").alias("last")).withColumn("day", F.floor(F.col("minute") * minute / day))
    days = minutes.groupBy("day").agg(F.max("last").alias("last"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col("day").alias("d"), F.max("last").over(upto(Window.orderBy("day"))).alias("day_before"))
    minutes = minutes.withColumn("minute_before", F.max("last").over(upto(Window.partitionBy("day").orderBy("minute"))))
    before = minutes.join(days, F.col("day") == F.col("d")).select("minute", F.coalesce("minute_before", "day_before").alias("before"))
    found = both.withColumn("within", inside).where("side = 1").join(before, "minute", "left")
    return found.select(F.col("k").alias(key), F.coalesce("within", "before", F.lit(0)).alias("txn_id"))


def apply_retractions(facts: DataFrame, retractions: DataFrame) -> DataFrame:
    """Close ``sys_to`` at the first of ``retractions(fact_id, txn_id)``; later ones and unknown ids change nothing."""
    first = retractions.groupBy("fact_id").agg(F.min("txn_id").alias("ended"))
    joined = facts.join(first, "fact_id", "left")
    ended = F.least("sys_to", F.coalesce("ended", F.lit(C.OPEN_SYSTEM)))
    return joined.withColumn("sys_to", ended).drop("ended").select(*facts.columns)


def chunk_stats(facts: DataFrame) -> DataFrame:
    """Zone map: bounds and count for each 8192 facts."""
    return facts.groupBy("chunk").agg(
        F.min("valid_from").alias("min_valid_from"),
        F.max("valid_to").alias("max_valid_to"),
        F.min("sys_from").alias("min_sys_from"),
        F.max("sys_to").alias("max_sys_to"),
        F.count("*").alias("rows"),
    )


#: Key cells of 2^12 by 2^12 over the Earth, of which the counts per attribute are kept.
CELL_SHIFT = 40


def key_cells(facts: DataFrame) -> DataFrame:
    """``(attr, cell, rows)``: positions by attribute and Z-order cell, for estimates without reading facts."""
    held = facts.where(F.col("morton").isNotNull())
    return held.groupBy("attr", F.shiftrightunsigned("morton", CELL_SHIFT).alias("cell")).agg(F.count("*").alias("rows"))


def rows_in_ranges(cells: DataFrame, attr: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """``(rows)``: at most so many positions of the attribute lie in the key ranges."""
    wide = [(low >> CELL_SHIFT, high >> CELL_SHIFT) for low, high in ranges]
    fits = (F.col("attr") == attr) & C.in_ranges(F.col("cell"), wide)
    return cells.where(fits).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def chunk_can_match(valid_at: int, sys_at: int) -> Column:
    return (F.col("min_sys_from") <= sys_at) & (F.col("max_sys_to") > sys_at) & (F.col("min_valid_from") <= valid_at) & (F.col("max_valid_to") > valid_at)


def prune_counts(chunks: DataFrame, valid_at: int, sys_at: int) -> DataFrame:
    """``(chunks_total, chunks_skipped, rows_kept)`` for a slice, from the zone map alone."""
    fits = chunk_can_match(valid_at, sys_at)
    return chunks.agg(
        F.count("*").alias("chunks_total"),
        F.count_if(~fits).alias("chunks_skipped"),
        F.coalesce(F.sum(F.when(fits, F.col("rows"))), F.lit(0)).alias("rows_kept"),
    )


def scan_stats(facts: DataFrame, chunks: DataFrame, valid_at: int, sys_at: int) -> DataFrame:
    """One row for a slice: chunks in all and skipped, rows in the chunks that are left, and rows that it holds."""
    held = slice_at(facts, valid_at, sys_at).agg(F.count("*").alias("rows_matched"))
    told = prune_counts(chunks, valid_at, sys_at).withColumnRenamed("rows_kept", "rows_scanned")
    return told.crossJoin(held)  # a row each


def resident_bytes(facts: DataFrame) -> int:
    return facts.count() * FACT_BYTES


def valid_extent(facts: DataFrame) -> DataFrame:
    return facts.agg(F.min("valid_from").alias("first_valid"), F.max("valid_from").alias("last_valid"))


def value_text(row: str = "") -> Column:
    """A fact's value as text, whatever its kind; null for a null."""
    c = lambda name: F.col(row + name)
    place = F.concat_ws(",", (c("v_lat_e7") / 1e7).cast("string"), (c("v_lon_e7") / 1e7).cast("string"))
    shown = {C.BOOL: c("v_bool"), C.I64: c("v_i64"), C.F64: c("v_f64"), C.SYM: c("v_str"), C.GEO: place, C.TIME: C.to_unix(c("v_time")), C.REF: c("v_ref")}
    out = F.when(c("kind") == C.NULL, F.lit(None).cast("string"))
    for kind, column in shown.items():
        out = out.when(c("kind") == kind, column.cast("string"))
    return out


def rendered(facts: DataFrame) -> DataFrame:
    """``(fact_id, json)``: facts as documents with Unix times; an open end is left out."""
    kind = F.element_at(F.array(*[F.lit(k) for k in C.KINDS]), F.col("kind") + 1)
    until = F.when(F.col("valid_to") < C.OPEN_VALID, C.to_unix(F.col("valid_to")))
    closed = F.when(F.col("sys_to") < C.OPEN_SYSTEM, F.col("sys_to"))
    parts = F.struct(
        "attr", kind.alias("kind"), value_text().alias("value"), "source", C.to_unix(F.col("valid_from")).alias("validFrom"), until.alias("validTo"), F.col("sys_from").alias("sysFrom"), closed.alias("sysTo")
    )
    return facts.select("fact_id", F.to_json(parts).alias("json"))


def layer_counts(facts: DataFrame, valid_at: int, sys_at: int, geo_attrs: tuple[str, ...]) -> DataFrame:
    """Visible positions per layer."""
    seen = slice_at(facts, valid_at, sys_at).where(F.col("attr").isin(*geo_attrs))
    return seen.groupBy("attr").agg(F.count("*").alias("points"))


def attributes(facts: DataFrame) -> DataFrame:
    """The known attribute names, which take the place of interned symbols."""
    return facts.select("attr").distinct()


def declare_attributes(declarations: DataFrame) -> DataFrame:
    """One row per name: the highest sensitivity and whether any declaration calls it identifying."""
    return declarations.groupBy("name").agg(F.max("sensitivity").alias("sensitivity"), F.bool_or("identifying").alias("identifying"))


def dense_ids(keyed: DataFrame, key: str, order: str) -> DataFrame:
    """``(key, entity_id)``, numbered by first sighting.

    Only the distinct keys with their first place are sorted. Numbers are given within
    ranges of that place and moved by the counts of the ranges before.
    """
    first = keyed.groupBy(key).agg(F.min(order).alias("first_seen"))
    step = 1 << 16
    first = first.withColumn("range", F.floor(F.col("first_seen") / step))
    counts = first.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("first_seen", key)) - 1
    return first.withColumn("place", place).join(before, "range").select(key, (F.col("before") + F.col("place")).alias("entity_id"))


def accepted(staged: DataFrame) -> Column:
    """Rows that ingest takes: a known kind and a non-empty interval."""
    return F.coalesce(F.col("kind").between(0, len(C.KINDS) - 1) & (F.col("valid_from") < F.col("valid_to")), F.lit(False))


def ingest_counts(staged: DataFrame) -> DataFrame:
    fine = accepted(staged)
    return staged.agg(F.count_if(fine).alias("accepted"), F.count_if(~fine).alias("rejected"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``place``, counted from 0 without gaps.

    Rows are materialised with their number within the partition, so that a lost task can't
    change it; only the partitions' counts are summed up.
    """
    low = 33  # bits of the number within a partition
    held = cut_lineage(rows.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", low)
    counts = held.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("__part", before.alias("__before")))  # a row per partition
    placed = held.join(offsets, part == F.col("__part"))
    return placed.withColumn("place", F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << low) - 1))).drop("__id", "__part", "__before")


def as_facts(staged: DataFrame, txn_id: Column, fact_id: Column) -> DataFrame:
    """Accepted staged rows in the stored form, open on the system axis."""
    rows = staged.where(accepted(staged))
    for name in VALUE_COLUMNS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None))
    casts = {"v_bool": "boolean", "v_i64": "long", "v_f64": "double", "v_str": "string", "v_lat_e7": "int", "v_lon_e7": "int", "v_time": "int", "v_ref": "long"}
    rows = rows.withColumns({k: F.col(k).cast(v) for k, v in casts.items()})
    rows = rows.withColumns({"fact_id": fact_id.cast("long"), "sys_from": txn_id.cast("long"), "sys_to": F.lit(C.OPEN_SYSTEM).cast("long")})
    geo = F.when(F.col("kind") == C.GEO, C.morton(F.col("v_lat_e7"), F.col("v_lon_e7")))
    rows = rows.withColumns({"morton": geo, "chunk": F.shiftright("fact_id", C.CHUNK_BITS)})
    return rows.select(*FACT_COLUMNS)


#: Orders in which facts are stored: by what became known, by entity (history, inspection) or by place.
ORDERS = {"system": ("sys_from", "fact_id"), "entity": ("entity", "fact_id"), "space": ("morton", "fact_id")}


def write_facts(facts: DataFrame, path: str, mode: str = "append", order: str = "system", partitions: int | None = None) -> None:
    """Store facts in one of ``ORDERS``, so that row groups bound its leading column tightly and scans skip the others."""
    keys = ORDERS[order]
    dealt = facts.repartitionByRange(partitions, *keys) if partitions else facts.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode(mode).parquet(path)
