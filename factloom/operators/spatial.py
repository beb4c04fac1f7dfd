"""Space: boxes, radii, Z-order ranges, nearest neighbours, picking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.functions import scalars as S

HALF_WORLD_M = 20_037_508.0
MAX_RANGES = 64
FULL = (1 << 32) - 1
Box = tuple[float, float, float, float]


def degrees(column: str) -> Column:
    return F.col(column) / 1e7


def in_box(box: Box) -> Column:
    """Position within (min lat, min lon, max lat, max lon), edges included; an inverted box holds nothing."""
    south, west, north, east = box
    return degrees("v_lat_e7").between(south, north) & degrees("v_lon_e7").between(west, east)


def about_boxes(boxes: list[Box]) -> Column:
    """Stored columns that hold for every position in one of the boxes (and a few beside them): key ranges and whole coordinates.

    Plain comparisons of stored columns with literals, so that they reach the Parquet scan.
    """
    ranges = merge_ranges([r for box in boxes for r in box_ranges(box)])
    sides = F.lit(False)
    for south, west, north, east in boxes:
        if south <= north and west <= east:
            lat = F.col("v_lat_e7").between(math.floor(south * 1e7) - 1, math.ceil(north * 1e7) + 1)
            sides = sides | (lat & F.col("v_lon_e7").between(math.floor(west * 1e7) - 1, math.ceil(east * 1e7) + 1))
    return C.in_ranges(F.col("morton"), ranges) & sides


def distance_from(lat: float, lon: float) -> Column:
    return C.haversine_m(F.lit(float(lat)), F.lit(float(lon)), degrees("v_lat_e7"), degrees("v_lon_e7"))


def radius_boxes(lat: float, lon: float, metres: float) -> list[Box]:
    """Boxes that hold the circle; two where it crosses the antimeridian."""
    reach = math.degrees(metres / C.EARTH_RADIUS_M)
    south, north = max(-90.0, lat - reach), min(90.0, lat + reach)
    if south <= -90.0 or north >= 90.0:
        return [(south, -180.0, north, 180.0)]
    # the circle's widest parallel lies poleward of its centre
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(min(reach, 90.0))) / math.cos(math.radians(lat)))))
    west, east = lon - wide, lon + wide
    if east - west >= 360:
        return [(south, -180.0, north, 180.0)]
    if west < -180:
        return [(south, west + 360, north, 180.0), (south, -180.0, north, east)]
    if east > 180:
        return [(south, west, north, 180.0), (south, -180.0, north, east - 360)]
    return [(south, west, north, east)]


def box_ranges(box: Box, most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ascending, disjoint Z-order ranges that hold a box.

    Cells are split breadth first, the largest first, while the budget lasts; a cell that
    is only partly covered then stays whole, and the exact test removes the rest.
    """
    south, west, north, east = box
    if south > north or west > east:
        return []
    lat = S.biased(south, True), S.biased(north, True)
    lon = S.biased(west, False), S.biased(east, False)
    done: list[tuple[int, int]] = []
    cells = [(0, 0, 32)]  # low corner and bits left per axis
    while cells:
        finer: list[tuple[int, int, int]] = []
        waiting = len(cells)
        for y, x, bits in cells:
            waiting -= 1
            top_y, top_x = y + (1 << bits) - 1, x + (1 << bits) - 1
            if top_y < lat[0] or y > lat[1] or top_x < lon[0] or x > lon[1]:
                continue
            inside = lat[0] <= y and top_y <= lat[1] and lon[0] <= x and top_x <= lon[1]
            if inside or bits == 0 or len(done) + len(finer) + waiting + 4 > most:
                done.append((S.interleave(y, x), S.interleave(top_y, top_x)))
            else:
                half = 1 << (bits - 1)
                finer += [(y + dy, x + dx, bits - 1) for dy in (0, half) for dx in (0, half)]
        cells = finer
    return merge_ranges(done)


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def box_filter(geo: DataFrame, box: Box) -> DataFrame:
    """Geometry facts in a box: Z-order ranges for skipping, then the exact test."""
    return geo.where(about_boxes([box]) & in_box(box))


def radius_filter(geo: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Geometry facts within a distance, with ``distance_m``; also across the antimeridian and at the poles."""
    near = geo.where(about_boxes(radius_boxes(lat, lon, metres))).withColumn("distance_m", distance_from(lat, lon))
    return near.where(F.col("distance_m") <= metres)


def nearest(geo: DataFrame, lat: float, lon: float, k: int, reach_m: float | None = None) -> DataFrame:
    """The k nearest geometry facts, ties by fact id; each task keeps k rows.

    With ``reach_m`` a circle of that radius is counted first, through the key ranges, and made
    four times as wide until it holds k facts or the whole Earth; only the facts in it are ranked.
    """
    near = geo
    while reach_m is not None and reach_m < HALF_WORLD_M:
        circle = radius_filter(geo, lat, lon, reach_m)
        if circle.limit(k).count() >= k:
            near = circle
            break
        reach_m *= 4
    return near.withColumn("distance_m", distance_from(lat, lon)).orderBy("distance_m", "fact_id").limit(k)


def range_rows(geo: DataFrame, box: Box) -> DataFrame:
    """``(candidates, matched)`` of a box: what the key ranges hold and what the exact test keeps."""
    return geo.where(C.in_ranges(F.col("morton"), box_ranges(box))).agg(F.count("*").alias("candidates"), F.count_if(in_box(box)).alias("matched"))


def cell_count(geo: DataFrame, key: int, level: int) -> DataFrame:
    """Geometry facts in the cell of a key, ``level`` bits per axis deep."""
    low = key >> (64 - 2 * level) << (64 - 2 * level) if level else 0
    high = low | ((1 << (64 - 2 * level)) - 1)
    return geo.where(F.col("morton").between(low, min(high, (1 << 63) - 1))).agg(F.count("*").alias("n"))


def cells(geo: DataFrame, level: int) -> DataFrame:
    """All cells of a level with their counts."""
    return geo.groupBy(F.shiftright("morton", 64 - 2 * level).alias("cell")).agg(F.count("*").alias("n"))


def layout(facts: DataFrame) -> DataFrame:
    """Facts in Z-order, for writing a table whose row groups skip by space."""
    return facts.repartitionByRange("morton").sortWithinPartitions("morton", "fact_id")


def inspect(facts: DataFrame, lat: float, lon: float, metres: float, valid_at: int, sys_at: int, geo_attrs: tuple[str, ...] = ()) -> DataFrame:
    """Attributes now and the whole history of the entity nearest to a point, if one lies within ``metres``.

    Only visible geometry of the permitted attributes (any, if none is given) is picked.
    """
    geo = facts.where((F.col("kind") == C.GEO) & C.visible(valid_at, sys_at))
    if geo_attrs:
        geo = geo.where(F.col("attr").isin(*geo_attrs))
    picked = radius_filter(geo, lat, lon, metres).orderBy("distance_m", "fact_id").limit(1).select(F.col("entity").alias("e"), "distance_m")
    rows = facts.join(F.broadcast(picked), F.col("entity") == F.col("e")).drop("e")
    return rows.withColumn("is_now", C.visible(valid_at, sys_at)).orderBy("fact_id")


def query_points(facts: DataFrame, valid_at: int, sys_at: int, geo_attr: str, scalar_attr: str) -> DataFrame:
    """Points of a layer: every visible position with the entity's last numeric scalar (0 if none)."""
    seen = facts.where(C.visible(valid_at, sys_at))
    scalars = seen.where((F.col("attr") == scalar_attr) & C.number().isNotNull())
    last = scalars.groupBy(F.col("entity").alias("e")).agg(F.max_by(C.number(), F.col("fact_id")).alias("last"))
    rows = seen.where((F.col("attr") == geo_attr) & (F.col("kind") == C.GEO)).join(last, F.col("entity") == F.col("e"), "left")
    return rows.select("fact_id", *as_point(F.col("last")))


def as_point(scalar: Column) -> list[Column]:
    return [degrees("v_lat_e7").cast("float").alias("lat"), degrees("v_lon_e7").cast("float").alias("lon"), F.coalesce(scalar, F.lit(0.0)).cast("float").alias("scalar")]
