"""The store against a list of rows that is searched from end to end."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.fixtures import FACT_SCHEMA
from factloom.functions import columns as C
from factloom.functions import scalars as S
from factloom.operators import spatial, store

ROW = "fact_id long, entity long, attr string, valid_from int, valid_to int, sys_from long, sys_to long"


def world(seed, n=400):
    """A tiny domain, so that intervals, versions and retractions meet often."""
    rng = random.Random(seed)
    rows, txn, closed = [], 0, []
    while len(rows) < n:
        txn += 1
        for _ in range(rng.randint(1, 8)):
            if rows and rng.random() < 0.22:
                closed.append((rng.randrange(len(rows)), txn))
            else:
                start = rng.randint(-20, 50)
                end = C.OPEN_VALID if rng.random() < 0.3 else start + rng.randint(1, 30)
                rows.append((len(rows), rng.randint(0, 12), f"a{rng.randint(0, 3)}", start, end, txn, C.OPEN_SYSTEM))
    return rows, closed, txn


@pytest.mark.parametrize("seed", [1, 2])
def test_slices_match_a_linear_search(spark, seed):
    rows, closed, last = world(seed)
    facts = store.apply_retractions(spark.createDataFrame(rows, ROW), spark.createDataFrame([*closed, (10_000, 1)], "fact_id long, txn_id long")).cache()
    ended = {}
    for fact, txn in closed:
        ended.setdefault(fact, txn)
    rng = random.Random(seed)
    for _ in range(12):
        t, s = rng.randint(-25, 60), rng.randint(0, last + 1)
        expected = [r[0] for r in rows if r[5] <= s < ended.get(r[0], C.OPEN_SYSTEM) and r[3] <= t < r[4]]
        assert sorted(r["fact_id"] for r in store.slice_at(facts, t, s).collect()) == expected
    assert store.slice_at(facts, 0, 0).count() == 0
    entity = rows[0][1]
    assert [r["fact_id"] for r in store.history(facts, entity).collect()] == [r[0] for r in rows if r[1] == entity]
    chunked = facts.withColumn("chunk", F.shiftright("fact_id", 4))
    zones = store.chunk_stats(chunked).cache()
    for t, s in ((-25, last), (5, 3), (70, last)):
        kept = {r["chunk"] for r in zones.where(store.chunk_can_match(t, s)).collect()}
        assert {r["chunk"] for r in store.slice_at(chunked, t, s).collect()} <= kept
        counted = store.prune_counts(zones, t, s).first()
        assert counted["chunks_total"] - counted["chunks_skipped"] == len(kept)


def test_txn_lookup(spark):
    txns = spark.createDataFrame([(1, 100), (2, 100), (3, 90_000), (4, 500_000)], "txn_id long, wall_clock_unix long")
    asked = spark.createDataFrame([(i, w) for i, w in enumerate((50, 100, 89_999, 90_000, 400_000, 10**9))], "k long, w long")
    assert {r["k"]: r["txn_id"] for r in store.txn_asof(asked, txns, "k", "w").collect()} == {0: 0, 1: 2, 2: 2, 3: 3, 4: 3, 5: 4}
    assert store.txn_at_or_before(txns, 99).first()[0] == 0


def test_write_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p", C.GEO, 10, -20, 0, 5, 3)], "entity long, attr string, kind int, v_lat_e7 int, v_lon_e7 int, valid_from int, valid_to int, source int")
    facts = store.as_facts(rows, F.lit(7), F.lit(8193))
    store.write_facts(facts, f"{tmp_path}/facts")
    found = spark.read.schema(FACT_SCHEMA).parquet(f"{tmp_path}/facts").first()
    assert (found["sys_from"], found["sys_to"], found["chunk"], found["morton"]) == (7, C.OPEN_SYSTEM, 1, S.interleave(10 + C.LAT_BIAS, -20 + C.LON_BIAS))
    bad = spark.createDataFrame([(0, 1, 2), (200, 1, 2), (3, 5, 5), (None, 1, 2)], "kind int, valid_from int, valid_to int")
    assert tuple(store.ingest_counts(bad).first()) == (1, 3)


def positions(spark, seed, n=600, lat=89, lon=180):
    rng = random.Random(seed)
    rows = [(i, round(rng.uniform(-lat, lat) * 1e7), round(rng.uniform(-lon, lon) * 1e7)) for i in range(n)]
    rows += [(n, 899_999_999, 0), (n + 1, 0, 1_799_999_999), (n + 2, 0, -1_800_000_000)]
    made = spark.createDataFrame(rows, "fact_id long, v_lat_e7 int, v_lon_e7 int").withColumn("morton", C.morton(F.col("v_lat_e7"), F.col("v_lon_e7")))
    return rows, made.checkpoint()


def test_boxes_and_radii_match_brute_force(spark):
    rows, geo = positions(spark, 3)
    rng = random.Random(4)
    for _ in range(6):
        south, west = rng.uniform(-90, 60), rng.uniform(-180, 120)
        box = (south, west, south + rng.uniform(0, 40), west + rng.uniform(0, 90))
        expected = {i for i, y, x in rows if box[0] <= y / 1e7 <= box[2] and box[1] <= x / 1e7 <= box[3]}
        assert {r["fact_id"] for r in spatial.box_filter(geo, box).collect()} == expected
        ranges = spatial.box_ranges(box)
        assert len(ranges) <= 64 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    for lat, lon, metres in ((0, 179.9, 900_000), (88, 10, 700_000), (-45, -179, 1_500_000), (10, 10, 3_000_000), (0, 0, 30_000_000)):
        expected = {i for i, y, x in rows if S.haversine_m(lat, lon, y / 1e7, x / 1e7) <= metres}
        assert {r["fact_id"] for r in spatial.radius_filter(geo, lat, lon, metres).collect()} == expected
    assert spatial.box_ranges((1, 1, 0, 2)) == [] and spatial.box_filter(geo, (1, 1, 0, 2)).count() == 0
    assert spatial.range_rows(geo, (0, 0, 40, 40)).first()["matched"] <= spatial.range_rows(geo, (0, 0, 40, 40)).first()["candidates"]


def test_nearest_matches_brute_force(spark):
    rows, geo = positions(spark, 5)
    for lat, lon in ((15, 15), (-60, 179.5)):
        expected = sorted(S.haversine_m(lat, lon, y / 1e7, x / 1e7) for _, y, x in rows)[:5]
        assert [r["distance_m"] for r in spatial.nearest(geo, lat, lon, 5).collect()] == pytest.approx(expected)
    assert spatial.nearest(geo, 0, 0, 5000).count() == len(rows)


def test_keys(spark):
    rows, geo = positions(spark, 6, 50)
    found = geo.select("*", C.morton_lat_e7(F.col("morton")).alias("y"), C.morton_lon_e7(F.col("morton")).alias("x")).collect()
    assert all((r["y"], r["x"]) == (r["v_lat_e7"], r["v_lon_e7"]) and r["morton"] == S.interleave(r["v_lat_e7"] + C.LAT_BIAS, r["v_lon_e7"] + C.LON_BIAS) for r in found)
    key = found[0]["morton"]
    assert spatial.cell_count(geo, key, 4).first()[0] == sum(r["morton"] >> 56 == key >> 56 for r in found)
    assert sum(r["n"] for r in spatial.cells(geo, 4).collect()) == len(found)
    degrees = spark.createDataFrame([(91.0, 190.0), (-95.0, -181.0), (45.00000005, 180.0)], "lat double, lon double")
    assert [tuple(r) for r in degrees.select(C.lat_e7(F.col("lat")), C.lon_e7(F.col("lon"))).collect()] == [(900_000_000, -1_700_000_000), (-900_000_000, 1_790_000_000), (450_000_001, 1_800_000_000)]


def test_haversine():
    assert S.haversine_m(0, 0, 0, 1) == pytest.approx(111_195, rel=1e-3)
    assert S.haversine_m(40.7128, -74.006, 51.5074, -0.1278) == pytest.approx(5.57e6, rel=0.01)
    assert S.haversine_m(0, 0, 0, 180) == pytest.approx(20_015_000, rel=1e-3) and S.haversine_m(3, 4, 3, 4) == 0


def test_dense_ids(spark):
    keyed = spark.createDataFrame([("b", 5), ("a", 900_000), ("b", 70_000), ("c", 6)], "key string, at long")
    assert {r["key"]: r["entity_id"] for r in store.dense_ids(keyed, "key", "at").collect()} == {"b": 0, "c": 1, "a": 2}
