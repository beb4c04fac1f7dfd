from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom import fixtures
from factloom.functions import columns as C
from factloom.functions import scalars as S
from factloom.operators import spatial, store
from factloom.plans import compiler
from factloom.plans.language import parse
from factloom.plans.planner import misestimate
from factloom.plans.policy import Policy, Request, Sensitivity
from factloom.plans.session import Session
from factloom.runtime import cut_lineage
from factloom.sources import feeds, probes, registry
from factloom.streaming import ingest

NOW = 1_785_000_000
STAGED = "entity long, attr string, kind int, v_f64 double, v_str string, v_lat_e7 int, v_lon_e7 int, valid_from int, valid_to int, source int"


def quake(entity, lat, lon, magnitude, at, label=None, prefix=""):
    start = S.store_time(at)
    rows = [(entity, f"{prefix}position", C.GEO, None, None, round(lat * 1e7), round(lon * 1e7), start, C.OPEN_VALID, 0)]
    if magnitude is not None:
        rows.append((entity, "magnitude", C.F64, magnitude, None, None, None, start, C.OPEN_VALID, 0))
    if label:
        rows.append((entity, "label", C.SYM, None, label, None, None, start, C.OPEN_VALID, 0))
    return rows


@pytest.fixture(scope="module")
def quakes(spark):
    session = Session(spark)
    registry.configure(session)
    sizes = [4.1, 6.8, 2.2, 5.5, 7.9, 3.0, 6.1, 4.7, 5.2, 3.8]
    rows = [r for i, m in enumerate(sizes) for r in quake(i, 60 + i / 1000, 24.9, m, NOW - 60 - 3600 * i, "north" if i % 2 else None)]
    rows += quake(20, -60.0, 100.0, float("nan"), NOW - 60) + quake(21, 60.5, 24.9, None, NOW - 60)
    assert session.ingest(spark.createDataFrame([*rows, (5, "magnitude", 200, 1.0, None, None, None, 0, 1, 0), (5, "magnitude", C.F64, 1.0, None, None, None, 7, 7, 0)], STAGED), NOW - 30) == (len(rows), 2)
    return session


def ask(session, text, **options):
    found = session.run_query(text, NOW, record=False, **options)
    assert found.ok, (found.error, found.decision)
    return [r["entity"] for r in found.rows.collect()]


def test_queries(quakes):
    assert ask(quakes, "quakes order by magnitude desc limit 3") == [20, 4, 1] or ask(quakes, "quakes where magnitude < 100 order by magnitude desc limit 3") == [4, 1, 6]
    assert len(ask(quakes, "quakes where magnitude > 0 since -4h")) == 4 and len(ask(quakes, "earthquakes where magnitude > 0 since -1h")) == 1
    assert len(ask(quakes, "quakes where magnitude > 0 since -100h")) == 10
    assert set(ask(quakes, "quakes where not magnitude > 3")) == {2, 5, 20, 21}
    assert ask(quakes, "quakes where magnitude != 5.5 and magnitude != 4.1 and not magnitude < 100") == [20]
    assert ask(quakes, "quakes where nothing != 1") == [] and ask(quakes, 'quakes where label ~ "ort" and magnitude > 6') == [1]
    assert ask(quakes, "quakes where label = region:north and magnitude > 6") == [1] and ask(quakes, "quakes where label > a") == []
    assert len(ask(quakes, "quakes in bbox(59, 24, 60.2, 25)")) == 10 and ask(quakes, "quakes in bbox(61, 24, 59, 25)") == []
    assert set(ask(quakes, "quakes within 150m of (60, 24.9)")) == {0, 1}
    assert ask(quakes, "quakes order by magnitude asc")[-1] == 21
    assert ask(quakes, "quakes as of -20d") == [] and ask(quakes, "quakes as of -0s @ -60s") == []
    assert ask(quakes, "quakes where magnitude > 7 as of -1d", override=(S.store_time(NOW), quakes.current_txn)) == [4]
    assert ask(quakes, "quakes within 150m of port:X", places={"port:X": (60.0, 24.9)}) == [0, 1]


def test_problems(quakes):
    for text, part in (("volcanoes", "no source is bound"), ("quakes order by nothing", "no fact has"), ("quakes within 5km of port:X", "no gazetteer entry"), ("quakes where", "name of an attribute")):
        found = quakes.run_query(text, NOW)
        assert not found.ok and part in found.error.message


def test_explain(quakes):
    found = quakes.run_query("quakes where magnitude > 4 within 200km of (60, 24.9) order by magnitude limit 5", NOW, record=False)
    told = json.loads(found.plan.explain())
    assert told["emittedRows"] == 5 and {r["op"] for r in told["rejected"]} | {n.op for n in found.plan.nodes()} >= {"SeqScan", "ZoneMapScan", "GeoRangeScan", "Filter", "Sort", "Limit"}
    assert told["root"]["op"] == "Limit" and told["root"]["children"][0]["op"] == "Sort"
    assert misestimate(100, 100) == ("exact", False) and misestimate(0, 0) == ("exact", False)
    assert misestimate(1000, 10)[1] and not misestimate(30, 10)[1] and misestimate(11, 0)[1]


@pytest.mark.parametrize("text", ["quakes in bbox(-30, 10, 20.5, 60)", "quakes within 900km of (10, 179)", "quakes within 700km of (89, 0)", "quakes where magnitude > 30 within 3000km of (-20, 5)", "quakes in bbox(20, 0, 10, 5)"])
def test_space_first_gives_the_same_rows_and_reaches_the_scan(spark, tmp_path_factory, text):
    folder = tmp_path_factory.getbasetemp() / "by-space"
    if not folder.exists():
        store.write_facts(fixtures.facts(spark, "/root/testdata/sf0.01"), str(folder), order="space", partitions=8)
    facts, query, binding = spark.read.parquet(str(folder)), parse(text).query, compiler.Binding("position", "magnitude")
    first, last = (compiler.entities(facts, query, binding, 760_000_000, 5000, 0, by_space=b) for b in (True, False))
    columns = ["entity", "fact_id", "scalar_value", "entity_first"]
    assert Counter(map(tuple, first.select(columns).collect())) == Counter(map(tuple, last.select(columns).collect()))
    if query.bbox is None or query.bbox[0] <= query.bbox[2]:
        pushed = [line for line in told(first) if line.startswith("PushedFilters")]
        assert any("morton" in line and "v_lat_e7" in line for line in pushed) and not any("morton" in line for line in told(last))


def told(df):
    """The lines of a plan with all details."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode).splitlines()


def test_the_plan_that_is_told_is_run(spark):
    session = Session(spark, cut_lineage(fixtures.facts(spark, "/root/testdata/sf0.001")), fixtures.txns(spark, "/root/testdata/sf0.001"))
    session.register_source("quakes", "position", "magnitude")
    small = session.run_query("quakes within 300km of (10, 15)", 760_000_000 + C.EPOCH_2000, (760_000_000, 5000), record=False, execute=False)
    whole = session.run_query("quakes where magnitude > 3", 760_000_000 + C.EPOCH_2000, (760_000_000, 5000), record=False, execute=False)
    assert small.plan.by_space and not whole.plan.by_space
    leaf = small.plan.nodes()[-1]
    assert leaf.op == "GeoRangeScan" and any("LeftSemi" in line for line in told(small.rows)) and not any("LeftSemi" in line for line in told(whole.rows))
    held = spatial.radius_filter(session.facts.where("attr = 'position'"), 10.0, 15.0, 300_000.0).count()
    assert held <= leaf.est_rows <= session.facts.count()


def test_layouts_bound_their_leading_column(spark, tmp_path):
    import pyarrow.parquet as pq

    facts = fixtures.facts(spark, "/root/testdata/sf0.01")
    for order, (column, _) in store.ORDERS.items():
        store.write_facts(facts, f"{tmp_path}/{order}", order=order, partitions=6)
        bounds = []
        for file in (tmp_path / order).glob("*.parquet"):
            held = pq.ParquetFile(file)
            index = held.schema_arrow.names.index(column)
            stats = [held.metadata.row_group(i).column(index).statistics for i in range(held.num_row_groups)]
            bounds += [(s.min, s.max) for s in stats if s.has_min_max]
        bounds.sort()
        assert len(bounds) > 1 and all(b <= c for (_, b), (c, _) in zip(bounds, bounds[1:], strict=False))
    by_entity = spark.read.parquet(f"{tmp_path}/entity")
    assert "EqualTo(entity,7)" in store.history(by_entity, 7)._jdf.queryExecution().executedPlan().toString()
    assert store.history(by_entity, 7).collect() == store.history(facts, 7).collect()


def test_nearest_by_growing_circles(spark):
    geo = fixtures.facts(spark, "/root/testdata/sf0.01").where("attr = 'position'").cache()
    for lat, lon, k in ((10.0, 15.0, 10), (89.9, 0.0, 3), (0.0, 179.9, 7), (0.0, 0.0, 20_000)):
        assert spatial.nearest(geo, lat, lon, k, reach_m=50_000.0).collect() == spatial.nearest(geo, lat, lon, k).collect()


def test_layers_are_summed(quakes):
    told = quakes.layers(S.store_time(NOW), quakes.current_txn)
    one = store.prune_counts(quakes.chunks, S.store_time(NOW), quakes.current_txn).first()
    kinds = len(set(quakes.bindings.values()))
    assert told["points"] == 12 and told["chunks_total"] == kinds * one["chunks_total"] and told["rows_scanned"] == kinds * one["rows_kept"] and told["query_ms"] > 0


def test_revisions_and_system_time(spark):
    session = Session(spark)
    session.register_source("quakes", "position", "magnitude")
    session.ingest(spark.createDataFrame(quake(1, 10, 10, 4.8, NOW - 100), STAGED), NOW - 90)
    session.retract([1, 77], NOW - 50)
    start = S.store_time(NOW - 100)
    session.ingest(spark.createDataFrame([(1, "magnitude", C.F64, 5.2, None, None, None, start, C.OPEN_VALID, 0)], STAGED), NOW - 40)
    at = S.store_time(NOW)
    scalars = [[round(r["scalar"], 1) for r in session.query_points(at, s, "position", "magnitude").collect()] for s in (0, 1, 2, 3)]
    assert scalars == [[], [4.8], [0.0], [5.2]]
    assert [r["v_f64"] for r in store.history(session.facts, 1).where("attr = 'magnitude'").collect()] == [4.8, 5.2]
    picked = session.inspect(10.0001, 10, 5000, at, 3, ("position",)).collect()
    assert [(r["attr"], r["is_now"]) for r in picked] == [("position", True), ("magnitude", False), ("magnitude", True)]
    assert session.inspect(50, 10, 5000, at, 3).count() == 0 and session.inspect(10, 10, 5000, at, 3, ("other",)).count() == 0
    # clocks never run backwards, and an empty batch commits nothing
    assert session.ingest(spark.createDataFrame([], STAGED), NOW) == (0, 0)
    session.ingest(spark.createDataFrame(quake(2, 0, 0, 1.0, NOW - 100), STAGED), NOW - 1000)
    walls = [r["wall_clock_unix"] for r in session.txns.orderBy("txn_id").collect()]
    assert walls == sorted(walls) and len(walls) == 4


def test_policy_matrix():
    wide, few = Request("a", 100), Request("a", 3)
    policy = Policy(sensitivity={"a": Sensitivity.PRECISE})
    assert policy.check(wide).allowed and policy.check(few).rule == "R1-individual-narrowing" and policy.check(Request("a", 0)).allowed
    assert "identifier" in policy.check(Request("a", 3, True, 100)).offending and "radius" in policy.check(Request("a", 3, False, 100)).offending
    assert policy.set_purpose("maritime-safety") and policy.check(few).allowed and not policy.set_purpose("fun") and policy.purpose == "maritime-safety"
    policy.sensitivity["a"] = Sensitivity.PERSON_LINKED
    assert policy.check(wide).rule == "R0-person-linked"
    policy.declare("b", Sensitivity.PRECISE, True)
    policy.declare("b", Sensitivity.PUBLIC)
    assert policy.sensitivity["b"] == Sensitivity.PRECISE and "b" in policy.identifying


def test_refusals_run_nothing_and_are_audited(spark):
    session = Session(spark)
    registry.configure(session)
    rows = [r for i in range(41) for r in quake(i, 60 + i / 100, 24.9, None, NOW - 60, prefix="vessel_")]
    session.ingest(spark.createDataFrame(rows, STAGED), NOW - 30)
    assert session.run_query("vessels", NOW).rows.count() == 41
    refused = session.run_query("vessels limit 3", NOW)
    assert not refused.ok and refused.rows is None and refused.decision.rule == "R1-individual-narrowing"
    assert not session.run_query("vessels within 400m of (60, 24.9)", NOW).ok
    session.policy.set_purpose("disaster-response")
    assert session.run_query("vessels limit 3", NOW, record=False).ok
    log = session.audit().collect()
    assert [(r["allowed"], r["rows"]) for r in log] == [(False, 0), (False, 0), (True, 41)]
    assert log[-1]["query"] == "vessels" and log[0]["purpose"] == "demonstration"
    assert session.audit(1).count() == 1


def payload(spark, *documents, fetched=NOW):
    return spark.createDataFrame([(json.dumps(d), fetched) for d in documents], "payload string, fetched_unix long")


def by_attr(records):
    return {(r["key"], r["attr"]): r for r in records.collect()}


def test_feeds(spark):
    f = by_attr(
        feeds.usgs(
            payload(spark, {"features": [{"id": "us1", "properties": {"mag": 4.5, "time": 1_700_000_000_000, "updated": 1_700_000_100_000, "place": None}, "geometry": {"coordinates": [142.5, 38.25]}}, {"id": "", "properties": {"time": 1}, "geometry": {"coordinates": [1, 2]}}, {"id": "us2", "properties": {"time": 1}, "geometry": {"coordinates": [1]}}]})
        )
    )
    assert set(f) == {("us1", a) for a in ("position", "magnitude", "depth", "label")}
    row = f["us1", "position"]
    assert (row["v_lat_e7"], row["v_lon_e7"], row["system_unix"], row["valid_from"], row["valid_to"]) == (382_500_000, 1_425_000_000, 1_700_000_100, 1_700_000_000 - C.EPOCH_2000, C.OPEN_VALID)
    assert f["us1", "label"]["v_str"] == "unknown" and f["us1", "depth"]["v_f64"] == 0
    f = by_attr(feeds.emsc(payload(spark, {"features": [{"properties": {"unid": "e1", "lat": 1, "lon": 2, "mag": 3, "time": "2024-01-01T00:00:00.5Z", "flynn_region": "SEA"}}, {"properties": {"lat": 1}}]})))
    assert f["emsc:e1", "region"]["v_str"] == "SEA" and f["emsc:e1", "position"]["system_unix"] == 1_704_067_200
    f = by_attr(feeds.digitraffic(payload(spark, {"features": [{"mmsi": 7, "geometry": {"coordinates": [24, 60]}, "properties": {"sog": 102.3, "timestampExternal": 5_000}}, {"mmsi": 8, "geometry": {"coordinates": [24, 60]}, "properties": {"sog": 9.5, "timestampExternal": 5_000}}, {"geometry": {"coordinates": [1, 2]}}]})))
    assert set(f) == {("mmsi:7", "vessel_position"), ("mmsi:8", "vessel_position"), ("mmsi:8", "speed")}
    f = by_attr(feeds.gdacs(payload(spark, {"features": [{"properties": {"eventtype": "TC", "eventid": 5, "episodeid": 2, "alertlevel": "Red", "eventname": "ANNA", "name": "Cyclone", "fromdate": "2024-01-01T00:00:00"}, "geometry": {"coordinates": [1, 2]}}]})))
    assert f["gdacs:TC:5:2", "alert_level"]["v_f64"] == 2 and f["gdacs:TC:5:2", "alert_label"]["v_str"] == "Cyclone (ANNA)" and f["gdacs:TC:5:2", "alert_position"]["system_unix"] == 1_704_067_200
    f = by_attr(feeds.eonet(payload(spark, {"events": [{"id": "E", "title": "Fire", "categories": [{"title": "Wildfires"}], "geometry": [{"type": "Point", "coordinates": [0, 0], "date": "2024-01-01T00:00:00Z"}, {"type": "Point", "coordinates": [3, 4], "date": "2024-01-02T00:00:00Z"}]}, {"id": "F", "geometry": [{"type": "Polygon", "coordinates": [1], "date": "2024-01-02T00:00:00Z"}]}]})))
    assert f["eonet:E", "event_label"]["v_str"] == "Wildfires — Fire" and f["eonet:E", "event_position"]["v_lat_e7"] == 40_000_000 and f["eonet:E", "event_intensity"]["system_unix"] == NOW and len(f) == 3
    planes = payload(spark, {"now": 2_000_000, "ac": [{"hex": "a1", "lat": 1, "lon": 2, "alt_baro": "ground", "seen_pos": 1.5, "flight": "RCH1 ", "t": "C17"}, {"hex": "a2", "lat": 1, "lon": 2, "alt_baro": 3000}, {"lat": 1, "lon": 2}]})
    f = by_attr(feeds.airplanes(planes))
    assert f["icao:a1", "aircraft_label"]["v_str"] == "RCH1 · C17" and f["icao:a1", "altitude"]["v_f64"] == 0 and f["icao:a2", "altitude"]["v_f64"] == 3000 and f["icao:a1", "altitude"]["system_unix"] == 1998 and len(f) == 5
    assert ("icao:a1", "civil_altitude") in by_attr(feeds.airplanes(planes, civil=True))
    assert feeds.viewport_radius_nm(100, 3) is None and feeds.viewport_radius_nm(100, 5) == 54 and feeds.viewport_radius_nm(9e9, 5) == 250
    f = by_attr(feeds.swpc(payload(spark, {"Observation Time": "2024-01-01T00:00:00Z", "Forecast Time": "2024-01-01T01:00:00Z", "coordinates": [[350, 60, 12], [10, 60, 9]]})))
    row = f["swpc:aurora:60:-10", "aurora_probability"]
    assert (row["valid_to"] - row["valid_from"], row["system_unix"], len(f)) == (1800, 1_704_067_200, 2)
    curated = payload(spark, {"authoredUnix": 5_000_000_000, "ports": [{"name": "P", "country": "X", "lat": 1, "lon": 2, "class": 2}, {"name": "Q", "lat": 95, "lon": 2}], "chokepoints": [{"name": "S", "lat": 1, "lon": 2}]})
    assert by_attr(feeds.curated(curated))["port:P", "port_label"]["v_str"] == "P — X" and set(by_attr(feeds.curated(curated, True))) == {("chokepoint:S", "chokepoint_position"), ("chokepoint:S", "chokepoint_label")}


def test_weather(spark):
    def alert(i, **more):
        return {"properties": {"id": i, "sent": "2024-01-01T00:00:00-05:00", "expires": "2024-01-01T09:00:00-05:00", "event": "Gale", "areaDesc": "Coast", "severity": "Severe", "geocode": {"UGC": ["Z1", "Z9"]}} | more, "geometry": None}

    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    documents = {"features": [alert("c", references=[{"identifier": "b"}]), alert("b", references=[{"identifier": "a"}]), alert("d", geocode={"UGC": ["Z9"]}), alert("e", expires=None), alert("f", expires="2023-01-01T00:00:00Z"), alert("g") | {"geometry": {"type": "Polygon", "coordinates": [ring]}}]}
    zones = spark.createDataFrame([("Z1", 10.0, 20.0)], "zone string, lat double, lon double")
    f = by_attr(feeds.nws(payload(spark, documents), zones))
    assert {k for k, _ in f} == {"nws:a:Z1", "nws:g:poly"}
    assert f["nws:g:poly", "weather_position"]["v_lon_e7"] == 20_000_000 and f["nws:a:Z1", "weather_label"]["v_str"] == "Gale — Coast" and f["nws:a:Z1", "weather_severity"]["v_f64"] == 3
    assert f["nws:a:Z1", "weather_position"]["system_unix"] == 1_704_085_200
    assert feeds.nws_unplaced(payload(spark, documents), zones).first()[0] == 1
    rings = spark.createDataFrame([("a", [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]]), ("a", [[9.0, 9.0], [9.1, 9.0], [9.0, 9.1]]), ("b", [[1.0, 1.0], [3.0, 3.0]])], "zone string, ring array<array<double>>")
    assert {r["zone"]: (r["lat"], r["lon"]) for r in feeds.zone_centroids(rings).collect()} == {"a": (1.0, 2.0), "b": (2.0, 2.0)}


def test_probes(spark):
    def ask(*rows):
        return spark.createDataFrame([(s, json.dumps(p) if p is not None else None, 1000) for s, p in rows], "subject string, payload string, asked_unix long")

    found = probes.dns(ask(("x.org", {"A": {"Answer": [{"data": "1.2.3.4", "TTL": 300}, {"data": "", "TTL": 5}]}, "MX": {"Answer": [{"data": "mx", "TTL": 60}]}}), ("y.org", {}))).orderBy("subject").collect()
    assert [(r["to_unix"], [f["value"] for f in r["fields"]]) for r in found] == [(1060, ["60s", "1.2.3.4", "mx"]), (1900, ["900s", "no records"])]
    found = probes.rdap(ask(("x.org", {"handle": "H", "entities": [{"roles": ["abuse"], "contact": [{"key": "email", "value": "a@x.org"}]}, {"roles": ["registrant"], "contact": [{"key": "fn", "value": "Ann"}, {"key": "tel", "value": "1"}]}]}))).first()
    assert "Ann" not in str(found) and "2 registrant" in str(found["fields"]) and found["fields"][1]["value"] == "a@x.org"
    countries = spark.createDataFrame([("FI", 64.0, 26.0)], "code string, lat double, lon double")
    placed = probes.asn(ask(("AS1", {"holder": "H", "attributes": [{"key": "country", "value": "zzz"}, {"key": "country", "value": "fi"}]}), ("AS2", {"holder": "H"})), countries)
    assert {(r["key"], r["attr"]) for r in probes.records(placed).collect()} == {("recon:asn:AS1", "recon_position"), ("recon:asn:AS1", "recon_label"), ("recon:asn:AS2", "recon_label")}
    found = probes.exposure(ask(("1.1.1.1", {"ports": [53, 80], "vulns": ["CVE-1"]}), ("2.2.2.2", None))).orderBy("subject").collect()
    assert found[0]["fields"][0]["value"] == "53, 80" and found[0]["fields"][-1]["warn"] and (found[0]["to_unix"], found[1]["to_unix"]) == (4600, 1900)
    document = {"cveMetadata": {"state": "PUBLISHED", "datePublished": "2021-12-10T00:00:00Z"}, "containers": {"cna": {"descriptions": [{"value": "bad"}], "metrics": [{}, {"cvssV3_1": {"baseScore": 10.0, "baseSeverity": "CRITICAL"}}]}}}
    found = probes.cve(ask((" cve-2021-44228", document), ("nope", document))).collect()
    assert len(found) == 1 and found[0]["subject"] == "CVE-2021-44228" and [f["warn"] for f in found[0]["fields"]] == [False, False, True, False, False]


def test_obligations(spark):
    used = spark.createDataFrame([(7,), (8,), (0,), (2,), (7,)], "source int")
    found = registry.obligations(used, registry.sources(spark)).first()
    assert found["attribution"].count("OpenStreetMap") == 1 and "Geological" not in found["attribution"]
    assert (found["share_alike"], found["non_commercial"]) == ("chokepoints; ports", "airplanes_live")


FEED = "source int, entity long, attr string, kind int, v_f64 double, valid_from int, valid_to int, system_unix long, seq long"


def test_cycles(spark, tmp_path):
    made = ingest.Ingestor(spark, f"{tmp_path}/store", fetch_time_sources=[4])
    one = [(0, 1, "m", C.F64, 1.0, 0, 9, 120, 0), (0, 1, "m", C.F64, 2.0, 0, 9, 130, 1), (0, 2, "m", C.F64, 1.0, 0, 9, 200, 2), (4, 3, "m", C.F64, 1.0, 0, 9, 200, 3), (0, 9, "m", 99, 1.0, 0, 9, 200, 4)]
    assert made.cycle(spark.createDataFrame(one, FEED), 0) == {"committed": 2, "facts": 3, "duplicates": 1, "clamped": 0}
    # the same payload again, later: nothing new, also where the system time is only the fetch
    again = [(*r[:7], 700 if r[0] == 4 else r[7], r[8]) for r in one]
    assert made.cycle(spark.createDataFrame(again, FEED), 1) == {"committed": 0, "facts": 0, "duplicates": 4, "clamped": 0}
    late = [(0, 1, "m", C.F64, 3.0, 0, 9, 60, 0), (0, 5, "m", C.F64, 3.0, 0, 9, 600, 1)]
    assert made.cycle(spark.createDataFrame(late, FEED), 2) == {"committed": 2, "facts": 2, "duplicates": 0, "clamped": 1}
    assert made.cycle(spark.createDataFrame(late, FEED), 2)["committed"] == 0
    assert [(r["txn_id"], r["wall_clock_unix"], r["fact_count"]) for r in made.txns.orderBy("txn_id").collect()] == [(1, 120, 1), (2, 180, 2), (3, 180, 1), (4, 600, 1)]
    facts = made.facts.orderBy("fact_id").collect()
    assert [(r["fact_id"], r["entity"], r["sys_from"], r["v_f64"]) for r in facts] == [(0, 1, 1, 1.0), (1, 2, 2, 1.0), (2, 3, 2, 1.0), (3, 1, 3, 3.0), (4, 5, 4, 3.0)]


def test_records_that_arrive_at_once_are_committed_once(spark, tmp_path):
    rows = [(0, 1, "m", C.F64, v, 0, 9, 120, seq) for v, seq in ((7.0, 5), (3.0, 2), (2.0, 2), (2.0, 2), (1.0, None))] + [(0, None, "m", C.F64, 4.0, 0, 9, 120, None)] * 2
    made = ingest.Ingestor(spark, f"{tmp_path}/store")
    assert made.cycle(spark.createDataFrame(rows, FEED), 0) == {"committed": 1, "facts": 2, "duplicates": 5, "clamped": 0}
    assert sorted((r["v_f64"], r["entity"]) for r in made.facts.collect()) == [(2.0, 1), (4.0, None)]
    assert made.cycle(spark.createDataFrame(rows, FEED), 1)["facts"] == 0


def test_compaction_changes_no_row(spark, tmp_path, monkeypatch):
    made = ingest.Ingestor(spark, f"{tmp_path}/store")
    cycle = lambda k: spark.createDataFrame([(0, i, "m", C.F64, float(k), k, 99, 6000 + 60 * k, i) for i in range(5)], FEED)
    for k in range(3):
        made.cycle(cycle(k), k)
    before, files = made.facts.orderBy("fact_id").collect(), made.files()
    assert made.compact() == 1 and made.files() < files and made.facts.orderBy("fact_id").collect() == before
    assert made.cycle(cycle(1), 9)["duplicates"] == 5 and made.cycle(cycle(3), 3)["facts"] == 5
    assert made.compact() == 2 and made.compact() == 3 and made.facts.count() == 20 and made.identities.count() == 20
    assert not (tmp_path / "store" / "facts").exists() and (tmp_path / "store" / "facts-2").exists()
    monkeypatch.setattr(ingest, "COMPACT_FILES", 0)
    made.cycle(cycle(4), 4)
    assert made._generations()[-1] == 4 and made.facts.count() == 25


def test_clamping_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ingest, "CLAMP_RANGE", 7)
    walls = [(i * 3, (i * 37) % 101) for i in range(120)]
    found = {r["seq"]: r["clamped_wall"] for r in ingest.clamp(spark.createDataFrame(walls, "seq long, wall_clock_unix long"), 5).collect()}
    assert found == {s: max(5, *(w for t, w in walls if t <= s)) for s, _ in walls}


def test_streams_equal_batches(spark, tmp_path):
    rows = [(0, i % 5, "m", C.F64, float(i), i // 10, 99, 6000 + 60 * i, i) for i in range(40)] * 2
    frame = spark.createDataFrame(rows, FEED)
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    made = ingest.Ingestor(spark, f"{tmp_path}/streamed")
    made.follow(stream, f"{tmp_path}/checkpoint").awaitTermination()
    other = ingest.Ingestor(spark, f"{tmp_path}/batched")
    other.cycle(frame, 0)
    order = ["sys_from", "entity", "v_f64"]
    assert [tuple(r) for r in made.facts.select(*order).orderBy(*order).collect()] == [tuple(r) for r in other.facts.select(*order).orderBy(*order).collect()]
    counted = ingest.windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert spark.table("counted").agg(F.sum("n")).first()[0] == 80
    unique = ingest.deduplicated(stream).writeStream.format("memory").queryName("singles").trigger(availableNow=True).start()
    unique.awaitTermination()
    assert spark.table("singles").count() == 40


def test_polling(spark):
    rows = [("usgs", 120, None, False), ("emsc", None, 5, False), ("civil", 20, 100, True), ("nws", 300, 100, False)]
    sources = spark.createDataFrame(rows, "key string, poll_seconds long, last_unix long, needs_viewport boolean")
    assert {r["key"] for r in ingest.due(sources, 130).collect()} == {"usgs", "civil"}
    assert {r["key"] for r in ingest.due(sources, 400, viewport=False).collect()} == {"usgs", "nws"}


def test_rendering(spark):
    staged = [(1, "a", k, k == C.BOOL, 5, 1.5, "x", 10_000_000, -20_000_000, 0, 9, 0, 10, 3) for k in range(8)]
    schema = "entity long, attr string, kind int, v_bool boolean, v_i64 long, v_f64 double, v_str string, v_lat_e7 int, v_lon_e7 int, v_time int, v_ref long, valid_from int, valid_to int, source int"
    facts = store.as_facts(spark.createDataFrame(staged, schema), F.lit(2), F.col("kind"))
    told = [json.loads(r["json"]) for r in store.rendered(facts).orderBy("fact_id").collect()]
    assert [d.get("value") for d in told] == [None, "true", "5", "1.5", "x", "1.0,-2.0", "946684800", "9"]
    assert told[4]["kind"] == "sym" and told[4]["validTo"] == 946684810 and "sysTo" not in told[4]
