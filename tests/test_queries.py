"""Every registered query of the engine against its SQL."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from factloom import queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    found = queries.queries()[name](spark, SF)
    rows = found.collect()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    assert Counter(tuple(str(r[c]) for c in names) for r in rows) == Counter(tuple(map(str, r)) for r in result.fetchall())


ODD_EVENTS = {
    "repeated": "SELECT e.* FROM events e, range(3)",
    "repeated in part": "SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 7 = 0",
    "nulls": """SELECT CASE WHEN event_id % 11 <> 7 THEN event_id END AS event_id, CASE WHEN event_id % 13 <> 7 THEN ts END AS ts, CASE WHEN event_id % 5 <> 2 THEN user_id END AS user_id,
        CASE WHEN event_id % 3 <> 1 THEN event_type END AS event_type, value, props FROM events""",
    "before 1970": "SELECT * REPLACE (ts - INTERVAL 64 YEAR AS ts) FROM events",
    "around 1970": "SELECT * REPLACE (ts - INTERVAL 54 YEAR - INTERVAL 9 DAY AS ts) FROM events",
    "shifted": "SELECT * REPLACE (event_id + k * 1000 AS event_id, user_id + k * 15 AS user_id) FROM events, range(6) t(k)",
    "none": "SELECT * FROM events WHERE false",
}


@pytest.mark.parametrize("name", ODD_EVENTS)
def test_duplicate_guard_on_odd_events(spark, duck, tmp_path, name):
    columns = "event_id, ts, user_id, event_type, value, props"
    duck.execute(f"COPY (SELECT {columns} FROM ({ODD_EVENTS[name]})) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    expected = con.execute(queries.oracle_sql()["dup_guard"]).fetchall()
    assert name == "none" or expected
    found = queries.queries()["dup_guard"](spark, str(tmp_path)).select("seq", "bucket").collect()
    assert Counter(map(tuple, found)) == Counter(expected)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
