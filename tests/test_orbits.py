from __future__ import annotations

import pandas as pd
import pytest

from factloom.sources import orbits

# A low orbit and a geostationary one, in the usual columns.
SETS = """STATION
1 25544U 98067A   24001.50000000  .00016717  00000-0  10270-3 0  9000
2 25544  51.6400 100.0000 0005000  30.0000 330.0000 15.50000000000010
STATION AGAIN
1 25544U 98067A   24001.60000000  .00016717  00000-0  10270-3 0  9000
2 25544  51.6400 100.0000 0005000  30.0000 330.0000 15.50000000000010
STILL
1 40000U 98067A   99365.00000000  .00000000  00000-0  00000-0 0  9000
2 40000   0.0100   0.0000 0001000   0.0000   0.0000  1.00273790000010
BROKEN
1 40001U
2 40002
"""


def test_elements_and_records(spark):
    payloads = spark.createDataFrame([(SETS, 5)], "payload string, fetched_unix long")
    found = {r["number"]: r for r in orbits.elements(payloads).collect()}
    assert set(found) == {"25544", "40000"} and found["25544"]["name"] == "STATION"
    assert found["25544"]["epoch_unix"] == 1_704_110_400 and found["40000"]["epoch_unix"] == 946_598_400
    assert found["25544"]["eccentricity"] == pytest.approx(0.0005) and found["25544"]["drag"] == pytest.approx(0.1027e-3) and found["40000"]["drag"] == 0
    rows = orbits.celestrak(payloads, 1_704_110_400).collect()
    assert {(r["key"], r["attr"]) for r in rows} >= {("sat:25544", a) for a in ("satellite_position", "satellite_altitude", "satellite_label")}
    assert all(r["valid_to"] - r["valid_from"] == 300 for r in rows)


# The report's test case for low satellites, minutes since the epoch and kilometres.
REPORT = {"inclination": 72.8435, "node": 115.9689, "eccentricity": 0.0086731, "perigee": 52.6988, "anomaly": 110.5714, "motion": 16.05824518, "drag": 0.66816e-4, "epoch_unix": 0.0}
PLACES = {
    0: (2328.97048951, -5995.22076416, 1719.97067261), 360: (2456.10705566, -6071.93853760, 1222.89727783), 720: (2567.56195068, -6112.50384522, 713.96397400),
    1080: (2663.09078980, -6115.48229980, 196.39640427), 1440: (2742.55133057, -6079.67144775, -326.38095856),
}


def test_the_report_s_case():
    found = zip(*orbits._inertial(pd.DataFrame([REPORT | {"at_unix": 60.0 * t} for t in PLACES])), strict=True)
    for place, expected in zip(found, PLACES.values(), strict=True):
        assert place == pytest.approx(expected, abs=0.05)


def test_a_low_orbit():
    step = {"inclination": 51.64, "node": 100.0, "eccentricity": 0.0005, "perigee": 30.0, "anomaly": 330.0, "motion": 15.5, "drag": 0.0, "epoch_unix": 1_704_110_400.0}
    path = orbits._propagate(pd.DataFrame([step | {"at_unix": 1_704_110_400 + 60 * i} for i in range(93)]))
    assert path["altitude"].between(400, 450).all()
    assert path["lat"].max() == pytest.approx(51.8, abs=0.3) and path["lat"].min() == pytest.approx(-51.8, abs=0.3)
    assert path["lat"][0] == pytest.approx(0, abs=0.2)  # perigee and anomaly meet at the node, but for periodic terms


def test_a_geostationary_orbit_stays():
    still = {"inclination": 0.01, "node": 0.0, "eccentricity": 0.0001, "perigee": 0.0, "anomaly": 0.0, "motion": 1.0027379, "drag": 0.0, "epoch_unix": 1_704_110_400.0}
    path = orbits._propagate(pd.DataFrame([still | {"at_unix": 1_704_110_400 + 3600 * i} for i in range(24)]))
    assert path["altitude"].between(35_700, 35_860).all() and path["lon"].max() - path["lon"].min() < 0.5
