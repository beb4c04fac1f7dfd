"""Two-line element sets to satellite positions.

Positions of satellites that go round in under 225 minutes come from the analytic theory that
these sets are made for (SGP4, Spacetrack Report No. 3, 1980): secular drift by the Earth's
zonal harmonics and drag, then long and short periodic terms. Higher ones, for which that
report adds the pull of Moon and Sun and resonances, get Kepler's equation with the secular
drift by flattening alone: over the minutes around an epoch that stays within some kilometres.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.feeds import unpivot

# WGS-72 constants of element sets.
MU_KM3, RADIUS_KM, J2, FLATTENING = 398_600.8, 6378.135, 0.001082616, 1 / 298.26
# Fixed values of the theory, in Earth radii and minutes.
KE, K2, K4, A3 = 0.0743669161, 5.413080e-4, 0.62098875e-6, 0.253881e-5
DRAG_TOP_KM, DRAG_LOW_KM, SIMPLE_BELOW_KM = 120.0, 78.0, 220.0
DEEP_MINUTES = 225.0
YEAR_PIVOT = 57
HALF_WINDOW_SECONDS = 150
LOWEST_KM, HIGHEST_KM = 80.0, 60_000.0


def elements(payloads: DataFrame) -> DataFrame:
    """One row per satellite from texts of three-line sets: a name, then lines 1 and 2.

    Sets whose lines don't belong together are dropped; of one satellite the first set stays.
    """
    lines = F.filter(F.split("payload", r"\r?\n"), lambda x: F.length(F.trim(x)) > 0)
    rows = payloads.select("fetched_unix", lines.alias("ls"))
    rows = rows.select("fetched_unix", "ls", F.posexplode("ls").alias("at", "name"))
    rows = rows.withColumns({"one": F.get("ls", F.col("at") + 1), "two": F.get("ls", F.col("at") + 2)}).drop("ls")
    fine = F.col("one").startswith("1 ") & F.col("two").startswith("2 ") & (F.substring("one", 3, 5) == F.substring("two", 3, 5))
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    field = lambda line, start, stop: F.trim(F.substring(line, start, stop - start + 1)).try_cast("double")
    year = field("one", 19, 20)
    drag = F.concat(F.trim(F.substring("one", 54, 1)), F.lit("0."), F.trim(F.substring("one", 55, 5)), F.lit("e"), F.trim(F.substring("one", 60, 2)))
    parsed = rows.select(
        "fetched_unix", "at", F.trim("name").alias("name"), F.trim(F.substring("one", 3, 5)).alias("number"), epoch_unix(year, field("one", 21, 32)).alias("epoch_unix"),
        field("two", 9, 16).alias("inclination"), field("two", 18, 25).alias("node"), F.concat(F.lit("0."), F.trim(F.substring("two", 27, 7))).try_cast("double").alias("eccentricity"),
        field("two", 35, 42).alias("perigee"), field("two", 44, 51).alias("anomaly"), field("two", 53, 63).alias("motion"), drag.try_cast("double").alias("drag"),
    )
    first = F.min_by(F.struct(*[c for c in parsed.columns if c != "number"]), F.struct("fetched_unix", "at"))
    return parsed.na.drop().groupBy("number").agg(first.alias("e")).select("number", "e.*").drop("at")


def epoch_unix(year: Column, day: Column) -> Column:
    """Unix seconds of a two-digit year (from 57 on: the last century) and a day with its fraction, counted from 1."""
    full = F.when(year < YEAR_PIVOT, year + 2000).otherwise(year + 1900).cast("int")
    return F.unix_date(F.make_date(full, F.lit(1), F.lit(1))) * 86_400 + (day - 1) * 86_400


def _kepler(mean: np.ndarray, ecc: np.ndarray) -> np.ndarray:
    big = mean.copy()
    for _ in range(15):
        big = big - (big - ecc * np.sin(big) - mean) / (1 - ecc * np.cos(big))
    return big


def _turned(r: np.ndarray, u: np.ndarray, node: np.ndarray, inclination: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inertial coordinates of a place at distance ``r`` and argument ``u`` in its plane."""
    across = np.sin(u) * np.cos(inclination)
    x = r * (np.cos(node) * np.cos(u) - np.sin(node) * across)
    y = r * (np.sin(node) * np.cos(u) + np.cos(node) * across)
    return x, y, r * np.sin(u) * np.sin(inclination)


def _drifting(inclination, node, perigee, anomaly, ecc, n, minutes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kilometres by Kepler's equation and the secular drift by flattening; ``n`` in radians a minute."""
    n, t = n / 60, minutes * 60
    a = np.cbrt(MU_KM3 / n**2)
    drift = 1.5 * J2 * (RADIUS_KM / (a * (1 - ecc**2))) ** 2 * n
    node = node - drift * np.cos(inclination) * t
    perigee = perigee + drift * (2 - 2.5 * np.sin(inclination) ** 2) * t
    big = _kepler(anomaly + (n + drift * np.sqrt(1 - ecc**2) * (1 - 1.5 * np.sin(inclination) ** 2)) * t, ecc)
    true = 2 * np.arctan2(np.sqrt(1 + ecc) * np.sin(big / 2), np.sqrt(1 - ecc) * np.cos(big / 2))
    return _turned(a * (1 - ecc * np.cos(big)), true + perigee, node, inclination)


def _near_earth(inclination, node, perigee, anomaly, ecc, n, minutes, drag) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kilometres by the theory for low satellites; ``n`` in radians a minute."""
    cos_i, sin_i = np.cos(inclination), np.sin(inclination)
    c2i = cos_i**2
    b2 = 1 - ecc**2
    b = np.sqrt(b2)
    # mean motion and axis as the theory means them
    first = (KE / n) ** (2 / 3)
    flat = 1.5 * K2 * (3 * c2i - 1) / (b * b2)
    d1 = flat / first**2
    axis = first * (1 - d1 * (1 / 3 + d1 * (1 + 134 / 81 * d1)))
    d0 = flat / axis**2
    n0, a0 = n / (1 + d0), axis / (1 - d0)
    # drag: the height of the atmosphere's model goes with a low perigee
    height = (a0 * (1 - ecc) - 1) * RADIUS_KM
    low = np.where(height < 98, 20.0, np.where(height < 156, height - DRAG_LOW_KM, DRAG_LOW_KM))
    q = ((DRAG_TOP_KM - low) / RADIUS_KM) ** 4
    s = low / RADIUS_KM + 1
    xi = 1 / (a0 - s)
    eta = a0 * ecc * xi
    ee, e2 = ecc * eta, eta**2
    psi = np.abs(1 - e2)
    c = q * xi**4
    c1_ = c / psi**3.5
    swell = a0 * (1 + 1.5 * e2 + ee * (4 + e2)) + 0.75 * K2 * xi / psi * (3 * c2i - 1) * (8 + 3 * e2 * (8 + e2))
    c1 = drag * c1_ * n0 * swell
    round_ = ecc < 1e-4
    safe = np.where(round_, 1.0, ecc)
    c3 = np.where(round_, 0.0, c * xi * A3 / K2 * n0 * sin_i / safe)
    bulge = 3 * (1 - 3 * c2i) * (1 + 1.5 * e2 - 2 * ee - 0.5 * ee * e2) + 0.75 * (1 - c2i) * (2 * e2 - ee - ee * e2) * np.cos(2 * perigee)
    c4 = 2 * n0 * c1_ * a0 * b2 * (eta * (2 + 0.5 * e2) + ecc * (0.5 + 2 * e2) - 2 * K2 * xi / (a0 * psi) * bulge)
    c5 = 2 * c1_ * a0 * b2 * (1 + 2.75 * (e2 + ee) + ee * e2)
    # secular rates
    p = 1 / (a0 * b2) ** 2
    t1 = 3 * K2 * p * n0
    t2 = t1 * K2 * p
    t3 = 1.25 * K4 * p**2 * n0
    rate_m = n0 + 0.5 * t1 * b * (3 * c2i - 1) + 0.0625 * t2 * b * (13 - 78 * c2i + 137 * c2i**2)
    rate_w = -0.5 * t1 * (1 - 5 * c2i) + 0.0625 * t2 * (7 - 114 * c2i + 395 * c2i**2) + t3 * (3 - 36 * c2i + 49 * c2i**2)
    rate_h = -t1 * cos_i
    rate_o = rate_h + (0.5 * t2 * (4 - 19 * c2i) + 2 * t3 * (3 - 7 * c2i)) * cos_i
    t = minutes
    mean, arg = anomaly + rate_m * t, perigee + rate_w * t
    rise = node + rate_o * t + 3.5 * b2 * rate_h * c1 * t**2
    shrink, less, ahead = 1 - c1 * t, drag * c4 * t, 1.5 * c1 * t**2
    # terms that very low perigees go without
    whole = a0 * (1 - ecc) >= SIMPLE_BELOW_KM / RADIUS_KM + 1
    late = np.where(round_, 0.0, -2 / 3 * c * drag / np.where(round_, 1.0, ee)) * ((1 + eta * np.cos(mean)) ** 3 - (1 + eta * np.cos(anomaly)) ** 3)
    shift = np.where(whole, drag * c3 * np.cos(perigee) * t + late, 0.0)
    mean, arg = mean + shift, arg - shift
    f2 = 4 * a0 * xi * c1**2
    f3 = (17 * a0 + s) * f2 * xi * c1 / 3
    f4 = 0.5 * f2 * xi * c1 / 3 * a0 * xi * (221 * a0 + 31 * s) * c1
    shrink = np.where(whole, shrink - f2 * t**2 - f3 * t**3 - f4 * t**4, shrink)
    less = np.where(whole, less + drag * c5 * (np.sin(mean) - np.sin(anomaly)), less)
    g3, g4 = f2 + 2 * c1**2, 0.25 * (3 * f3 + c1 * (12 * f2 + 10 * c1**2))
    g5 = 0.2 * (3 * f4 + 12 * c1 * f3 + 6 * f2**2 + 15 * c1**2 * (2 * f2 + c1**2))
    ahead = np.where(whole, ahead + g3 * t**3 + t**4 * (g4 + t * g5), ahead)
    a, e = a0 * shrink**2, np.clip(ecc - less, 1e-6, 0.999999)
    along = mean + arg + rise + n0 * ahead
    # long periodic terms
    ax = e * np.cos(arg)
    over = 1 / (a * (1 - e**2))
    ay = e * np.sin(arg) + over * 0.25 * A3 / K2 * sin_i
    along = along + over * 0.125 * A3 / K2 * sin_i * (3 + 5 * cos_i) / np.where(np.abs(1 + cos_i) < 1e-12, 1e-12, 1 + cos_i) * ax
    u0 = np.remainder(along - rise, 2 * np.pi)
    w = u0.copy()
    for _ in range(15):
        w = w + (u0 - ay * np.cos(w) + ax * np.sin(w) - w) / (1 - ax * np.cos(w) - ay * np.sin(w))
    cos_e, sin_e = ax * np.cos(w) + ay * np.sin(w), ax * np.sin(w) - ay * np.cos(w)
    l2 = 1 - ax**2 - ay**2
    r, pl, bl = a * (1 - cos_e), a * l2, np.sqrt(l2)
    u = np.arctan2(np.sin(w) - ay - ax * sin_e / (1 + bl), np.cos(w) - ax + ay * sin_e / (1 + bl))
    # short periodic terms
    k1, k2 = K2 / pl, K2 / pl**2
    r = r * (1 - 1.5 * k2 * bl * (3 * c2i - 1)) + 0.5 * k1 * (1 - c2i) * np.cos(2 * u)
    rise = rise + 1.5 * k2 * cos_i * np.sin(2 * u)
    tilt = inclination + 1.5 * k2 * cos_i * sin_i * np.cos(2 * u)
    return _turned(r * RADIUS_KM, u - 0.25 * k2 * (7 * c2i - 1) * np.sin(2 * u), rise, tilt)


def _inertial(e: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    angles = [np.radians(e[c].to_numpy()) for c in ("inclination", "node", "perigee", "anomaly")]
    ecc, n = e["eccentricity"].to_numpy(), e["motion"].to_numpy() * 2 * np.pi / 1440
    minutes = (e["at_unix"].to_numpy() - e["epoch_unix"].to_numpy()) / 60
    low = 2 * np.pi / n < DEEP_MINUTES
    near = _near_earth(*angles, ecc, n, minutes, e["drag"].to_numpy())
    return tuple(np.where(low, x, y) for x, y in zip(near, _drifting(*angles, ecc, n, minutes), strict=True))


def _propagate(e: pd.DataFrame) -> pd.DataFrame:
    with np.errstate(all="ignore"):
        x, y, z = _inertial(e)
        days = e["at_unix"].to_numpy() / 86_400 + 2_440_587.5 - 2_451_545.0
        turn = np.radians(280.46061837 + 360.98564736629 * days)
        lon = np.degrees(np.arctan2(y, x) - turn)
        flat = np.hypot(x, y)
        squared = FLATTENING * (2 - FLATTENING)
        lat = np.arctan2(z, flat)
        for _ in range(6):
            across = RADIUS_KM / np.sqrt(1 - squared * np.sin(lat) ** 2)
            lat = np.arctan2(z + across * squared * np.sin(lat), flat)
        height = np.where(np.abs(np.cos(lat)) > 1e-6, flat / np.cos(lat) - across, np.abs(z) - RADIUS_KM * (1 - FLATTENING))
    return pd.DataFrame({"lat": np.degrees(lat), "lon": (lon + 180) % 360 - 180, "altitude": height})


def _positions(batches):
    for e in batches:
        yield pd.concat([e.reset_index(drop=True), _propagate(e)], axis=1)


def celestrak(payloads: DataFrame, at_unix: int) -> DataFrame:
    """Records of the satellites' places at an instant, valid for some minutes around it; known since the set's epoch."""
    rows = elements(payloads).withColumn("at_unix", F.lit(at_unix).cast("long"))
    schema = rows.select("*").schema  # a copy: add() changes it in place
    for name in ("lat", "lon", "altitude"):
        schema = schema.add(name, "double")
    placed = rows.mapInPandas(_positions, schema).where(F.col("altitude").between(LOWEST_KM, HIGHEST_KM))
    placed = placed.withColumns(
        {
            "key": F.concat(F.lit("sat:"), "number"), "from_unix": F.col("at_unix") - HALF_WINDOW_SECONDS, "to_unix": F.col("at_unix") + HALF_WINDOW_SECONDS,
            "system_unix": F.floor("epoch_unix"),
        }
    )
    return unpivot(placed, "celestrak", "satellite_position", {"satellite_altitude": "altitude"}, {"satellite_label": "name"})
