"""Scalar functions that run on the driver, and the one string similarity that needs Python."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.columns import EARTH_RADIUS_M, EPOCH_2000, LAT_BIAS, LON_BIAS, TIME_MAX, TIME_MIN

# Seconds of a time unit.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}
MAX_AMOUNT = 1e12
_ISO = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2}):(\d{2}))?", re.ASCII)


def saturate(seconds: float) -> int:
    return int(max(TIME_MIN, min(TIME_MAX, seconds)))


def store_time(unix: float) -> int:
    """Unix seconds to store time."""
    return saturate(unix - EPOCH_2000)


def unix_time(stored: int) -> int:
    return stored + EPOCH_2000


def days_from_civil(year: int, month: int, day: int) -> int:
    """Days since 1970 in the proleptic calendar; a day beyond the month's end runs into the next."""
    if month <= 2:
        year -= 1
    era_year = year % 400
    day_of_year = (153 * ((month + 9) % 12) + 2) // 5 + day - 1
    return year // 400 * 146_097 + era_year * 365 + era_year // 4 - era_year // 100 + day_of_year - 719_468


def parse_iso(text: str) -> int | None:
    """Unix seconds of a date or date and time; what follows (zone, fraction) is not read."""
    found = _ISO.match(text)
    if not found:
        return None
    year, month, day, hour, minute, second = (int(x or 0) for x in found.groups())
    if not (1 <= month <= 12 and 1 <= day <= 31 and hour <= 23 and minute <= 59 and second <= 60):
        return None
    return days_from_civil(year, month, day) * 86_400 + hour * 3600 + minute * 60 + second


def six_digits(value: float) -> str:
    return f"{value:.6g}"


def haversine_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    half_lat, half_lon = math.sin(math.radians(lat2 - lat1) * 0.5), math.sin(math.radians(lon2 - lon1) * 0.5)
    a = half_lat**2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * half_lon**2
    return 2.0 * EARTH_RADIUS_M * math.asin(math.sqrt(min(a, 1.0)))


def round_half_away(value: float) -> int:
    return int(math.floor(abs(value) + 0.5)) * (1 if value >= 0 else -1)


def interleave(lat: int, lon: int) -> int:
    """Z-order key of biased 32-bit coordinates."""
    return sum(((lat >> i & 1) << (2 * i + 1)) | ((lon >> i & 1) << (2 * i)) for i in range(32))


def biased(degrees: float, latitude: bool) -> int:
    """A box corner in biased 1e-7 degrees, clamped (never wrapped)."""
    bound, bias = (90.0, LAT_BIAS) if latitude else (180.0, LON_BIAS)
    return round_half_away(max(-bound, min(bound, degrees)) * 1e7) + bias


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity over UTF-8 bytes; the prefix bonus (up to 4 bytes, 0.1 each) is always given."""
    x, y = a.encode(), b.encode()
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    reach = max(0, max(len(x), len(y)) // 2 - 1)
    taken = [False] * len(y)
    left = []
    for i, c in enumerate(x):
        for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
            if not taken[j] and y[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, used in zip(y, taken, strict=True) if used]
    swapped = sum(p != q for p, q in zip(left, right, strict=True)) / 2
    m = len(left)
    jaro = (m / len(x) + m / len(y) + (m - swapped) / m) / 3
    prefix = 0
    while prefix < min(4, len(x), len(y)) and x[prefix] == y[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def jaro_winkler_column(a: str, b: str) -> Column:
    return F.pandas_udf(_similarities, "double")(a, b)
