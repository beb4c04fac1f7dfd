"""Column expressions shared by the operators; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_2000 = 946_684_800
TIME_MIN, TIME_MAX = -2_147_483_647, 2_147_483_647
OPEN_VALID, OPEN_SYSTEM = TIME_MAX, 4_294_967_295
KINDS = ("null", "bool", "i64", "f64", "sym", "geo", "time", "ref")
NULL, BOOL, I64, F64, SYM, GEO, TIME, REF = range(8)
EARTH_RADIUS_M = 6_371_008.8
CHUNK_BITS = 13
METRES = {"km": 1000.0, "m": 1.0, "nm": 1852.0}


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def from_unix(seconds: Column) -> Column:
    """Unix seconds to store time (seconds since 2000), saturating."""
    return clamp(seconds.cast("long") - EPOCH_2000, TIME_MIN, TIME_MAX).cast("int")


def to_unix(stored: Column) -> Column:
    return stored.cast("long") + EPOCH_2000


def visible(valid_at: int | Column, sys_at: int | Column) -> Column:
    """The one definition of what (valid time, transaction) sees, on half-open intervals."""
    valid = F.lit(valid_at) if isinstance(valid_at, int) else valid_at
    system = F.lit(sys_at) if isinstance(sys_at, int) else sys_at
    return (F.col("sys_from") <= system) & (F.col("sys_to") > system) & (F.col("valid_from") <= valid) & (F.col("valid_to") > valid)


def number(prefix: str = "") -> Column:
    """A fact's value as a double; null for kinds without one."""
    c = lambda name: F.col(prefix + name)
    return (
        F.when(c("kind") == F64, c("v_f64"))
        .when(c("kind") == I64, c("v_i64").cast("double"))
        .when(c("kind") == TIME, c("v_time").cast("double"))
        .when(c("kind") == BOOL, c("v_bool").cast("double"))
    )


def lat_e7(degrees: Column) -> Column:
    """Latitude clamped to the poles, as 1e-7 degrees rounded half away from zero."""
    return F.round(clamp(degrees, -90.0, 90.0) * 1e7).cast("int")


def lon_e7(degrees: Column) -> Column:
    """Longitude wrapped into [-180, 180], as 1e-7 degrees rounded half away from zero."""
    wrapped = F.when((degrees >= -180) & (degrees <= 180), degrees).otherwise(F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0)
    return F.round(wrapped * 1e7).cast("int")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) * 0.5), F.sin(F.radians(lon2 - lon1) * 0.5)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2.0 * EARTH_RADIUS_M)


# The masks that spread 32 bits over the even bits of 64.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
LAT_BIAS, LON_BIAS = 900_000_000, 1_800_000_000


def _spread(value: Column) -> Column:
    for shift, mask in SPREAD:
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def _compact(value: Column) -> Column:
    value = value.bitwiseAND(F.lit(SPREAD[-1][1]))
    masks = [m for _, m in SPREAD[:-1]][::-1] + [0xFFFFFFFF]
    for (shift, _), mask in zip(SPREAD[::-1], masks, strict=True):
        value = value.bitwiseOR(F.shiftrightunsigned(value, shift)).bitwiseAND(F.lit(mask))
    return value


def morton(lat: Column, lon: Column) -> Column:
    """Z-order key of a position in 1e-7 degrees: latitude on the odd bits, longitude on the even ones."""
    return F.shiftleft(_spread(lat.cast("long") + LAT_BIAS), 1).bitwiseOR(_spread(lon.cast("long") + LON_BIAS))


def morton_lat_e7(key: Column) -> Column:
    return (_compact(F.shiftrightunsigned(key, 1)) - LAT_BIAS).cast("int")


def morton_lon_e7(key: Column) -> Column:
    return (_compact(key) - LON_BIAS).cast("int")


def in_ranges(key: Column, ranges: list[tuple[int, int]]) -> Column:
    """The key lies in one of the ranges; as comparisons, so that row groups of a sorted table are skipped."""
    test = F.lit(False)
    for low, high in ranges:
        test = test | key.between(F.lit(low), F.lit(high))
    return test
