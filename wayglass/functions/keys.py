"""Key normalisation, calendar and spherical functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: Holidays of 2024.
HOLIDAYS = ("2024-01-01", "2024-01-15", "2024-02-19", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-10-14", "2024-11-11", "2024-11-28", "2024-12-25")


def road_key(c: Column) -> Column:
    """Stripped; an integral number in canonical form."""
    t = F.trim(c)
    x = t.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x == F.floor(x)), x.cast("bigint").cast("string")).otherwise(t)


def direction_key(c: Column) -> Column:
    return F.upper(F.trim(c))


def squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "(?U)\\s+", " ")


def period(hour: Column) -> Column:
    return F.when((hour < 6) | (hour >= 20), "night").when(hour < 10, "morning_peak").when(hour < 16, "midday").otherwise("evening_peak")


def is_holiday(day: Column, holidays: tuple[str, ...] = HOLIDAYS) -> Column:
    """Whether the day is one of the holidays, which are a parameter: the default knows one year."""
    return F.date_format(day, "yyyy-MM-dd").isin(*holidays)


def round_half_even(x: Column, digits: int = 2) -> Column:
    """Rounding of the binary value, ties to even: 2.675 is below its name and gives 2.67. (Spark's round goes by the shortest decimal name.)

    x * 10^digits is taken exactly, as a double and the error of that product; the error breaks what looks like a tie.
    """
    k = float(10**digits)
    high = lambda v: F.lit(134217729.0) * v - (F.lit(134217729.0) * v - v)  # noqa: E731  the upper half of the digits
    p = x * k
    xh = high(x)
    error = (xh * k - p) + (x - xh) * k
    low = F.floor(p).cast("double")
    near = F.when(error > 0, low + 1).when(error < 0, low).otherwise(F.rint(p))
    return F.when((F.abs(x) < 1e13) & (p - low == 0.5), near / k).when(F.abs(x) < 1e13, F.rint(p) / k).otherwise(x)


def circular(a: Column, b: Column, around: float) -> Column:
    return (F.cos((a - b) * (2 * 3.141592653589793 / around)) + 1) / 2


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def bearing_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))
