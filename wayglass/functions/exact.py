"""Sums and quotients that do not depend on the order of addition: values of so many decimal places are added as whole units, and quotients are rounded in whole numbers, half away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = "decimal(38,0)"


def units(c: Column, places: int) -> Column:
    """A finite value as a whole number of 10 ** -places."""
    return F.round(c * F.lit(10.0**places)).cast(WHOLE)


def round_ratio(num: Column, den: Column, digits: int) -> Column:
    """num / den (whole numbers, den above 0) to so many digits, as a double."""
    num, den = num.cast("decimal(30,0)"), den.cast("decimal(28,0)")
    up = F.call_function("div", F.abs(num) * F.lit(2 * 10**digits) + den, den * 2)
    return F.signum(num.cast("double")) * up.cast("double") / F.lit(10.0**digits) + 0.0


def near_round(x: Column, digits: int) -> Column:
    """What F.round gives for a double, without its decimals where the value lies clear of a tie. x is read more than once: give a column."""
    y = x * F.lit(10.0**digits)
    clear = (F.abs(y) < 1e12) & (F.abs(y - F.floor(y) - 0.5) > 0.01)
    return F.when(clear, F.floor(y + 0.5) / F.lit(10.0**digits)).otherwise(F.round(x, digits))
