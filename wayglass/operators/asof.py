"""Joins and totals along time whose work grows with the rows, not with their pairs: both sides are merged in order of time, one stretch of time of a key a task, and what a stretch ends with is handed on to the later ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stretch(time: str, width: float) -> Column:
    return F.floor(F.col(time) / F.lit(width)).cast("long")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], time: str, values: list[str], width: float, right_time: str | None = None, strict: bool = False, tolerance: float | None = None, tie: str | None = None) -> DataFrame:
    """Each row of left with `values` of the last row of right that has the same keys and a time up to its own (before it, if strict), as far back as `tolerance`; null where there is none.

    Times are numbers. Of right rows at one time that with the largest `tie` counts (without one, which is left open). Null keys or times match nothing; rows of left all stay, repeated ones
    too. A key's rows are merged in stretches of `width`, so no task sorts a key's whole life; stretches without a right row take the last one before them from a table that has one row a
    key and stretch.
    """
    right_time = right_time or time
    names = [*left.columns, *values]
    if len(set(names)) < len(names):
        raise ValueError(f"values have names of the left side: {sorted(set(values) & set(left.columns))}")
    known = lambda t: F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double"))
    row, value = F.struct(*[F.col(c) for c in left.columns]), F.struct(F.col(right_time).alias("__at"), *[F.col(c) for c in values])
    order = F.col(tie) if tie else F.lit(0)
    null = lambda df, c: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    own = left.select(*on, F.col(time).cast("double").alias("__t"), F.lit(1).alias("__side"), null(right, order), row.alias("__row"), null(right, value))
    other = right.where(known(right_time)).select(*on, F.col(right_time).cast("double").alias("__t"), F.lit(2 if strict else 0).alias("__side"), order, null(left, row), value)
    names_ = [*on, "__t", "__side", "__tie", "__row", "__value"]
    merged = own.toDF(*names_).unionByName(other.toDF(*names_)).withColumn("__part", F.floor(F.col("__t") / F.lit(width)))
    merged = merged.where(F.col("__row").isNotNull() | F.expr(" and ".join(f"`{k}` is not null" for k in on) or "true"))
    here = Window.partitionBy(*on, "__part").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    parts = merged.groupBy(*on, "__part").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct("__t", "__tie"))).alias("__end"))
    before = Window.partitionBy(*on).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    handed = parts.select(*on, "__part", F.last("__end", ignorenulls=True).over(before).alias("__handed")).where("__handed is not null")
    found = merged.withColumn("__value", F.last("__value", ignorenulls=True).over(here)).where("__row is not null")
    found = found.join(handed, [*on, "__part"], "left").withColumn("__value", F.coalesce("__value", "__handed"))
    fits = F.col("__t").isNotNull() & ~F.isnan("__t") & F.col("__value").isNotNull()
    if tolerance is not None:
        fits = fits & (F.col("__t") - F.col("__value.__at").cast("double") <= tolerance)
    return found.select("__row.*", *[F.when(fits, F.col(f"__value.{c}")).alias(c) for c in values])


def running_totals(rows: DataFrame, by: list[str], time: str, sums: dict[str, Column], width: float, tie: str | None = None) -> DataFrame:
    """rows with running totals along time within `by`: each row's own value and all earlier ones (and, at the same time, those up to its `tie`). Totals of a stretch of `width` are added once and handed on."""
    valued = rows.withColumns({f"__{n}": c for n, c in sums.items()}).withColumn("__part", _stretch(time, width))
    here = Window.partitionBy(*by, "__part").orderBy(time, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = valued.groupBy(*by, "__part").agg(*[F.sum(f"__{n}").alias(f"__{n}_in") for n in sums])
    handed = parts.select(*by, "__part", *[F.sum(f"__{n}_in").over(before).alias(f"__{n}_before") for n in sums])
    zero = F.lit(0)
    out = valued.join(handed, [*by, "__part"]).withColumns({n: F.sum(f"__{n}").over(here) + F.coalesce(F.col(f"__{n}_before"), zero) for n in sums})
    return out.select(*rows.columns, *sums)
