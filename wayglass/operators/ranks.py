"""Ranks within groups of any size: rows are dealt into ranges of (group, order), so a group that holds most rows is sorted by many tasks, and counts of the ranges turn places into ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayglass.sources.scratch import written


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", total: str | None = None, ranges: int | None = None) -> DataFrame:
    """df with the rank (from 1, gapless) of each row within `by` in an ascending order, and with the group's number of rows as `total`.

    Null keys are a group. Rows equal in the order are ranked as they were read; a value that many rows share is cut over ranges too. Rows are written once in their order, since a range's borders are drawn anew by every run.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(keys, order, strict=True))).withColumn("__tie", F.monotonically_increasing_id())
    along = [*by, *keys, "__tie"]
    dealt = keyed.repartitionByRange(*([ranges] if ranges else []), *along).sortWithinPartitions(*along)
    run = written(dealt.drop(*keys, "__tie").withColumn("__row", F.monotonically_increasing_id()), "ranked").withColumn("__range", F.shiftright("__row", 33))
    over = Window.partitionBy(*(by or [F.lit(0)]))  # a row a range
    counts = run.groupBy(*by, "__range").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    before = F.coalesce(F.sum("__n").over(over.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"__by_{k}") for k in by], F.col("__range").alias("__at"), (before - F.col("__first") + 1).alias("__shift"), F.sum("__n").over(over).alias("__total"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__by_{k}")) for k in by], F.col("__range") == F.col("__at"))
    return run.join(counts, same).select(*df.columns, (F.col("__row") + F.col("__shift")).alias(name), *([F.col("__total").alias(total)] if total else []))
