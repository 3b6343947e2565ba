"""Forecasts as a table: (node, step, base), base being the FUTURE values after the step.

A forecaster is any function from windows (node, step, hist, ...) to such a table, so a model runs where its author wants it to: as column expressions, or by
mapInPandas over a model that each task loads. A table is computed once and joined wherever a forecast is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayglass.functions.exact import units
from wayglass.operators.asof import asof_join, running_totals
from wayglass.schema import FUTURE
from wayglass.sources.scratch import written

#: Periods of a node that one task merges.
STRETCH = 64
Forecaster = Callable[[DataFrame], DataFrame]


def last_value(windows: DataFrame) -> DataFrame:
    return windows.select("node", "step", F.array_repeat(F.element_at("hist", -1), FUTURE).alias("base"))


def seasonal(period: int, places: int = 4) -> Forecaster:
    """The mean of the node's flow (of so many decimal places) at the same phase of the period, over windows that ended by then; the last value until there is one.

    Means run along a node's phase and are looked up by an as-of join, both by stretches of time: the work is FUTURE rows a window, however many came before.
    """

    def forecast(windows: DataFrame) -> DataFrame:
        width = period * STRETCH
        past = windows.select("node", F.col("step").alias("seen"), (F.col("step") % period).alias("phase"), units(F.element_at("hist", -1), places).alias("y"))
        totals = running_totals(past, ["node", "phase"], "seen", {"total": F.col("y"), "n": F.lit(1)}, width)
        means = totals.select("node", "phase", "seen", (F.col("total").cast("double") / 10**places / F.col("n")).alias("mean"))
        ahead = windows.select("node", "step", F.element_at("hist", -1).alias("last"), F.explode(F.sequence(F.lit(1), F.lit(FUTURE))).alias("h")).withColumn("phase", (F.col("step") + F.col("h")) % period)
        met = asof_join(ahead, means, ["node", "phase"], "step", ["mean"], width, right_time="seen").withColumn("v", F.coalesce("mean", "last"))
        return met.groupBy("node", "step").agg(F.transform(F.sort_array(F.collect_list(F.struct("h", "v"))), lambda x: x["v"]).alias("base"))

    return forecast


FORECASTERS: dict[str, Forecaster] = {"last_value": last_value, "seasonal_24": seasonal(24)}


def forecast_table(windows: DataFrame, forecaster: str | Forecaster) -> DataFrame:
    """A forecaster's table, checked: one row of FUTURE finite values for each window."""
    made = FORECASTERS[forecaster] if isinstance(forecaster, str) else forecaster
    out = written(made(windows).select("node", "step", "base"), "forecasts")
    finite = F.forall("base", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bad = out.where((F.size("base") != FUTURE) | ~finite).limit(1).count()
    if bad or out.count() != windows.count() or out.join(windows, ["node", "step"], "left_anti").limit(1).count():
        raise ValueError("a forecaster must give each window FUTURE finite values")
    return out
