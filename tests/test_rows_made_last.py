"""Pairs of rows are made from lists in the last step: nothing shuffles, sorts or joins them."""

from pyspark.sql import functions as F

from wayglass.functions.exact import near_round
from wayglass.operators import records, spatial

BANDS = ((0.0, 20.0), (20.0, 40.0), (40.0, 60.0))


def crowd(spark, name, n, spots):
    return spark.range(n).select((F.col("id") + 1).alias(name), (38 + (F.col("id") % spots) / 50.0).alias("lat"), (-121 - (F.col("id") % spots) / 80.0).alias("lng"), (F.col("id") % 2).cast("string").alias("road"), F.lit("N").alias("direction"))


def made_last(df):
    above, found, _ = df._jdf.queryExecution().executedPlan().toString().partition("explode(a_rows")
    return bool(found) and not any(step in above for step in ("Exchange", "Sort", "Join", "Window"))


def test_pairs_are_made_last(spark):
    a, b = crowd(spark, "site", 2500, 2), crowd(spark, "sensor", 90, 3)
    near = spatial.near_pairs(a, b, 500.0)
    assert made_last(near) and near.select("a_site", "b_sensor").distinct().count() == near.count() == 2500 * 90


def test_scoped_routes_are_made_last(spark):
    assert made_last(spatial.scoped_routes(crowd(spark, "site", 130, 9), crowd(spark, "sensor", 50, 7), 46.2, BANDS))


def test_layers_are_made_last(spark):
    sensors = crowd(spark, "sensor", 50, 7)
    up = sensors.select("sensor", (F.col("sensor") % 7 + 1).alias("prev"))
    assert made_last(records.layers_over_routes(crowd(spark, "site", 130, 9), sensors, up, 46.2, BANDS, 7))


def test_near_round_is_round(spark):
    x = [0.00005, -0.00005, 0.12345, 2.675, -2.67505, 1.00015, 1e-9, -1e-9, 0.0, -0.0, 1234567.89125, 1e9 + 0.12345, 1e300, float("inf"), float("nan"), None, *[i / 7000 for i in range(-500, 500)], *[i / 20000 for i in range(-500, 500)]]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for digits in (4, 7):
        assert df.where(~near_round(F.col("x"), digits).eqNullSafe(F.round("x", digits))).count() == 0
