"""Masked forecast errors as mergeable sums. A label of 0 is missing; a NaN label counts but adds no loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayglass.functions.exact import WHOLE, round_ratio, units

BANDS = ((1, 3), (4, 6), (7, 12))


def error_sums(y: Column, p: Column, mask: Column | None = None) -> list[Column]:
    ok = (y != 0) if mask is None else (y != 0) & mask  # true for NaN as well
    e = p - y
    add = lambda c: F.sum(F.when(ok, F.nanvl(c, F.lit(0.0))))
    return [add(F.abs(e)).alias("sum_abs"), add(e * e).alias("sum_sq"), add(F.abs(e) / F.abs(y)).alias("sum_pct"), add(e).alias("sum_err"), F.count(F.when(ok, 1)).alias("count")]


def from_sums(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("count"), F.lit(1))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / n
    out = df.withColumn("mae", z("sum_abs")).withColumn("mape", z("sum_pct")).withColumn("rmse", F.sqrt(z("sum_sq"))).withColumn("bias", z("sum_err"))
    return out.withColumn("mape_percent", F.col("mape") * 100).drop("sum_abs", "sum_sq", "sum_pct", "sum_err")


def exact_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p", places: int = 4, digits: int = 3) -> DataFrame:
    """masked_metrics of finite values with so many decimal places, rounded to `digits`: sums are whole numbers, so neither order nor partitions show in the result. Relative errors are added to 8 places."""
    label, off = F.col(y), F.col(p) - F.col(y)
    rows = df.where(label != 0).withColumn("__off", units(off, places)).withColumn("__share", units(F.abs(off) / F.abs(label), 8))
    whole = lambda c: F.sum(c).cast(WHOLE)
    e = F.col("__off").cast("decimal(18,0)")
    sums = rows.groupBy(*by).agg(whole(F.abs(e)).alias("a"), whole(e * e).alias("s"), whole("__share").alias("r"), whole(e).alias("b"), F.count("*").alias("count"))
    n, unit = F.col("count"), 10**places
    return sums.select(
        *by, "count", round_ratio(F.col("a"), n * unit, digits).alias("mae"), round_ratio(F.col("r"), n * 10**8, digits).alias("mape"), round_ratio(F.col("r") * 100, n * 10**8, digits - 1).alias("mape_percent"),
        F.round(F.sqrt(F.col("s").cast("double") / n) / unit, digits).alias("rmse"), round_ratio(F.col("b"), n * unit, digits).alias("bias"))


def masked_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p", mask: str | None = None) -> DataFrame:
    return from_sums(df.groupBy(*by).agg(*error_sums(F.col(y), F.col(p), F.col(mask) if mask else None)))


def local_outcomes(df: DataFrame, by: list[str], intervals: DataFrame | None = None) -> DataFrame:
    """Errors of base, normal and prediction against y per interval of steps, the prediction's change of MAE over the base, and the verdict.

    df: by, horizon, y, base, normal (may be null), prediction. intervals: start_step, end_step (and any of by); the horizon bands by default. Steps with a missing (0, NaN, infinite) y count nowhere.
    """
    spark = df.sparkSession
    spans = intervals if intervals is not None else spark.createDataFrame(list(BANDS), "start_step int, end_step int")
    on = [c for c in spans.columns if c in by]
    inside = df.alias("d").join(F.broadcast(spans).alias("s") if intervals is None else spans.alias("s"), [F.col(f"d.{c}") == F.col(f"s.{c}") for c in on] + [F.col("horizon").between(F.col("start_step"), F.col("end_step"))])
    rows = inside.select(*[F.col(f"d.{c}") for c in df.columns], "start_step", "end_step").where((F.col("y") != 0) & ~F.isnan("y") & (F.abs("y") < float("inf")))
    mean = lambda c, f: F.when(F.count(c) == F.count("*"), F.avg(f(F.col(c) - F.col("y"))))
    out = rows.groupBy(*by, "start_step", "end_step").agg(
        F.count("*").alias("valid_points"), *[mean(c, f).alias(f"{c}_{n}") for c in ("base", "normal", "prediction") for n, f in (("mae", F.abs), ("bias", lambda x: x))])
    delta = F.col("prediction_mae") - F.col("base_mae")
    return out.withColumn("delta", delta).withColumn("outcome", F.when(delta < -1e-6, "improved").when(delta > 1e-6, "degraded").otherwise("equal"))


def choose_incidents(eligible: DataFrame, requested: list[int | str] | None, cases: DataFrame, id_col: str = "incident_id", time: str = "dt") -> DataFrame:
    """The requested incidents that are eligible, each once, in order of time; those of `cases` if none are requested. An id that `eligible` doesn't hold raises."""
    if requested is None:
        wanted = cases.select(id_col).distinct()
    else:
        spark = eligible.sparkSession
        wanted = spark.createDataFrame([(x,) for x in dict.fromkeys(requested)], f"{id_col} {dict(eligible.dtypes)[id_col]}")
        unknown = [r[0] for r in wanted.join(eligible, id_col, "left_anti").limit(5).collect()]
        if unknown:
            raise ValueError(f"not among the eligible incidents: {unknown}")
    return eligible.join(wanted, id_col, "left_semi").dropDuplicates([id_col]).orderBy(time, id_col)


def band_of(horizon: Column) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi in BANDS:
        out = F.when((horizon >= lo) & (horizon <= hi), f"{lo}-{hi}").otherwise(out)
    return out


def horizon_profile(df: DataFrame, by: list[str], places: int | None = None, digits: int = 3) -> DataFrame:
    """Weighted mae, bias, valid points and effective windows per step, band and overall, in one pass of grouping sets. With `places`, values have so many decimal places at most and weights are
    whole: sums are then exact, and results rounded to `digits`.

    df: by, window, weight, horizon, y, p. Effective windows are (sum s)^2 / sum s^2 over the windows' weights s on valid points.
    """
    ok = (F.col("y") != 0) & ~F.isnan("y") & ~F.isnan("p")
    per = df.where(ok).withColumn("band", band_of(F.col("horizon"))).withColumn("err", F.col("p") - F.col("y"))
    sets = [[*by, "window", "horizon"], [*by, "window", "band"], [*by, "window"]]
    if places is not None:
        per = per.withColumn("err", units(F.col("err"), places).cast("decimal(18,0)")).withColumn("weight", F.col("weight").cast("decimal(10,0)"))
    agg = [F.sum("weight").alias("s"), F.sum(F.col("weight") * F.abs("err")).alias("a"), F.sum(F.col("weight") * F.col("err")).alias("b"), F.count("*").alias("n")]
    windows = per.groupingSets(sets, *by, "window", "horizon", "band").agg(*agg)
    level = F.when(F.col("horizon").isNotNull(), F.concat(F.lit("step "), F.col("horizon").cast("string"))).when(F.col("band").isNotNull(), F.concat(F.lit("band "), "band")).otherwise("overall")
    if places is not None:
        whole = lambda c: F.sum(F.col(c).cast("decimal(18,0)")).cast(WHOLE)
        s = F.col("s").cast("decimal(18,0)")
        sums = windows.withColumn("level", level).groupBy(*by, "level").agg(whole("s").alias("s"), whole("a").alias("a"), whole("b").alias("b"), F.sum(s * s).cast(WHOLE).alias("q"), F.sum("n").alias("valid_points"))
        each = F.col("s") * 10**places
        return sums.select(*by, "level", round_ratio(F.col("a"), each, digits).alias("mae"), round_ratio(F.col("b"), each, digits).alias("bias"), "valid_points",
                           round_ratio(F.col("s").cast("decimal(15,0)") * F.col("s").cast("decimal(15,0)"), F.col("q"), digits).alias("effective_windows"))
    return windows.withColumn("level", level).groupBy(*by, "level").agg(
        (F.sum("a") / F.sum("s")).alias("mae"), (F.sum("b") / F.sum("s")).alias("bias"), F.sum("n").alias("valid_points"),
        (F.sum("s") * F.sum("s") / F.sum(F.col("s") * F.col("s"))).alias("effective_windows"))


def impact_cases(windows: DataFrame, top: int, month: int | None = None, ts: Column | None = None, last_least: float = 50, drop_least: float = 20, rel_least: float = 0.1) -> DataFrame:
    """Windows with the greatest drop: last value minus the least future value, by drop times relative drop (a top-k report)."""
    if month is not None:
        windows = windows.where(F.month(ts if ts is not None else F.col("ts")) == month)
    w = windows.withColumn("last", F.element_at("hist", 12)).withColumn("drop_", F.col("last") - F.array_min("fut"))
    w = w.withColumn("rel", F.col("drop_") / F.greatest(F.col("last"), F.lit(1.0))).where((F.col("last") >= last_least) & (F.col("drop_") >= drop_least) & (F.col("rel") >= rel_least))
    return w.withColumn("score", F.round(F.col("drop_") * F.col("rel"), 4)).orderBy(F.desc("score"), "node", "step").limit(top)


def processing_summary(runs: DataFrame, ms: str = "processing_ms") -> DataFrame:
    """One row: incidents, their whole time and its mean in ms (0 without incidents)."""
    return runs.agg(F.count("*").alias("incidents"), F.coalesce(F.sum(ms), F.lit(0.0)).alias("total_ms"), F.coalesce(F.avg(ms), F.lit(0.0)).alias("average_ms"))
