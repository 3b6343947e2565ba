"""Windows and features over a dense grid (node, step, flow, occupancy, speed). Windows never cross a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayglass.functions import arrays as A
from wayglass.functions.keys import HOLIDAYS, is_holiday, period
from wayglass.operators.ranks import ranked
from wayglass.schema import CHUNK, EPOCH, FUTURE, HISTORY

CHANNELS = (("hist", 1.0), ("occ", 0.001), ("spd", 1.0))


def windows(grid: DataFrame) -> DataFrame:
    """node, step, chunk, hist, fut (flow), occ, spd (12 values each); complete windows only. One sort per (node, chunk)."""
    by = Window.partitionBy("node", "chunk").orderBy("step")
    past, ahead = by.rowsBetween(-(HISTORY - 1), 0), by.rowsBetween(1, FUTURE)
    w = grid.withColumn("chunk", F.expr(f"step div {CHUNK}")).select(
        "node", "step", "chunk", F.collect_list("flow").over(past).alias("hist"), F.collect_list("flow").over(ahead).alias("fut"),
        F.collect_list(F.col("occupancy").cast("double")).over(past).alias("occ"), F.collect_list("speed").over(past).alias("spd"))
    return w.where((F.size("hist") == HISTORY) & (F.size("fut") == FUTURE))


def with_features(w: DataFrame) -> DataFrame:
    """Adds scale_, trend_ and vol_ of each channel."""
    for c, least in CHANNELS:
        w = w.withColumn(f"scale_{c}", F.greatest(A.mean_abs(F.col(c)), F.lit(least)))
        w = w.withColumn(f"trend_{c}", A.slope(F.col(c), HISTORY) / F.col(f"scale_{c}")).withColumn(f"vol_{c}", A.std_pop(F.col(c)) / F.col(f"scale_{c}"))
    return w


def step_time(step: Column) -> Column:
    return F.timestamp_seconds(step * 3600 + EPOCH)


def with_calendar(df: DataFrame, ts: Column, holidays: tuple[str, ...] = HOLIDAYS) -> DataFrame:
    """Adds day, hour, weekday (Monday 0), weekend, holiday, free, period."""
    df = df.withColumn("day", F.to_date(ts)).withColumn("hour", F.hour(ts)).withColumn("weekday", F.weekday(ts))
    df = df.withColumn("weekend", F.col("weekday") >= 5).withColumn("holiday", is_holiday(F.col("day"), holidays))
    return df.withColumn("free", F.col("weekend") | F.col("holiday")).withColumn("period", period(F.col("hour")))


def changepoint(a: Column, n: int = 12) -> dict[str, Column]:
    """index (0-based place before the largest jump), direction and magnitude relative to the median so far."""
    d = A.steps(a, n)
    size = F.transform(d, lambda x: F.abs(x))
    at = F.array_position(size, F.array_max(size)).cast("int")
    before = F.sort_array(F.slice(a, F.lit(1), at))
    mid = (F.element_at(before, F.floor((at + 1) / 2).cast("int")) + F.element_at(before, F.floor((at + 2) / 2).cast("int"))) / 2
    return {"index": at - 1, "direction": F.signum(F.element_at(d, at)).cast("int"), "magnitude": F.array_max(size) / F.greatest(mid, F.lit(1.0))}


def phase_means(a: Column) -> list[Column]:
    return [A.mean(F.slice(a, 1 + 3 * k, 3)) for k in range(4)]


def shape_code(effect: Column, reference: Column) -> Column:
    """Three letters: U, D or F by the change from phase to phase over max(mean |reference|, 1), dead band 0.02."""
    p, scale = phase_means(effect), F.greatest(A.mean_abs(reference), F.lit(1.0))
    rel = [(b - a) / scale for a, b in zip(p, p[1:], strict=False)]
    return F.concat(*[F.when(r > 0.02, "U").when(r < -0.02, "D").otherwise("F") for r in rel])


def effect_direction(effect: Column, normal: Column) -> Column:
    limit, m = F.greatest(F.lit(5.0), A.mean_abs(normal) * 0.02), A.mean(effect)
    return F.when(m > limit, "positive").when(m < -limit, "negative").otherwise("neutral")


def prefix_similarity(a: Column, b: Column, n: int = 3) -> Column:
    same = [F.substring(a, 1, k) == F.substring(b, 1, k) for k in range(1, n + 1)]
    return sum((F.when(s, 1).otherwise(0) for s in same), F.lit(0)) / F.lit(n)


def window_starts(spark: SparkSession, length: int, history: int = HISTORY, future: int = FUTURE) -> DataFrame:
    """start: 0 to length - history - future - 1; a range without a window raises."""
    if length - history - future <= 0:
        raise ValueError(f"{length} steps hold no window of {history} + {future}")
    return spark.range(length - history - future).withColumnRenamed("id", "start")


def check_months(months: list[int]) -> list[int]:
    """Months are unique, ascending and within 1 to 12."""
    if not months or list(months) != sorted(set(months)) or not all(1 <= m <= 12 for m in months):
        raise ValueError(f"months must be unique, ascending and within 1 to 12: {months}")
    return list(months)


def chronological_split(starts: DataFrame, order: str, train: float = 0.7, val: float = 0.15, group: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds split: the first round(n * train) rows, the next round(n * val), the rest (half to even). Ratios must leave a test part. No task sorts a group (see ranks)."""
    if not (0 < train and 0 < val and train + val < 1):
        raise ValueError("ratios must be positive and leave a test part")
    placed = ranked(starts, group or [], [F.col(order)], "__at", "__n", ranges)
    first, second = F.bround(F.col("__n") * F.lit(train)), F.bround(F.col("__n") * F.lit(val))
    return placed.withColumn("split", F.when(F.col("__at") <= first, "train").when(F.col("__at") <= first + second, "val").otherwise("test")).drop("__at", "__n")
