"""Incident-free reference sequences: interval anti-join, kernel scores, one candidate a day, weighted summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayglass.functions import arrays as A
from wayglass.functions.exact import round_ratio, units
from wayglass.functions.keys import circular
from wayglass.operators.timeseries import CHANNELS, step_time, with_calendar
from wayglass.schema import CHUNK, EPOCH, STEP_MINUTES
from wayglass.sources.scratch import written

BEFORE_S, AFTER_S, BUFFER_S, UNKNOWN_MIN, BUCKET_S = 3600, 3300, 1800, 60, 6 * 3600
TRAFFIC_WEIGHT, LEAST_SCORE, K, LOCAL_KM, CUTOFF_MIN = 0.75, 0.6, 10, 5.0, 60
#: The optional time filter: candidates of a query from which it sets in and down to which it cuts, and those that the time score keeps in any case.
COARSE_LIMIT, COARSE_TOP = 16_384, 4_096
CAL = ["day", "hour", "weekday", "free", "period"]


def effective_minutes(d: Column, unknown: int = UNKNOWN_MIN) -> Column:
    """Unknown durations (null, NaN, infinite, not above 0) count as `unknown`."""
    d = d.cast("double")
    return F.when(~F.isnan(d) & (d > 0) & (d < float("inf")), F.floor(d)).otherwise(unknown)


def cutoff_steps(minutes: float, step_minutes: int = STEP_MINUTES) -> int:
    """The steps by which a candidate has to be earlier so that at least so many minutes lie between (exactly as many are enough)."""
    if minutes < 0:
        raise ValueError("a cutoff can't be below 0 minutes")
    return math.ceil(minutes / step_minutes)


def local_incidents(incidents: DataFrame, routes: DataFrame, radius_km: float = LOCAL_KM) -> DataFrame:
    """Each incident with every node (and route) that it has a route of 0 to radius_km to. routes: incident_id, node, km, ..."""
    near = routes.where(F.col("km").isNotNull() & ~F.isnan("km") & (F.col("km") >= 0) & (F.col("km") <= radius_km))
    return incidents.join(near, "incident_id")


def exclusions(incidents: DataFrame, buffer_minutes: int = BUFFER_S // 60, unknown: int = UNKNOWN_MIN) -> DataFrame:
    """lo and hi (seconds from the start, both inclusive): window times that an incident touches."""
    at = F.unix_micros(F.col("dt").cast("timestamp")) / 1e6 - EPOCH
    return incidents.withColumn("lo", at - buffer_minutes * 60 - BEFORE_S).withColumn("hi", at + effective_minutes(F.col("duration_minutes"), unknown) * 60 + AFTER_S)


def interval_anti_join(rows: DataFrame, at: str, intervals: DataFrame, keys: list[str] | None = None, width: int = BUCKET_S) -> DataFrame:
    """rows whose time lies in none of the intervals (lo, hi), matched on keys if given.

    Each interval is filed under every bucket of time it touches, each row under its own: the join is over equal keys, and an
    anti-join never multiplies rows.
    """
    spread = intervals.select(*(keys or []), "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("__b"))
    own = rows.withColumn("__b", F.floor(F.col(at) / width))
    on = [own["__b"] == spread["__b"], own[at] >= spread["lo"], own[at] <= spread["hi"], *(own[k] == spread[k] for k in keys or [])]
    return own.join(spread, on, "left_anti").drop("__b")


def interval_anti_join_sweep(rows: DataFrame, at: str, intervals: DataFrame, key: str, width: int = 240 * 3600) -> DataFrame:
    """The same by a sweep: a running count of open intervals per key and stretch of time, opening before and closing after the rows of one time.

    An interval is cut at the borders of the stretches it touches, so a key's life is as many tasks' work as it has stretches.
    """
    cut = intervals.select(key, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("__part"))
    mark = lambda c, o, d: cut.select(key, "__part", c.cast("double").alias("__t"), F.lit(o).alias("__o"), F.lit(d).alias("__d"))
    marks = mark(F.greatest("lo", F.col("__part") * width), 0, 1).unionByName(mark(F.least("hi", (F.col("__part") + 1) * width), 2, -1))
    own = rows.withColumn("__t", F.col(at).cast("double")).withColumn("__part", F.floor(F.col(at) / width)).withColumn("__o", F.lit(1)).withColumn("__d", F.lit(0))
    open_ = F.sum("__d").over(Window.partitionBy(key, "__part").orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0))
    return own.unionByName(marks, allowMissingColumns=True).withColumn("__open", open_).where("__o = 1 and __open = 0").drop("__t", "__o", "__d", "__open", "__part")


def incident_free(windows: DataFrame, local: DataFrame, buffer_minutes: int = BUFFER_S // 60, unknown: int = UNKNOWN_MIN) -> DataFrame:
    """Windows (node, step) that no incident near their node touches. local: incidents with `node` (see local_incidents)."""
    return interval_anti_join(windows.withColumn("sec", F.col("step") * 3600), "sec", exclusions(local, buffer_minutes, unknown), ["node"]).drop("sec")


def _time_score() -> Column:
    same = lambda x: F.when(F.col(f"q_{x}") == F.col(f"c_{x}"), 1.0).otherwise(0.0)
    return (same("free") + same("weekday") + same("period") + circular(F.col("q_hour"), F.col("c_hour"), 24) + circular(F.month("q_day"), F.month("c_day"), 12)) / 5


def time_filter(pairs: DataFrame, by: list[str], limit: int = COARSE_LIMIT, top: int = COARSE_TOP) -> DataFrame:
    """Pairs of a query (by) and its candidates, cut by time alone where a query has more than `limit`.

    Kept are candidates that are alike in weekday, period, free day, hour (to 3) or month (to 1), and the `top` by time score; of these the `limit` best by time score.
    """
    around = lambda q, c, n: F.least(F.abs(q - c), n - F.abs(q - c))
    w = Window.partitionBy(*by)
    order = [F.desc("__time"), F.col("c_step")]
    p = pairs.withColumn("__n", F.count("*").over(w)).withColumn("__time", _time_score())
    broad = (F.col("q_weekday") == F.col("c_weekday")) | (F.col("q_period") == F.col("c_period")) | (F.col("q_free") == F.col("c_free")) | (around(F.col("q_hour"), F.col("c_hour"), 24) <= 3) | (
        around(F.month("q_day"), F.month("c_day"), 12) <= 1)
    p = p.withColumn("__place", F.row_number().over(w.orderBy(*order))).where((F.col("__n") <= limit) | broad | (F.col("__place") <= min(top, limit)))
    p = p.withColumn("__place", F.row_number().over(w.orderBy(*order))).where((F.col("__n") <= limit) | (F.col("__place") <= limit))
    return p.drop("__n", "__time", "__place")


def candidate_scores(queries: DataFrame, candidates: DataFrame, lag: int = 1, coarse: bool = False) -> DataFrame:
    """Score each query (incident_id, node, step and window features) against candidates of its node at least `lag` steps earlier.

    A query is filed under every chunk of time up to its own and meets the candidates of a node and chunk there, so a node's candidates are dealt over as many tasks
    as they have chunks. Futures stay out of this join: see with_futures.
    """
    cols = ["step", *[f"{p}{c}" for c, _ in CHANNELS for p in ("", "scale_", "trend_", "vol_")]]
    q = with_calendar(queries, step_time(F.col("step"))).select("incident_id", "node", *[F.col(x).alias(f"q_{x}") for x in cols + CAL])
    q = q.where(F.col("q_step") >= lag).withColumn("chunk", F.explode(F.expr(f"sequence(0L, (q_step - {lag}) div {CHUNK})")))
    c = with_calendar(candidates, step_time(F.col("step"))).select("node", "chunk", *[F.col(x).alias(f"c_{x}") for x in cols + CAL])
    p = q.join(c, ["node", "chunk"]).where(F.col("c_step") <= F.col("q_step") - lag)
    if coarse:
        p = time_filter(p, ["incident_id", "node"])
    close = [F.exp(-A.rmse(F.col(f"q_{x}"), F.col(f"c_{x}")) / F.col(f"q_scale_{x}")) for x, _ in CHANNELS]
    gap = lambda f: F.exp(-sum((F.abs(F.col(f"q_{f}_{x}") - F.col(f"c_{f}_{x}")) for x, _ in CHANNELS), F.lit(0.0)) / 3)
    traffic = (sum(close, F.lit(0.0)) + gap("trend") + gap("vol")) / 5
    return (
        p.withColumn("traffic_score", F.round(traffic, 6)).withColumn("time_score", F.round(_time_score(), 6))
        .withColumn("score", F.round(F.col("traffic_score") * TRAFFIC_WEIGHT + F.col("time_score") * (1 - TRAFFIC_WEIGHT), 8))
        .select("incident_id", "node", F.col("q_step").alias("query_step"), F.col("c_step").alias("step"), F.col("c_day").alias("day"), "traffic_score", "time_score", "score"))


def select_candidates(scored: DataFrame, k: int = K, least: float = LEAST_SCORE) -> DataFrame:
    """The best candidate of each day, then the k best days; adds rank and weight (scores over their sum)."""
    by = ["incident_id", "node"]
    day = F.row_number().over(Window.partitionBy(*by, "day").orderBy(F.desc("score"), "step"))
    best = scored.where(F.col("score") >= least).withColumn("d", day).where("d = 1").drop("d")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "step"))
    top = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.withColumn("weight", F.col("score") / F.sum("score").over(Window.partitionBy(*by)))


def with_futures(selected: DataFrame, windows: DataFrame) -> DataFrame:
    """Selected candidates with the future of their window (node, step, fut)."""
    return selected.join(windows.select("node", "step", "fut"), ["node", "step"])


def reference(selected: DataFrame) -> DataFrame:
    """Per (incident, node, horizon): weighted mean and spread (by deviations) of the futures, effective sample size, candidates, least score and the mean score to 6 places."""
    by = ["incident_id", "node", "horizon"]
    steps = selected.select("incident_id", "node", "weight", "score", F.posexplode("fut").alias("h", "y")).withColumn("horizon", F.col("h") + 1)
    steps = steps.withColumn("normal", F.sum(F.col("weight") * F.col("y")).over(Window.partitionBy(*by)))
    away = F.col("y") - F.col("normal")
    return steps.groupBy(*by).agg(
        F.first("normal").alias("normal"), F.sqrt(F.sum(F.col("weight") * away * away)).alias("spread"), (1 / F.sum(F.col("weight") * F.col("weight"))).alias("ess"),
        F.count("*").alias("n"), F.min("score").alias("least_score"), round_ratio(F.sum(units(F.col("score"), 8)), F.count("*") * 10**8, 6).alias("mean_score"))


def sequences(ref: DataFrame) -> DataFrame:
    """One row per (incident, node): normal as an array of 12, and the evidence that is the same at each horizon."""
    row = F.transform(F.sort_array(F.collect_list(F.struct("horizon", "normal"))), lambda x: x["normal"])
    return ref.groupBy("incident_id", "node").agg(row.alias("normal"), *[F.first(c).alias(c) for c in ("ess", "n", "least_score", "mean_score")])


def forecast_gap(normal: Column, forecast: Column) -> Column:
    """Mean absolute difference of a forecast from the reference; null unless both have the same length."""
    return F.when(F.size(normal) == F.size(forecast), A.mean_abs(A.minus(forecast, normal)))


def recovery(hist: Column, normal: Column) -> dict[str, Column]:
    """The last flow, the slopes of the history and of the reference, and the reference's change from the last flow at each step."""
    last = F.element_at(hist, 12)
    return {"last_flow": last, "history_slope": A.slope(hist, 12), "normal_slope": A.slope(normal, 12), "change": A.each_with(normal, last, lambda x, y: x - y)}


def base_evidence(selected: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Per (incident, node, horizon): weighted mean, spread, p10, p50, p90 and mean absolute error of the residuals of forecasts (node, step, base: 12 values) over the
    selected candidates (with fut)."""
    x = selected.join(forecasts, ["node", "step"]).select("incident_id", "node", "step", "weight", F.posexplode(A.minus(F.col("fut"), F.col("base"))).alias("h", "v"))
    by = ["incident_id", "node", "horizon"]
    x = x.withColumn("horizon", F.col("h") + 1).withColumn("v", F.round("v", 4)).drop("h")
    x = x.withColumn("mean", F.sum(F.col("weight") * F.col("v")).over(Window.partitionBy(*by)))
    away = F.col("v") - F.col("mean")
    sums = x.groupBy(*by).agg(F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("weight") * away * away)).alias("std"), F.sum(F.col("weight") * F.abs("v")).alias("mae"))
    return weighted_quantiles(x.drop("mean"), by, "v", "weight", "step").join(sums, by)


def normal_counterfactual(windows: DataFrame, incidents: DataFrame, routes: DataFrame, k: int = K, radius_km: float = LOCAL_KM, buffer_minutes: int = BUFFER_S // 60,
                          unknown_minutes: int = UNKNOWN_MIN, least: float = LEAST_SCORE, cutoff_minutes: float = CUTOFF_MIN, coarse: bool = False) -> DataFrame:
    """Selected candidates, with weights and futures, of each incident at each node it is local to. windows: with features (see timeseries)."""
    local = local_incidents(incidents, routes, radius_km)
    free = incident_free(windows, local, buffer_minutes, unknown_minutes)
    queries = windows.join(local.select("incident_id", "node", "step"), ["node", "step"])
    return with_futures(select_candidates(candidate_scores(queries, free, cutoff_steps(cutoff_minutes), coarse), k, least), windows)


def update_counterfactual(selected: DataFrame, windows: DataFrame, incidents: DataFrame, fresh: DataFrame, routes: DataFrame, k: int = K, radius_km: float = LOCAL_KM, buffer_minutes: int = BUFFER_S // 60,
                          unknown_minutes: int = UNKNOWN_MIN, least: float = LEAST_SCORE, cutoff_minutes: float = CUTOFF_MIN) -> DataFrame:
    """normal_counterfactual of incidents and fresh together, from that of incidents alone (`selected`).

    A fresh incident takes windows away, at its nodes and in its stretch of time. Of the old queries only those that had chosen such a window are scored anew: any other window that goes was not the best of its day
    or not of a day among the k best, so the rest of a selection stands. Routes are those of both; ids of fresh incidents must not be among the old ones.
    """
    by = ["incident_id", "node"]
    known, new = local_incidents(incidents, routes, radius_km), local_incidents(fresh, routes, radius_km)
    held = written(selected.drop("fut"), "held")
    lost = exclusions(new, buffer_minutes, unknown_minutes).select("node", "lo", "hi")
    chosen = held.select(*by, "step").withColumn("__sec", F.col("step") * 3600)
    touched = chosen.join(interval_anti_join(chosen, "__sec", lost, ["node"]).select(*by, "step"), [*by, "step"], "left_anti").select(*by).distinct()
    again = written(touched.unionByName(new.select(*by)).distinct(), "again")
    queries = known.select(*by, "step").unionByName(new.select(*by, "step")).join(again, by, "left_semi")
    free = incident_free(windows.join(again.select("node").distinct(), "node", "left_semi"), known.select("node", "dt", "duration_minutes").unionByName(new.select("node", "dt", "duration_minutes")), buffer_minutes, unknown_minutes)
    scored = candidate_scores(windows.join(queries, ["node", "step"]), free, cutoff_steps(cutoff_minutes))
    fixed = select_candidates(scored, k, least)
    return with_futures(held.join(again, by, "left_anti").unionByName(fixed.select(*held.columns)), windows)


def weighted_quantiles(rows: DataFrame, by: list[str], value: str, weight: str, tie: str, qs: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """For each group the first value, in order, at which the running weight reaches q of the total (no interpolation)."""
    w = Window.partitionBy(*by)
    run = F.sum(weight).over(w.orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0))
    r = rows.withColumn("__run", F.round(run, 9)).withColumn("__all", F.sum(weight).over(w)).withColumn("__last", F.max(value).over(w))
    out = [F.coalesce(F.min(F.when(F.col("__run") >= F.round(F.col("__all") * q, 9), F.col(value))), F.max("__last")).alias(f"p{round(q * 100)}") for q in qs]
    return r.groupBy(*by).agg(*out)
