"""Micro-fixtures with answers worked out by hand, and properties."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from wayglass.functions import arrays as A
from wayglass.functions import keys as K
from wayglass.operators import counterfactual as N
from wayglass.operators import memory as M
from wayglass.operators import metrics as E
from wayglass.operators import patterns as R
from wayglass.operators import context, forecasts, records, spatial
from wayglass.operators import similarity as V
from wayglass.operators import timeseries as TS


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_interval_edges_are_inclusive(spark):
    at = lambda h, m: (h * 60 + m) * 60
    rows = spark.createDataFrame([(at(10, 25), "n"), (at(10, 30), "n"), (at(13, 25), "n"), (at(13, 30), "n")], "sec long, node string")
    inc = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12), 30)], "dt timestamp_ntz, duration_minutes long")
    spans = N.exclusions(inc).select("lo", "hi")
    kept = {r.sec for r in N.interval_anti_join(rows, "sec", spans).collect()}
    assert kept == {at(10, 25), at(13, 30)}
    swept = {r.sec for r in N.interval_anti_join_sweep(rows, "sec", spans.withColumn("node", F.lit("n")), "node").collect()}
    assert swept == kept


@pytest.mark.parametrize(("d", "want"), [(0.0, 60), (-5.0, 60), (math.nan, 60), (45.0, 45), (None, 60)])
def test_unknown_durations(spark, d, want):
    assert value(spark, N.effective_minutes(F.lit(d).cast("double"))) == want


def test_one_candidate_a_day_and_weights(spark):
    day = [dt.date(2024, 1, n) for n in (1, 1, 2, 3)]
    rows = [(1, "n", 99, i, day[i], s, [float(i)] * 12) for i, s in enumerate((0.90, 0.85, 0.80, 0.70))]
    df = spark.createDataFrame(rows, "incident_id long, node string, query_step long, step long, day date, score double, fut array<double>")
    got = N.select_candidates(df, k=2).orderBy("rank").collect()
    assert [g.score for g in got] == [0.90, 0.80]
    assert [round(g.weight, 4) for g in got] == [0.5294, 0.4706]
    r = N.reference(N.select_candidates(df, k=2)).first()
    mean = 2 * 0.8 / 1.7
    assert round(r.ess, 4) == 1.9931 and (r.n, r.least_score) == (2, 0.8) and r.mean_score == pytest.approx(0.85)
    assert r.normal == pytest.approx(mean) and r.spread == pytest.approx(math.sqrt((0.9 * mean**2 + 0.8 * (2 - mean) ** 2) / 1.7))


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("g", 10.0, 0.2, 1), ("g", 20.0, 0.3, 2), ("g", 30.0, 0.5, 3)], "g string, v double, w double, id int")
    r = N.weighted_quantiles(df, ["g"], "v", "w", "id").first()
    assert (r.p10, r.p50, r.p90) == (10.0, 20.0, 30.0)


def test_shape_and_direction(spark):
    e, ref = lit([0, 0, 0, 5, 5, 5, 5, 5, 5, -5, -5, -5]), lit([100] * 12)
    assert value(spark, TS.shape_code(e, ref)) == "UFD"
    assert value(spark, TS.effect_direction(e, ref)) == "neutral"
    assert value(spark, F.round(TS.prefix_similarity(F.lit("UFD"), F.lit("UFF")), 6)) == round(2 / 3, 6)


def test_calendar_and_circular_hour(spark):
    assert [value(spark, K.period(F.lit(h))) for h in (5, 6, 10, 16, 20)] == ["night", "morning_peak", "midday", "evening_peak", "night"]
    assert round(value(spark, K.circular(F.lit(23), F.lit(1), 24)), 4) == 0.933


def test_changepoint_and_robust_scale(spark):
    c = TS.changepoint(lit([10] * 6 + [30] * 6))
    assert (value(spark, c["index"]), value(spark, c["direction"]), value(spark, c["magnitude"])) == (5, 1, 2.0)
    z = value(spark, A.robust_normalise(lit(range(1, 13))))
    assert round(z[0], 4) == -1.2366


def test_cosine_and_changepoint_edge_rules(spark):
    zero, one = lit([0, 0]), lit([1, 0])
    assert value(spark, A.cosine(zero, zero)) == 1.0
    assert value(spark, A.cosine(zero, one)) == 0.0
    flat, jump = lit([100] * 12), lit([100] * 6 + [200] * 6)
    assert value(spark, V.changepoint_similarity(flat, flat)) == 1.0
    assert value(spark, V.changepoint_similarity(flat, jump)) == 0.0


@pytest.mark.parametrize(("km", "want"), [(0.0, 0), (0.5, 0), (0.50001, 1), (1.0, 1), (1.5, 2), (1.6, None), (None, None)])
def test_bands(spark, km, want):
    assert value(spark, spatial.band(F.lit(km).cast("double"))) == want


def test_shortest_path_prefers_the_smallest_path(spark):
    g = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 4, 1.0), (3, 4, 1.0), (4, 1, 1.0)], "src int, dst int, weight double")
    got = {r.node: (r.hops, r.path) for r in spatial.shortest_paths(g, 1, 3).collect()}
    assert got[4] == (2, [1, 2, 4]) and len(got) == 4


def test_only_local_incidents_exclude_a_node(spark):
    noon = dt.datetime(2024, 1, 1, 12)
    inc = spark.createDataFrame([(1, noon, 30), (2, noon, 30), (3, noon, 30)], "incident_id long, dt timestamp_ntz, duration_minutes long")
    routes = spark.createDataFrame([(1, "near", 5.0), (1, "far", 5.01), (2, "far", None), (2, "near", None), (3, "far", -1.0), (3, "near", math.nan)], "incident_id long, node string, km double")
    local = N.local_incidents(inc, routes)
    assert [(r.incident_id, r.node) for r in local.collect()] == [(1, "near")]
    w = spark.createDataFrame([(n, s) for n in ("near", "far") for s in range(24)], "node string, step long")
    free = {(r.node, r.step) for r in N.incident_free(w, local).collect()}
    assert {s for n, s in free if n == "far"} == set(range(24)) and {s for n, s in free if n == "near"} == set(range(24)) - {11, 12, 13}


def test_time_filter_keeps_the_alike_and_the_best(spark):
    day = dt.date(2024, 1, 3)
    rows = [(1, 500, day, 10, 2, False, "midday", s, dt.date(2024, 7 + s % 2, 6), s % 24, 5, True, "night") for s in range(30)] + [(1, 500, day, 10, 2, False, "midday", 40, day, 10, 2, False, "midday")]
    names = "incident_id long, q_step long, q_day date, q_hour int, q_weekday int, q_free boolean, q_period string, c_step long, c_day date, c_hour int, c_weekday int, c_free boolean, c_period string"
    p = spark.createDataFrame(rows, names)
    kept = {r.c_step for r in N.time_filter(p, ["incident_id"], limit=31, top=3).collect()}
    assert kept == {*range(30), 40}
    broad = {s for s in range(30) if min(abs(10 - s % 24), 24 - abs(10 - s % 24)) <= 3} | {40}
    assert {r.c_step for r in N.time_filter(p, ["incident_id"], limit=20, top=3).collect()} == broad
    assert 40 in {r.c_step for r in N.time_filter(p, ["incident_id"], limit=5, top=3).collect()} and N.time_filter(p, ["incident_id"], 5, 3).count() == 5


@pytest.mark.parametrize(("x", "want"), [(2.675, 2.67), (2.5, 2.5), (0.125, 0.12), (0.375, 0.38), (1.005, 1.0), (-2.675, -2.67), (1e15, 1e15), (5.015, 5.01), (0.285, 0.28), (1.115, 1.11)])
def test_rounding_of_the_binary_value(spark, x, want):
    assert value(spark, K.round_half_even(F.lit(x))) == want == round(x, 2)


def test_rounding_of_many_values(spark):
    import random

    rnd = random.Random(1)
    xs = [rnd.randrange(10**6) / 1000 for _ in range(500)] + [rnd.uniform(0, 1000) for _ in range(500)]
    got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, v double").orderBy("i").select(K.round_half_even(F.col("v")).alias("x")).collect()]
    assert got == [round(x, 2) for x in xs]


def test_recovery_and_gap(spark):
    h, n = lit(range(12)), lit([20] * 12)
    r = N.recovery(h, n)
    assert (value(spark, r["last_flow"]), round(value(spark, r["history_slope"]), 9), value(spark, r["normal_slope"]), value(spark, r["change"])[0]) == (11.0, 1.0, 0.0, 9.0)
    assert value(spark, N.forecast_gap(n, lit([18] * 12))) == 2.0 and value(spark, N.forecast_gap(n, lit([1] * 3))) is None


def test_local_outcomes(spark):
    y = [10.0, 0.0, 10.0, 10.0, math.nan, 10.0] + [10.0] * 6
    rows = [(1, h + 1, v, 12.0, 11.0 if h < 6 else None, 11.0 if h < 3 else 13.0 if h < 6 else 12.0) for h, v in enumerate(y)]
    df = spark.createDataFrame(rows, "id int, horizon int, y double, base double, normal double, prediction double")
    got = {r.start_step: (r.end_step, r.valid_points, r.base_mae, r.normal_mae, r.prediction_bias, r.outcome) for r in E.local_outcomes(df, ["id"]).collect()}
    assert got == {1: (3, 2, 2.0, 1.0, 1.0, "improved"), 4: (6, 2, 2.0, 1.0, 3.0, "degraded"), 7: (12, 6, 2.0, None, 2.0, "equal")}
    own = spark.createDataFrame([(1, 2, 5), (2, 1, 12)], "id int, start_step int, end_step int")
    assert [(r.start_step, r.valid_points) for r in E.local_outcomes(df, ["id"], own).collect()] == [(2, 2)]


def test_incidents_are_chosen_once_in_time_order(spark):
    el = spark.createDataFrame([(i, dt.datetime(2024, 1, 9 - i)) for i in range(1, 6)], "incident_id long, dt timestamp_ntz")
    assert [r.incident_id for r in E.choose_incidents(el, [2, 4, 2], el).collect()] == [4, 2]
    assert [r.incident_id for r in E.choose_incidents(el, None, el.where("incident_id < 3")).collect()] == [2, 1]
    with pytest.raises(ValueError, match="9"):
        E.choose_incidents(el, [9], el)


def test_paired_state(spark):
    s = R.paired_state(lit([10] * 12), lit([8] * 12), lit([12] * 12), lit([9] * 12), lit([0] * 6 + [10] * 6), F.lit(2.0))
    got = {k: value(spark, c) for k, c in s.items()}
    assert (got["base_rmse"], got["normal_rmse"], got["gap_rmse"], got["base_offset"], got["base_shape_rmse"]) == (2.0, 1.0, 1.0, 2.0, 0.0)
    assert (got["sign_agreement"], got["valid_steps"], got["base_mae"], got["normal_mae"]) == (1.0, 6, 2.0, 1.0) and round(got["base_alike"], 6) == round(math.exp(-1), 6)


def test_evidence_groups_order(spark):
    rows = [(1, "a", 0.9, 0.1, 5, 0.5), (1, "b", 0.85, 0.9, 4, 0.4), (1, "c", 0.1, 0.2, 1, 0.9), (1, "d", 0.2, 0.3, 2, 0.8), (1, "e", 0.3, 0.1, 9, 0.99)]
    df = spark.createDataFrame(rows, "q int, id string, network_time double, history double, state int, score double")
    got = [(r.id, r.groups) for r in R.evidence_groups(df, ["q"], 0.8, 2, "score").orderBy("place").collect()]
    assert got == [("b", ["network_time", "history"]), ("a", ["network_time"]), ("c", ["state"]), ("d", ["state"])]


def test_memory_pieces(spark):
    c = lambda x: F.lit(x).cast("string")
    assert value(spark, M.physical_similarity([(c("1"), c("1")), (c("N"), c("S")), (c(None), c("x"))])) == 0.5
    assert value(spark, M.physical_similarity([(c(None), c("1"))])) == 0.5
    bands = F.array(F.struct(F.lit(4.0).alias("mae"), F.lit(-2.0).alias("bias")), F.struct(F.lit(6.0).alias("mae"), F.lit(None).cast("double").alias("bias")))
    assert value(spark, M.reliability(bands, F.lit(2.0))) == [2.0, -1.0, 3.0, 0.0, 0.0, 0.0]
    e = value(spark, M.local_evidence(lit([1, 5, 2, 2, 2, 2, 2, 2, 2, 3, 5, 4]), lit([1, 2]), F.lit(None).cast("array<double>"), lit([3, 4]), lit([5, 6])))
    assert (e.last_step, e.last_steps, e.steepest_before, e.latest, e.normal, e.truth.last) == (-1.0, [1.0, 2.0, -1.0], 4.0, 4.0, None, 6.0)
    df = spark.range(1)
    assert [value(spark, M.effect_direction(F.lit(x))) for x in (0.6, 0.5, -0.6)] == ["increase", "flat", "decrease"]
    with pytest.raises(ValueError, match="k and half_life"):
        M.retrieve(df, df, df, k=0)


def test_whole_episodes(spark):
    hist, base = [float(x) for x in (4, 6, 5, 7, 3, 4, 6, 5, 7, 8, 6, 5)], [5.0] * 12
    truth = [0.0, 6.0, 7.0, 0.0, 0.0, 0.0, 9.0, 3.0, float("nan"), 5.0, 8.0, 2.0]
    better, worse = [y or 1.0 for y in truth], [9.0] * 12
    better[8] = 1.0
    at = dt.datetime(2024, 1, 1, 10, 13, 59)
    rows = [(7, 3, 1, at, hist, base, [6.0] * 12, better, truth), (8, 3, 1, at, hist, base, None, worse, truth), (9, 3, 1, at, [0.0] * 12, base, None, base, truth), (10, 3, 1, at, hist, base, None, base, [0.0] * 12)]
    df = spark.createDataFrame(rows, "incident_id int, node int, layer int, dt timestamp_ntz, hist array<double>, base array<double>, normal array<double>, prediction array<double>, fut array<double>")
    made = {r.incident: r for r in M.build_episodes(df).withColumn("worth", M.learning_relevance(F.col("outcomes"), min_base=1.5)).collect()}
    r = made[7]
    assert (r.memory_id, r.origin, r.available, r.hour) == ("incident_7_node_3_layer_1", dt.datetime(2024, 1, 1, 10, 10), dt.datetime(2024, 1, 1, 11, 10), 10)
    valid = [(b, p, y) for b, p, y in zip(base, better, truth, strict=True) if y and y == y]
    assert r.metrics.base.points == len(valid) == 7 and r.metrics.base.mae == pytest.approx(sum(abs(b - y) for b, _, y in valid) / 7) and r.metrics.base.bias == pytest.approx(sum(b - y for b, _, y in valid) / 7)
    assert r.metrics.prediction.mae == 0 and r.metrics.normal.points == 7 and r.metrics.delta == -r.metrics.base.mae and (r.verdict, r.failure, r.has_normal) == ("improved", None, True)
    assert [(o.start, o.end, o.base.points, o.base.mae, o.outcome) for o in r.outcomes] == [(1, 3, 2, 1.5, "improved"), (4, 6, 0, None, None), (7, 12, 5, pytest.approx(2.4), "improved")]
    assert len(r.state) == 16 and len(r.decision) == 24 and len(r.gap) == 12 and r.worth.points == 7 and r.worth.base_mae == pytest.approx(r.metrics.base.mae) and r.worth.reason == "large_base_error"
    assert made[8].verdict == "degraded" and made[8].failure == "over_correction" and not made[8].has_normal and made[8].metrics.normal.points == 0 and made[8].gap == [0.0] * 12
    assert made[9].state is None and made[9].signature is None
    assert made[10].verdict is None and (made[10].worth.eligible, made[10].worth.reason) == (False, "no_valid_outcome")


def test_layers_run_on_the_ones_before(spark):
    scope = spark.createDataFrame([(1, 10, 0, 2.0), (1, 11, 0, 4.0), (1, 20, 1, 6.0), (1, 30, 2, 8.0), (2, 20, 1, 1.0)], "site int, sensor int, layer int, base double")
    up = spark.createDataFrame([(20, 10), (20, 11), (30, 20)], "sensor int, prev int")
    base = lambda rows: rows.select("site", "sensor", F.col("base").alias("prediction"))
    got = {(r.site, r.sensor): r.prediction for r in records.run_layers(scope, up, [base, records.own_and_upstream, records.own_and_upstream]).collect()}
    assert got == {(1, 10): 2.0, (1, 11): 4.0, (1, 20): 4.5, (1, 30): 6.25, (2, 20): 1.0}
    for broken in (lambda rows: base(rows).where("sensor <> 11"), lambda rows: base(rows).withColumn("prediction", F.lit(float("nan"))), lambda rows: base(rows).unionByName(base(rows))):
        with pytest.raises(ValueError, match="layer 0 needs"):
            records.run_layers(scope, up, [broken, base, base])


def test_responses(spark):
    import json

    good = {"target_node_id": 5, "forecast_explanation": "", "phase_analysis": [{"start_step": 1, "end_step": 12, "predicted_flow": [2.675] * 12}]}
    bodies = [good, good | {"more": 1}, {k: v for k, v in good.items() if k != "forecast_explanation"}, good | {"target_node_id": 6}, good | {"phase_analysis": [{"start_step": 1, "end_step": 0, "predicted_flow": []}]}]
    df = spark.createDataFrame([(i, json.dumps(b), 5) for i, b in enumerate([*bodies, "x"])], "i int, body string, node int")
    got = {r.i: (r.problem, r.predicted_flow) for r in records.validate_responses(df, node="node").collect()}
    assert [got[i][0] for i in range(6)] == ["", "extra keys", "missing keys", "node", "steps", "no phases"] and got[0][1] == [2.67] * 12 and got[1][1] is None


def test_previous_layer_needs_predictions(spark):
    scope = spark.createDataFrame([(1, 10, 0), (1, 11, 0), (1, 20, 1)], "site int, sensor int, layer int")
    up = spark.createDataFrame([(20, 10), (20, 99)], "sensor int, prev int")
    done = spark.createDataFrame([(1, 10, 3.0)], "site int, sensor int, prediction double")
    assert [(r.sensor, r.prev, r.prediction) for r in records.previous_layer(scope, up, done, 1).collect()] == [(20, 10, 3.0)]
    with pytest.raises(ValueError, match="10"):
        records.previous_layer(scope, up, done.limit(0), 1)


def test_forecast_tables_are_checked(spark):
    w = TS.windows(spark.createDataFrame([("n", s, float(s % 24), s, 1.0) for s in range(240)], "node string, step long, flow double, occupancy long, speed double"))
    f = {r.step: r.base for r in forecasts.forecast_table(w, "seasonal_24").collect()}
    assert f[100] == [float((100 + h) % 24) for h in range(1, 13)] and len(f) == 217
    assert all(r.base == [float(r.step % 24)] * 12 for r in forecasts.forecast_table(w, "last_value").collect())
    with pytest.raises(ValueError, match="finite"):
        forecasts.forecast_table(w, lambda x: x.select("node", "step", F.array(F.lit(1.0)).alias("base")))


def test_contexts_hide_outcomes_and_dead_sensors(spark):
    w = spark.createDataFrame([("n", 5, [1.0] * 12, [2.0] * 12), ("z", 5, [0.0] * 12, [0.0] * 12)], "node string, step long, hist array<double>, fut array<double>")
    inc = spark.createDataFrame([(1, "n", 5, 0, "k", 45), (1, "z", 5, 1, "k", 45)], "incident_id int, node string, step long, layer int, kind string, duration_minutes int")
    cases = spark.createDataFrame([(1, "n", 2, "b"), (1, "n", 1, "a"), (1, "z", 1, "a")], "incident_id int, node string, place int, id string")
    made = context.assemble(w, inc, forecasts.last_value(w), patterns=cases)
    got = {r.node: r for r in made.collect()}
    assert [x.id for x in got["n"].evidence.patterns] == ["a", "b"] and got["z"].evidence.patterns is None and got["z"].status == "missing_all_zero"
    assert "duration_minutes" not in got["n"].evidence.incident.asDict() and "fut" not in got["n"].evidence.asDict()
    assert "patterns" not in made.select(context.without("evidence", ("patterns",)).alias("e")).schema["e"].dataType.names
    r = {r.node: r for r in context.result_records(made, spark.createDataFrame([(1, "n", [3.0] * 12)], "incident_id int, node string, prediction array<double>")).collect()}
    assert r["n"].metric_mask == [True] * 12 and r["z"].metric_mask == [False] * 12 and r["z"].prediction == [0.0] * 12


def test_starts_and_months(spark):
    assert TS.window_starts(spark, 30).count() == 6 and TS.check_months([1, 5]) == [1, 5]
    for bad in ([], [2, 1], [1, 1], [0], [13]):
        with pytest.raises(ValueError, match="months"):
            TS.check_months(bad)
    with pytest.raises(ValueError, match="window"):
        TS.window_starts(spark, 24)


@pytest.mark.parametrize(("raw", "want"), [("99", "99"), ("99.0", "99"), (" US-50 ", "US-50")])
def test_road_key(spark, raw, want):
    assert value(spark, K.road_key(F.lit(raw))) == want


@pytest.mark.parametrize(
    ("y", "p", "want"),
    [([10.0, 0.0, 20.0], [12.0, 5.0, 16.0], (3.0, 0.2, 3.1623, -1.0, 2)), ([10.0, 0.0, 20.0, math.nan], [12.0, 5.0, 16.0, 1.0], (2.0, 0.1333, 2.582, -0.6667, 3)), ([0.0, 0.0], [1.0, 2.0], (0.0, 0.0, 0.0, 0.0, 0))],
)
def test_masked_metrics(spark, y, p, want):
    df = spark.createDataFrame([("g", a, b) for a, b in zip(y, p, strict=True)], "g string, y double, p double")
    r = E.masked_metrics(df, ["g"]).first()
    assert tuple(round(v, 4) for v in (r.mae, r.mape, r.rmse, r.bias)) + (r["count"],) == want


def test_effective_windows(spark):
    rows = [("g", w, 0.5, h, 10.0, 11.0) for w in (1, 2) for h in (1, 2, 3)]
    df = spark.createDataFrame(rows, "g string, window long, weight double, horizon int, y double, p double")
    got = {r.level: r for r in E.horizon_profile(df, ["g"]).collect()}
    assert got["band 1-3"].effective_windows == 2.0 and got["overall"].valid_points == 6 and got["step 2"].mae == 1.0


@pytest.mark.parametrize(("n", "want"), [(20, (14, 3, 3)), (10, (7, 2, 1)), (30, (21, 4, 5))])
def test_split(spark, n, want):
    got = {r.split: r["count"] for r in TS.chronological_split(spark.range(n), "id").groupBy("split").count().collect()}
    assert (got["train"], got["val"], got["test"]) == want


def test_minimax(spark):
    df = spark.createDataFrame([("g", "A", 0.1, 0.5), ("g", "B", 0.3, 0.4)], "g string, id string, x double, y double")
    assert [r.id for r in R.minimax(df, ["g"], ["x", "y"], [F.col("id")]).orderBy("rank").collect()] == ["B", "A"]


def test_greedy_suppression_compares_with_kept_rows_only(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 10, m)
    schema = "query_id long, memory_id long, origin timestamp_ntz, node int, rank_score double, signature string"
    df = spark.createDataFrame([(1, 1, t(0), 7, 0.9, "a"), (1, 2, t(10), 7, 0.8, "b"), (1, 3, t(20), 7, 0.7, "c"), (1, 4, t(50), 7, 0.6, "c"), (1, 5, t(50), 8, 0.5, "c")], schema)
    assert M.greedy_suppress(df).first().kept == [1, 3, 5]


def test_verdict_and_upsert(spark):
    assert [value(spark, M.verdict(F.lit(d))) for d in (-0.1, 0.0, 0.1)] == ["improved", "equal", "degraded"]
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert {(r.k, r.v) for r in M.upsert(df, ["k"], "seq").collect()} == {("a", "y"), ("b", "z")}


def test_windows_stay_in_their_chunk(spark):
    grid = spark.createDataFrame([("n", s, float(s), s, float(s)) for s in range(480)], "node string, step long, flow double, occupancy long, speed double")
    got = TS.windows(grid).collect()
    assert len(got) == 2 * 217
    assert all(r.hist == [float(x) for x in range(r.step - 11, r.step + 1)] and (r.step - 11) // 240 == (r.step + 12) // 240 for r in got)


def test_first_object(spark):
    one = '{"a":1}'
    cases = [
        ('x {"b": 1, "a": [2, {"c": "}"}]} ', '{"a":[2,{"c":"}"}],"b":1}'), ('{"a":1}{"a":1}', one), ('{"a":1}\n{ "a" : 1 }\n```', one), ('{"a":1} {"a":2}', None), ('{"a":1} {"a":', None), ('{"a":1} x', None),
        ('{"a":1}\n```', one), ('{"a":1}``', one), ('{"a":1}`', None), ('{"a":1}\\n \\t', one), ('```json\n{"a": "q\\"}{"}\n```', '{"a":"q\\"}{"}'), ('{"a": "\U0001F600 }"} ', '{"a":"\U0001F600 }"}'), ("{}", "{}"),
        ('{"a":', None), ('{"a":[}', None), ('{"a" 1}', None), ('{"a":NaN}', None), ('{"a":1,"a":2}', None), ('"{" {"a":1}', None), ("none", None), ("", None), (None, None),
        ('{"s":"' + "\\n" * 100_000 + '"}```', '{"s":"' + "\\n" * 100_000 + '"}'),
    ]
    df = records.with_first_object(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string"), "t", "x")
    assert df.columns == ["i", "t", "x"] and "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.i: r.x for r in df.collect()} == {i: x for i, (_, x) in enumerate(cases)}


def haversine(p, q):
    (a, b), (c, d) = p, q
    f, g = math.radians(a), math.radians(c)
    h = math.sin((g - f) / 2) ** 2 + math.cos(f) * math.cos(g) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * K.EARTH_KM * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


@pytest.mark.parametrize(("lat", "lng", "radius"), [(0, 10, 5.0), (38, -121, 4.0), (45, 7, 30.0), (65, 20, 5.0), (80, 179.95, 20.0), (-66, -179.9, 10.0), (89.9, 0, 15.0), (-89.95, 100, 3.0), (10, 179.99, 400.0), (0, 0, 9000.0)])
def test_radius_net_equals_all_pairs(spark, lat, lng, radius):
    import random

    rnd = random.Random(f"{lat}{lng}")
    spread = min(radius / 111, 60) * 3
    points = [(i, max(-90.0, min(90.0, lat + rnd.uniform(-spread, spread))), (lng + rnd.uniform(-spread, spread) / max(0.01, math.cos(math.radians(lat))) + 180) % 360 - 180) for i in range(50)]
    df = spark.createDataFrame([*points, (98, float("nan"), 1.0), (99, None, 1.0)], "sensor long, lat double, lng double")
    got = {(r.sensor, r.neighbour): r.km for r in spatial.within(df, radius, 1000).collect()}
    want = {(i, j): km for i, *p in points for j, *q in points if i != j and (km := haversine(p, q)) <= radius}
    assert set(got) == set(want) and got and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_radius_search_with_a_target_follows_edges(spark):
    s = spark.createDataFrame([(i, 38 + i / 100, -121.0) for i in range(6)], "sensor int, lat double, lng double")
    e = spark.createDataFrame([(0, 1, 0.6), (0, 2, 0.9), (0, 3, 0.4), (0, 5, 1.0)], "src int, dst int, weight double")
    got = [(r.neighbour, r["rank"]) for r in spatial.within(s, 3.5, 10, e).where("sensor = 0").orderBy("rank").collect()]
    assert got == [(0, 1), (2, 2), (1, 3)]
    sites = spark.createDataFrame([(7, 38.001, -121.0)], "site int, lat double, lng double")
    assert [r.neighbour for r in spatial.node_set(sites, s, 3.5, 2, e).orderBy("rank").collect()] == [0, 2]
    assert [r.neighbour for r in spatial.node_set(sites, s, 3.5, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_nearest_equals_all_pairs(spark):
    import random

    rnd = random.Random(4)
    sensors = [(i, rnd.gauss(38, 0.01) if i % 4 else rnd.uniform(30, 50), rnd.gauss(-121, 0.01) if i % 4 else rnd.uniform(-130, -110), f"r{i % 3}") for i in range(80)]
    sites = [(i, rnd.uniform(20, 60), rnd.uniform(-140, -100), f"r{i % 4}") for i in range(60)] + [(100 + i, 38 + i / 1000, -121.0, "r0") for i in range(20)]
    a, b = spark.createDataFrame(sites, "site long, lat double, lng double, road string"), spark.createDataFrame(sensors, "sensor long, lat double, lng double, road string")
    for keys in (None, ["road"]):
        got = {r.site: r.sensor for r in spatial.nearest(a, b, keys).collect()}
        assert got == {s: min(((round((x - u) ** 2 + (y - v) ** 2, 10), n) for n, u, v, w in sensors if not keys or w == road), default=(0, None))[1] for s, x, y, road in sites}
    assert all(r.sensor is None for r in spatial.nearest(a, b.limit(0)).collect())


def test_topology_and_many_sources(spark):
    g = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (5, 1, 1.0)], "src int, dst int, weight double")
    at = spark.createDataFrame([(i, float(i), 0.0) for i in range(1, 7)], "node int, lat double, lng double")
    asked = spark.createDataFrame([(1, 3), (5, 3), (1, 5), (2, 2)], "source int, target int")
    got = {(r.source, r.target): (r.connected, r.hops, r.path, r.km and round(r.km)) for r in spatial.topology(asked, g, at, 6).collect()}
    assert got == {(1, 3): (True, 2, [1, 2, 3], 222), (5, 3): (True, 3, [5, 1, 2, 3], 667), (1, 5): (False, None, None, None), (2, 2): (True, 0, [2], 0.0)}


def test_hashed_text_recall_has_all_texts(spark, tmp_path):
    import hashlib
    import re

    from wayglass.plans import catalog

    texts = ["Straße gesperrt", "strasse  gesperrt", "Café fermé à midi", "CAFÉ fermé à minuit", "lane closed", "the lane is closed", "東京 高速道路", "東京 道路"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.a_id, r.b_id): r.score for r in catalog.hashed_text_vector_recall(spark, str(tmp_path)).collect()}
    dim, vectors = V.FIELD_DIMS["description"], []
    for t in texts:
        value = " ".join(t.lower().split())
        words = re.findall(r"[^\W_]+", value)
        joined = "".join(words)
        x = {}
        for token in {value, *words, *(joined[i : i + n] for n in (3, 4) for i in range(len(joined) - n + 1))}:
            bucket = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim
            x[bucket] = x.get(bucket, 0) + 1
        vectors.append(x)
    dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
    want = {}
    for a, x in enumerate(vectors):
        scored = [(-round(dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)), 4), b) for b, y in enumerate(vectors) if b != a and dot(x, y)]
        want |= {(a, b): -s for s, b in sorted(scored)[:3]}
    assert {a for a, _ in got} == set(range(len(texts))) and got == pytest.approx(want, abs=1e-4)
