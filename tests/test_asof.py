"""Joins and totals along time against brute force."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wayglass.operators.asof import asof_join, running_totals

LEFT, RIGHT = "id long, k string, t double", "k string, s double, tie long, v string"


def last_before(row, right, strict, tolerance):
    _, k, t = row
    if k is None or t is None or t != t:
        return None
    fits = [r for r in right if r[0] == k and r[1] is not None and r[1] == r[1] and (r[1] < t if strict else r[1] <= t) and (tolerance is None or t - r[1] <= tolerance)]
    return max(fits, key=lambda r: (r[1], r[2]))[3] if fits else None


def check(spark, left, right, width, strict, tolerance):
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    found = asof_join(a, b, ["k"], "t", ["v"], width, right_time="s", strict=strict, tolerance=tolerance, tie="tie")
    wanted = [(*row, last_before(row, right, strict, tolerance)) for row in left]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))


keys, times = st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-8, 8).map(float))


@given(st.lists(st.tuples(keys, times), max_size=12), st.lists(st.tuples(keys, times), max_size=12), st.sampled_from([1.0, 3.0, 100.0]), st.booleans(), st.sampled_from([None, 0.0, 2.0]))
@settings(deadline=None, max_examples=12, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_asof_matches_brute_force(spark, left, right, width, strict, tolerance):
    check(spark, [(i, *r) for i, r in enumerate(left)], [(k, t, i, f"v{i}") for i, (k, t) in enumerate(right)], width, strict, tolerance)


def test_asof_over_one_hot_key(spark):
    rnd = random.Random(2)
    left = [(i, "a" if i % 3 else None, rnd.randint(0, 400) / 2) for i in range(300)] + [(300, "a", float("nan"))] * 2
    right = [("a", rnd.randint(0, 60) / 2, i, f"v{i}") for i in range(200)]  # many stretches without a right row
    check(spark, left, right, 7.0, False, None)
    check(spark, left, right, 7.0, True, 30.0)


def test_asof_joins_on_more_keys_or_none(spark):
    left = spark.createDataFrame([(1, "a", 5.0), (2, "b", 5.0), (2, "a", 9.0)], "g int, k string, t double")
    right = spark.createDataFrame([(1, "a", 4.0, 1), (2, "a", 8.0, 2), (2, "b", 6.0, 3)], "g int, k string, t double, v int")
    assert sorted((r.g, r.k, r.v) for r in asof_join(left, right, ["g", "k"], "t", ["v"], 2.0).collect()) == [(1, "a", 1), (2, "a", 2), (2, "b", None)]
    with pytest.raises(ValueError):
        asof_join(left, right, ["g"], "t", ["k"], 2.0)


def test_asof_has_no_join_on_the_key_alone(spark):
    left, right = spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT)
    found = asof_join(left, right, ["k"], "t", ["v"], 5.0, right_time="s")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.collect() == [] and plan.count("Join") == 1 and "__part" in plan[plan.index("Join") : plan.index("Join") + 200]


@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 30), st.integers(-5, 5)), min_size=1, max_size=20))
@settings(deadline=None, max_examples=8, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_running_totals_match_brute_force(spark, rows):
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, k string, t long, x long")
    from pyspark.sql import functions as F

    found = running_totals(df, ["k"], "t", {"total": F.col("x"), "n": F.lit(1)}, 4.0, tie="id").collect()
    for r in found:
        upto = [x for i, k, t, x in rows if k == r.k and (t, i) <= (r.t, r.id)]
        assert (r.total, r.n) == (sum(upto), len(upto))
