"""Ranks within skewed groups against sorting each group."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wayglass.operators import patterns, ranks, timeseries


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of all rows, one value a third; a null key, ties."""
    rnd = random.Random(1)
    rows = [(i, "hot" if i % 3 else rnd.choice(["a", "b", None]), 7.0 if i % 3 == 1 else round(rnd.random(), 2)) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, k string, x double").repartition(6)


def test_ranks_match_sorting(skewed):
    groups = defaultdict(list)
    for r in skewed.collect():
        groups[r.k].append((r.x, r.id))
    wanted = sorted((i, rank, len(g)) for g in groups.values() for rank, (_, i) in enumerate(sorted(g), 1))
    found = ranks.ranked(skewed, ["k"], [F.col("x"), F.col("id")], total="n", ranges=16)
    assert sorted((r.id, r["rank"], r.n) for r in found.collect()) == wanted
    falling = ranks.ranked(skewed, [], [-F.col("x"), F.col("id")], "place").collect()
    assert [i for _, i in sorted((r.place, r.id) for r in falling)] == [i for _, i in sorted((-x, i) for g in groups.values() for x, i in g)]


def test_no_task_gets_a_whole_group(skewed, monkeypatch):
    kept = []
    monkeypatch.setattr(ranks, "written", lambda df, tag, f=ranks.written: kept.append(f(df, tag)) or kept[-1])
    found = ranks.ranked(skewed, ["k"], [F.col("x")], ranges=16)  # no tie-break of one's own: equal values are still cut
    assert found.groupBy("k").agg(F.countDistinct("rank").alias("n"), F.count("*").alias("m")).where("n <> m").count() == 0
    most = kept[0].groupBy(F.shiftright("__row", 33)).count().agg(F.max("count")).first()[0]
    assert most < 3 * 3000 / 16


def test_minimax_and_splits_of_skewed_groups(spark, skewed):
    rows = skewed.withColumn("y", F.pmod(F.col("id") * 7, F.lit(11)) / 11.0)
    found = {r.id: r["rank"] for r in patterns.minimax(rows, ["k"], ["x", "y"], [F.col("id")]).collect()}
    groups = defaultdict(list)
    for r in rows.collect():
        groups[r.k].append((sorted((r.x, r.y), reverse=True), r.id))
    assert found == {i: rank for g in groups.values() for rank, (_, i) in enumerate(sorted(g), 1)}
    parts = timeseries.chronological_split(skewed.select("id", "k"), "id", group=["k"]).collect()
    for k, g in groups.items():
        n, ids = len(g), sorted(i for _, i in g)
        first, second = round(n * 0.7), round(n * 0.15)
        wanted = {i: "train" if p < first else "val" if p < first + second else "test" for p, i in enumerate(ids)}
        assert {r.id: r.split for r in parts if r.k == k} == wanted


def test_nothing_to_rank(spark):
    assert ranks.ranked(spark.createDataFrame([], "k string, x int"), ["k"], [F.col("x")]).collect() == []
