"""The vector index against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from wayglass.operators import blocks, patterns, similarity, vector_index
from wayglass.operators.similarity import cosine_recall


def bundles(n, dims=6, around=8, spread=0.05, seed=3):
    """Vectors in bundles, with zeros, repeats and opposite ones."""
    rnd = random.Random(seed)
    heads = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(around)]
    out = [[x + rnd.gauss(0, spread) for x in rnd.choice(heads)] for _ in range(n - 6)]
    return [*out, [0.0] * dims, [0.0] * dims, out[0], out[0], [-x for x in out[0]], [2 * x for x in out[1]]]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize(("spread", "cells", "k"), [(0.05, None, 5), (3.0, 7, 3), (0.05, 1, 4), (0.02, 40, 1), (0.05, 9, 500)])
def test_search_equals_scoring_everything(spark, spread, cells, k):
    items = spark.createDataFrame(list(enumerate(bundles(240, spread=spread))), "id long, v array<double>")
    asked = items.where("id % 10 = 0 or id >= 234")
    found = vector_index.search(vector_index.build_index(items, cells=cells), asked, k)
    wanted = cosine_recall(asked, items, k)
    assert rows(found, "query_id", "rank", "item_id", "score") == rows(wanted, "query_id", "rank", "item_id", "score")


def test_bundled_vectors_are_mostly_not_scored(spark):
    items = spark.createDataFrame(list(enumerate(bundles(2000, dims=16, around=30))), "id long, v array<double>")
    asked, seen = items.where("id % 50 = 0"), {}
    found = vector_index.search(vector_index.build_index(items), asked, 5, seen=seen)
    assert rows(found, "query_id", "item_id", "score") == rows(cosine_recall(asked, items, 5), "query_id", "item_id", "score")
    assert sum(seen.values()) < 0.25 * asked.count() * items.count()


def test_a_cell_of_copies_is_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 20)
    vectors = [[1.0, 2.0, 3.0]] * 150 + bundles(60, dims=3)
    items = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>")
    index = vector_index.build_index(items, cells=5)
    assert index.items.groupBy("cell", "part").count().agg(F.max("count")).first()[0] <= 60 and index.items.count() == len(vectors)
    asked = items.where("id % 25 = 0")
    assert rows(vector_index.search(index, asked, 8), "query_id", "rank", "item_id") == rows(cosine_recall(asked, items, 8), "query_id", "rank", "item_id")


def test_search_within_keys_and_up_to_a_time(spark):
    rnd = random.Random(9)
    items = spark.createDataFrame([(i, rnd.choice("ab"), rnd.randint(0, 60), v) for i, v in enumerate(bundles(150))], "id long, node string, step long, v array<double>")
    index = vector_index.build_index(items, ("node",), "step", width=10, cells=6)
    found = vector_index.search(index, items, 4, "step", lag=2)
    wanted = patterns.recall_all_pairs(items, "v", 4, 2)
    assert rows(found, "query_id", "node", "item_id", "score", "rank") == rows(wanted, "query_id", "node", "id", "score", "rank")


def test_empty_and_missing_vectors(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert vector_index.search(vector_index.build_index(none), none, 3).collect() == []
    some = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [0.0, 0.0])], "id long, v array<double>")
    assert rows(vector_index.search(vector_index.build_index(some), some, 3), "query_id", "item_id", "score") == [(2, 3, 1.0), (3, 2, 1.0)]


def test_few_pairs_are_scored_one_by_one(spark):
    rnd = random.Random(5)
    items = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(16)]) for i in range(3000)], "id long, v array<double>")
    asked, seen = items.where("id % 100 = 0"), {}
    found = vector_index.search(vector_index.build_index(items), asked, 10, seen=seen)
    assert rows(found, "query_id", "rank", "item_id", "score") == rows(cosine_recall(asked, items, 10), "query_id", "rank", "item_id", "score")
    assert seen.get("exact", sum(seen.values())) <= 30 * 12  # of 90,000


@pytest.mark.parametrize("k", [3, 100])
def test_vectors_that_cannot_be_multiplied_are_scored_exactly(spark, monkeypatch, k):
    monkeypatch.setattr(vector_index, "PART", 20)
    monkeypatch.setattr(blocks, "QUERIES", 7)
    monkeypatch.setattr(blocks, "CELLS", 100)
    odd = [[float("nan"), 1.0, 2.0], [1.0, None, 2.0], [float("inf"), 1.0, 0.0], [1e-200, 0.0, 0.0], [1.0, 2.0], [], [0.0, float("nan"), 0.0]]
    items = spark.createDataFrame([*enumerate(odd + bundles(90, dims=3)), (None, [1.0, 2.0, 3.0]), (500, None)], "id long, v array<double>")
    asked = items.where("id % 9 = 0 or id < 7 or id > 90 or id is null")
    unit = lambda df, names: df.where("v is not null").select("id", similarity.unit(F.col("v")).alias("v")).toDF(*names)
    pairs = unit(asked, ["query_id", "q"]).crossJoin(unit(items, ["item_id", "u"])).where("query_id <> item_id")
    wanted = similarity.top_k(pairs.select("query_id", "item_id", vector_index._alike(F.col("q"), F.col("u"), 4).alias("score")), ["query_id"], [F.desc("score"), F.col("item_id")], k)
    found = vector_index.search(vector_index.build_index(items, cells=6), asked, k)
    assert rows(found, "query_id", "rank", "item_id", "score") == rows(wanted, "query_id", "rank", "item_id", "score")
