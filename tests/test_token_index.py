"""Top-k of token sets through the index against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from wayglass.operators import token_index
from wayglass.operators.similarity import token_cosine, top_k


def rows(df):
    return sorted(tuple(r) for r in df.select("a_id", "rank", "b_id", "score").collect())


def all_pairs(items, k):
    own = items.where(F.size("tokens") > 0).withColumn("tokens", F.array_distinct("tokens"))
    return rows(top_k(token_cosine(own, own).where("a_id <> b_id").withColumn("score", F.round("score", 4)), ["a_id"], [F.desc("score"), F.col("b_id")], k))


def sets(n, seed):
    """Sets with hot and rare tokens, near copies, subsets, many copies of one, empty ones and one that shares nothing."""
    rnd = random.Random(seed)
    out = [[*{f"hot{rnd.randint(0, 3)}" for _ in range(2)}, *{f"t{int(rnd.paretovariate(0.7))}" for _ in range(rnd.randint(1, 12))}] for _ in range(n)]
    out += [s[:-1] + ["x"] for s in out[:10]] + [s[: len(s) // 2 + 1] for s in out[10:20]] + [out[0]] * 25 + [[], [], ["alone"], ["a", "a", "b"], ["b", "a"]]
    return [(i, s) for i, s in enumerate(out)]


@pytest.mark.parametrize(("seed", "k", "rounds"), [(1, 3, token_index.ROUNDS), (2, 1, (0.5,)), (3, 30, (0.9, 0.2)), (4, 3, ())])
def test_topk_equals_scoring_everything(spark, seed, k, rounds):
    items = spark.createDataFrame(sets(90, seed), "id long, tokens array<string>")
    assert rows(token_index.token_topk(items, k, rounds=rounds)) == all_pairs(items, k)


def test_few_pairs_are_compared_where_sets_have_likes(spark):
    rnd = random.Random(6)
    heads = [[f"h{h}-{i}" for i in range(20)] + [f"hot{i}" for i in range(5)] for h in range(40)]
    items = spark.createDataFrame([(i, sorted(rnd.sample(heads[i % 40], 22))) for i in range(400)], "id long, tokens array<string>")
    seen = {}
    found = token_index.token_topk(items, 3, seen=seen)
    assert rows(found) == all_pairs(items, 3) and sum(seen.values()) < 0.1 * 400 * 399  # hot tokens alone would pair all


def test_copies_are_folded(spark):
    items = spark.createDataFrame([(i, ["a", "b"]) for i in range(300)] + [(300, ["a", "c"])], "id long, tokens array<string>")
    seen = {}
    found = rows(token_index.token_topk(items, 2, seen=seen))
    assert found == all_pairs(items, 2) and sum(seen.values()) <= 2 * len(seen)


def test_nothing_to_search(spark):
    assert token_index.token_topk(spark.createDataFrame([], "id long, tokens array<string>"), 3).collect() == []
