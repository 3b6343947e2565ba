"""Exact top-k by the cosine of token sets, through an inverted index that is read from the rarest tokens on and no further than a bound asks.

Two sets of a and b tokens with a cosine of t or more share at least t * sqrt(a * b) tokens, so if both are read in one order, rarest first, they meet within their first a - t * t * a + 1 and b - t * t * b + 1 tokens.
Sets are searched in rounds of falling thresholds; a set is done when its k-th score reaches the round's, as every better partner has then been met. Places of the met token and sizes bound what a pair can still share,
and only pairs that can reach the threshold are compared. Equal sets are folded to one before all this and unfolded after it, so copies of a text cost k + 1 rows each, whatever their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from wayglass.operators.similarity import top_k
from wayglass.sources.scratch import written

#: Thresholds of the rounds before the last, which has none.
ROUNDS = (0.7, 0.35)


def folded(items: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(cls, tokens, n, copies) of each distinct set, cls being its least id, and (cls, id) of all items. Sets are compared whole. Empty sets are left out."""
    own = items.where(F.size("tokens") > 0).select("id", F.array_sort(F.array_distinct("tokens")).alias("tokens"))
    sets = written(own.groupBy("tokens").agg(F.min("id").alias("cls"), F.count("*").alias("copies")).withColumn("n", F.size("tokens")), "sets")
    members = own.join(sets.select("tokens", "cls"), "tokens").select("cls", "id")
    return sets, written(members, "members")


def ordered(sets: DataFrame) -> DataFrame:
    """(cls, n, token, at): the place of each token in its set, the rarest of all sets first."""
    spread = sets.select("cls", "n", F.explode("tokens").alias("token"))
    often = spread.groupBy("token").agg(F.count("*").alias("df"))
    return written(spread.join(often, "token").withColumn("at", F.row_number().over(Window.partitionBy("cls").orderBy("df", "token"))).select("cls", "n", "token", "at"), "tokens")


def token_topk(items: DataFrame, k: int, digits: int = 4, rounds: tuple[float, ...] = ROUNDS, seen: dict[str, int] | None = None) -> DataFrame:
    """a_id, b_id, score, rank: of each item (id, tokens) the k others most alike; pairs that share no token are left out. seen: gets the pairs of sets compared in each round."""
    slack = 10.0**-digits
    sets, members = folded(items, k)
    index = ordered(sets)
    rest, found = sets.select("cls"), []
    for t in [*rounds, 0.0]:
        least = max(t - slack, 0.0)
        reach = F.col("at") <= F.col("n") - F.ceil(F.col("n") * least * least) + 1
        side = lambda df, p: df.where(reach).select(F.col("cls").alias(f"{p}_cls"), F.col("n").alias(f"{p}_n"), "token", F.col("at").alias(f"{p}_at"))  # noqa: B023, E731
        needed = F.sqrt(F.col("a_n").cast("double") * F.col("b_n")) * least
        left = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) + 1
        met = side(index.join(rest, "cls", "left_semi"), "a").join(side(index, "b"), "token").where("a_cls <> b_cls")
        met = met.where((F.col("b_n") >= F.col("a_n") * (least * least)) & (F.col("a_n") >= F.col("b_n") * (least * least)))
        # What they share up to here is counted in `met` itself; at its first common token a pair shares one.
        pairs = met.groupBy("a_cls", "b_cls", "a_n", "b_n").agg(F.count("*").alias("met"), F.max(left - 1).alias("left")).where(F.col("left") + F.col("met") >= needed)
        told = Observation(f"round {t}")
        pairs = pairs.select("a_cls", "b_cls").observe(told, F.count(F.lit(1)).alias("n"))
        both = pairs.join(sets.select(F.col("cls").alias("a_cls"), F.col("tokens").alias("a")), "a_cls").join(sets.select(F.col("cls").alias("b_cls"), F.col("tokens").alias("b")), "b_cls")
        score = F.round(F.size(F.array_intersect("a", "b")) / F.sqrt(F.size("a").cast("double") * F.size("b")), digits)
        scored = both.select("a_cls", "b_cls", score.alias("score")).where((F.col("score") > 0) & (F.col("score") >= least))
        best = written(top_k(scored, ["a_cls"], [F.desc("score"), F.col("b_cls")], k), "best")
        if seen is not None:
            seen[f"round {t}"] = told.get["n"]
        done = best.where((F.col("rank") == k) & (F.col("score") >= t)).select(F.col("a_cls").alias("cls")) if t > 0 else rest
        found.append(best.join(done, best["a_cls"] == done["cls"], "left_semi").drop("rank"))
        rest = written(rest.join(done, "cls", "left_anti"), "rest") if t > 0 else rest
        if t > 0 and rest.isEmpty():
            break
    same = sets.where("copies > 1").select(F.col("cls").alias("a_cls"), F.col("cls").alias("b_cls"), F.lit(1.0).alias("score"))
    classes = reduce(DataFrame.unionByName, found).unionByName(same)
    first = members.withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("place") <= k + 1).select(F.col("cls").alias("b_cls"), F.col("id").alias("b_id"))
    offered = classes.join(first, "b_cls").select("a_cls", "b_id", "score")
    offered = top_k(offered, ["a_cls"], [F.desc("score"), F.col("b_id")], k + 1).drop("rank")  # one more than k, as an item may be its own
    out = members.select(F.col("cls").alias("a_cls"), F.col("id").alias("a_id")).join(offered, "a_cls").where("a_id <> b_id").select("a_id", "b_id", "score")
    return top_k(out, ["a_id"], [F.desc("score"), F.col("b_id")], k)
