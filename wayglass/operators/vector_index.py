"""An exact index of vectors: cells around centres, each with its widest angle, searched with the triangle inequality.

Vectors are filed under the nearest of at most MAX_CELLS centres, drawn from the items by a digest. Each member knows its angle to the centre, and so a cell its widest. A query is
first multiplied with the cells nearest to it until they hold k items; the k-th best score is then a bound. Of all other cells only those are multiplied that can hold a vector at least as alike
(angle to the centre less the cell's). What may be among the k best is scored exactly. Scores, ties and ranks are those of scoring everything.

Items of one key (`by`) and stretch of time are filed together, so a search within a key and up to a time reads nothing else. A cell of n items is dealt over ceil(n / PART) parts; small cells are packed into
blocks of about as many, and queries meet them in blocks too, so each meeting is one product of matrices in bounded memory. Index tables are written once and
serve any number of searches. How much is saved depends on the vectors: evenly spread ones of many dimensions can't be told apart by any bound, and all their pairs are multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayglass.functions import arrays as A
from wayglass.operators import blocks
from wayglass.operators.similarity import top_k, unit
from wayglass.sources.scratch import written

#: Centres at most (they are sent to every task), items of a block that one task reads, values of its vectors, and cells and keys up to which the cells' table is broadcast.
MAX_CELLS, PART, VALUES, BROADCAST_CELLS = 2048, 4096, 1_000_000, 20_000
#: Cells of vectors of length zero, which are at no angle to anything, and of those that can't be multiplied.
ZERO, ODD = -1, -2
#: Slack in angles for rounding errors of cosines near 1.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """items: by, stretch, cell, pack, part, id, u (of length 1), angle (to the centre), time. cells: by, stretch, cell, c (the centre), n, pack, parts, widest, first (the earliest time).
    blocks: by, stretch, pack, part, first, and the items' ids, us, cells, angles, times, by cell and id."""

    items: DataFrame
    cells: DataFrame
    blocks: DataFrame
    centres: np.ndarray
    by: tuple[str, ...]
    digits: int


def _vectors(rows: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 or 0, and which of them are neither (or no finite numbers, or of another width): zeros here, left to the exact scores."""
    out, none, odd = blocks._matrix(rows, width)
    norm = np.sqrt((out * out).sum(axis=1))
    odd |= none | ((np.abs(norm - 1) > 1e-9) & out.any(axis=1))
    return np.where(odd[:, None], 0.0, out), odd


def _filed(centres: np.ndarray):
    kind = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    @F.pandas_udf(kind)
    def nearest(u: pd.Series) -> pd.DataFrame:
        vectors, odd = _vectors(list(u), centres.shape[1])
        alike = np.clip(vectors @ centres.T, -1, 1)
        best = alike.argmax(axis=1)
        none = ~vectors.any(axis=1)
        return pd.DataFrame({"cell": np.where(odd, ODD, np.where(none, ZERO, best)).astype(np.int32), "angle": np.where(none, 0.0, np.arccos(alike[np.arange(len(u)), best]))})

    return nearest


def build_index(items: DataFrame, by: tuple[str, ...] = (), time: str | None = None, width: int = 1, cells: int | None = None, digits: int = 4) -> VectorIndex:
    """Index items (id, v, by, time). Rows without a vector are left out. Without `cells`, their number is the root of the number of items."""
    own = written(
        items.where("v is not null").select(*by, (F.floor(F.col(time) / width) if time else F.lit(0)).cast("long").alias("stretch"), "id", unit(F.col("v")).alias("u"), (F.col(time) if time else F.lit(0)).cast("long").alias("time")),
        "unit-vectors",
    )
    wanted = min(MAX_CELLS, cells or max(1, math.isqrt(own.count())))
    drawn = own.where(F.exists("u", lambda x: x != 0) & (F.abs(A.dot(F.col("u"), F.col("u")) - 1) < 1e-9)).select(F.xxhash64("id", *by).alias("digest"), "u").orderBy("digest", "u").limit(wanted).collect()  # `wanted` vectors
    drawn = [r["u"] for r in drawn if len(r["u"]) == len(drawn[0]["u"])]
    centres = np.array(drawn, float) if drawn else np.zeros((1, 1))
    own = written(own.withColumn("at", _filed(centres)("u")).select("*", "at.cell", "at.angle").drop("at"), "filed")
    keys, per = [*by, "stretch", "cell"], max(1, min(PART, VALUES // centres.shape[1]))
    sizes = own.groupBy(*keys).agg(F.max("angle").alias("widest"), F.count("*").alias("n"), F.min("time").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "stretch").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over MAX_CELLS + 2 rows at most
    sizes = sizes.withColumns({"parts": F.ceil(F.col("n") / per).cast("int"), "pack": F.floor(before / per)})
    named = own.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, c array<double>")
    known = written(sizes.join(F.broadcast(named), "cell", "left"), "cells")
    own = written(own.join(known.select(*keys, "pack", "parts"), keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts"), "index")
    rows = F.sort_array(F.collect_list(F.struct("cell", "id", "u", "angle", "time")))  # 2 * per rows, about: whole cells that begin within a pack, or a part of one
    packed = own.where("id is not null").groupBy(*by, "stretch", "pack", "part").agg(F.min("time").alias("first"), rows.alias("rows"))
    packed = packed.select(*by, "stretch", "pack", "part", "first", *[F.col(f"rows.{c}").alias(f"{c}s") for c in ("id", "u", "cell", "angle", "time")])
    return VectorIndex(own, known, written(packed, "blocks"), centres, by, digits)


def _alike(a: Column, b: Column, digits: int) -> Column:
    """The rounded score of vectors of length 1 or 0: as arrays.cosine."""
    zero = lambda v: ~F.exists(v, lambda x: x != 0)
    return F.round(F.when(zero(a) & zero(b), 1.0).otherwise(F.least(F.greatest(A.dot(a, b), F.lit(0.0)), F.lit(1.0))), digits)


def _meeting(index: VectorIndex, k: int, timed: bool):
    """Rows of one block of queries and one of items to what of these items may be among the k best of each query: by, query_id, item_id, bounds of its score in units of the last digit; and a row with the number of pairs multiplied, n."""
    centres, by, unit = index.centres, list(index.by), 10.0**index.digits

    def open_cells(q: np.ndarray, q_odd: np.ndarray, bound: np.ndarray, cells: np.ndarray, widest: np.ndarray) -> np.ndarray:
        """Which cells can hold a score of the bound."""
        apart = np.arccos(np.clip(q @ centres[np.maximum(cells, 0)].T, -1, 1))
        none = ~q.any(axis=1)
        most = np.where(none[:, None] | (cells == ZERO), 0.0, np.maximum(np.cos(np.maximum(apart - widest - SLACK, 0)), 0))
        most[np.ix_(none, cells == ZERO)] = 1.0
        return q_odd[:, None] | (cells == ODD) | (most * unit + blocks.SLACK + 0.5 >= bound[:, None])

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.to_dict("records"):
                ids, cells, angles, times, q_ids, untils, bounds, q_cells = (np.asarray(row[c]) for c in ("ids", "cells", "angles", "times", "q_ids", "untils", "bounds", "q_cells"))
                (v, odd), (q, q_odd) = _vectors(list(row["us"]), centres.shape[1]), _vectors(list(row["qs"]), centres.shape[1])
                start = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
                end, widest, place = np.r_[start[1:], len(ids)], np.maximum.reduceat(angles, start), np.argsort(np.argsort(ids, kind="stable"), kind="stable")
                zero, n, step = ~v.any(axis=1) & ~odd, 0, max(1, blocks.CELLS // len(ids))
                for at in range(0, len(q), step):
                    x, bound, none = q[at : at + step], bounds[at : at + step], q_odd[at : at + step]
                    met = cells[start] == q_cells[at : at + step, None] if len(q_cells) else open_cells(x, none, bound, cells[start], widest)
                    n += int((met * (end - start)).sum())
                    score = np.clip(x @ v.T, 0, 1) if met.all() else np.full((len(x), len(ids)), -np.inf)
                    for j in range(0 if met.all() else len(start)):
                        r = np.flatnonzero(met[:, j])
                        score[r, start[j] : end[j]] = np.clip(x[r] @ v[start[j] : end[j]].T, 0, 1)
                    met_zeros = np.ix_(~x.any(axis=1) & ~none, zero)
                    score[met_zeros] = np.where(score[met_zeros] >= 0, 1.0, -np.inf)
                    may = score >= np.maximum((bound - blocks.SLACK - 0.5) / unit, -1)[:, None]
                    if none.any() or odd.any():
                        may |= (none[:, None] | odd) & (score >= 0)
                    r, c = np.nonzero(may)
                    left = (q_ids[at + r] != ids[c]) & (times[c] <= untils[at + r] if timed else True)
                    r, c = r[left], c[left]
                    unknown, got = none[r] | odd[c], score[r, c] * unit
                    low, high = np.where(unknown, -np.inf, np.floor(got - blocks.SLACK + 0.5)), np.where(unknown, np.inf, np.floor(got + blocks.SLACK + 0.5))
                    order = np.lexsort((place[c], -low, r))
                    r, c, low, high = r[order], c[order], low[order], high[order]
                    first = np.searchsorted(r, r)  # of each query
                    rank = np.arange(len(r)) - first
                    kth = np.where(first + k - 1 < np.searchsorted(r, r, "right"), low[np.minimum(first + k - 1, len(r) - 1)], -np.inf)
                    keep = (rank < k) | (high > kth) | ((high == kth) & (low < high))
                    r, c = r[keep], c[keep]
                    yield pd.DataFrame({**{b: [row[b]] * len(r) for b in by}, "query_id": q_ids[at + r], "item_id": ids[c], "low": low[keep], "high": high[keep], "n": 0})
                yield pd.DataFrame({**{b: [row[b]] for b in by}, "query_id": [None], "item_id": [None], "low": [None], "high": [None], "n": [n]})

    return meet


def search(index: VectorIndex, queries: DataFrame, k: int, time: str | None = None, lag: int = 0, seen: dict[str, int] | None = None) -> DataFrame:
    """by, query_id, item_id, score, rank: the k items most alike to each query (id, v, by, time), itself left out; with a time, items at least `lag` before it. seen: gets the numbers of pairs multiplied in both steps and of those scored exactly."""
    by, one = list(index.by), [*index.by, "query_id"]
    q = queries.where("v is not null and id is not null").select(*by, F.col("id").alias("query_id"), unit(F.col("v")).alias("q"), (F.col(time) - lag if time else F.lit(0)).cast("long").alias("until"))
    q = written(q.where("until is not null"), "queries")
    cells = index.cells if index.cells.limit(BROADCAST_CELLS + 1).count() > BROADCAST_CELLS else F.broadcast(index.cells)
    met = q.join(cells, by) if by else q.crossJoin(cells)
    if time:
        met = met.where("first <= until")
    none = ~F.exists("q", lambda x: x != 0)
    apart = F.when(F.col("cell") < 0, 0.0).otherwise(F.acos(F.least(F.greatest(A.dot(F.col("q"), F.col("c")), F.lit(-1.0)), F.lit(1.0))))
    most = F.when(none & (F.col("cell") == ZERO), 1.0).when(none | (F.col("cell") < 0), 0.0).otherwise(F.greatest(F.cos(F.greatest(F.col("apart") - F.col("widest") - SLACK, F.lit(0.0))), F.lit(0.0)))
    met = met.withColumn("apart", apart).withColumn("most", most).select(*one, "stretch", "cell", "pack", "parts", "n", "apart", "most")
    order = Window.partitionBy(*one).orderBy(F.desc("most"), "apart", "stretch", "cell").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < k + 1)
    block = [*by, "stretch", "pack", "part"]
    kinds = {**dict(index.items.dtypes), "query_id": dict(q.dtypes)["query_id"], "item_id": dict(index.items.dtypes)["id"], "low": "double", "high": "double", "n": "long"}
    out = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "query_id", "item_id", "low", "high", "n"])

    def multiplied(pairs: DataFrame, name: str) -> DataFrame:
        told = Observation(name)
        both = [*by, "q_ids", "qs", "untils", "bounds", "q_cells", "ids", "us", "cells", "angles", "times"]
        found = written(pairs.select(*both).mapInPandas(_meeting(index, k, time is not None), out).observe(told, F.coalesce(F.sum("n"), F.lit(0)).alias("n")), name)
        if seen is not None:
            seen[name] = told.get["n"]
        return found.where("low is not null").drop("n")

    def blocked(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Queries in blocks of about blocks.QUERIES a key."""
        many = rows.groupBy(*keys).agg(F.ceil(F.count("*") / blocks.QUERIES).alias("__n"))
        rows = (rows.join(many, keys) if keys else rows.crossJoin(many)).withColumn("__block", F.pmod(F.xxhash64("query_id"), F.col("__n")))
        own = rows.groupBy(*keys, "__block").agg(F.collect_list(F.struct("query_id", "q", "until", "bound", "cell")).alias("rows"))
        own = own.select(*keys, *[F.col(f"rows.{c}").alias(n) for c, n in (("query_id", "q_ids"), ("q", "qs"), ("until", "untils"), ("bound", "bounds"), ("cell", "q_cells"))])
        return own.withColumn("last", F.array_max("untils"))

    # one part of a large cell will do for a bound
    reads = met.select(*one, "stretch", "pack", "cell", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part")).join(q, one).withColumn("bound", F.lit(float("-inf")))
    near = multiplied(blocked(reads, block).join(index.blocks, block), "near")
    kth = near.withColumn("__r", F.row_number().over(Window.partitionBy(*one).orderBy(F.desc("low")))).where(F.col("__r") <= k).groupBy(*one).agg(F.when(F.count("*") == k, F.min("low")).alias("bound"))
    asked = q.join(kth, one, "left").withColumns({"bound": F.coalesce("bound", F.lit(float("-inf"))), "cell": F.lit(0)})
    asked = written(blocked(asked, by).withColumn("q_cells", F.array().cast("array<int>")), "asked")
    if by:
        deal = F.sequence(F.lit(0).cast("long"), F.lit(blocks.DEAL - 1).cast("long"))
        parts = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = asked.withColumn("__deal", F.explode(deal)).repartition(parts, *by, "__deal").join(index.blocks.withColumn("__deal", F.pmod(F.xxhash64("stretch", "pack", "part"), F.lit(blocks.DEAL))).hint("shuffle_hash"), [*by, "__deal"])
    else:
        pairs = index.blocks.repartition(max(1, index.blocks.count())).crossJoin(asked)
    found = blocks.best(multiplied(pairs.where("first <= last") if time else pairs, "far"), one, k)
    if seen is not None:
        seen["exact"] = found.count()
    pairs = found.join(q, one).join(index.items.withColumnRenamed("id", "item_id"), [*by, "item_id"])
    pairs = pairs.where("time <= until") if time else pairs
    return top_k(pairs.select(*one, "item_id", _alike(F.col("q"), F.col("u"), index.digits).alias("score")), one, [F.desc("score"), F.col("item_id")], k)
