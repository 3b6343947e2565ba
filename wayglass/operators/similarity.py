"""Text, vector, history and network similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayglass.functions import arrays as A
from wayglass.functions.keys import circular, squash
from wayglass.operators import blocks
from wayglass.operators.timeseries import changepoint
from wayglass.sources.scratch import written

#: Dimensions of the hashed fields and weights of the scores.
FIELD_DIMS = {"type": 64, "description": 256, "area": 64, "location": 256, "freeway": 32, "direction": 32}
HISTORY_WEIGHTS = {"wavelet": 0.45, "level": 0.20, "recent": 0.20, "changepoint": 0.15}
RETRIEVAL_WEIGHTS = {"time": 0.2, "network": 1.0, "history": 1.0, "incident": 0.5}


def _gram(text: Column, n: int):
    return lambda i: F.substring(text, i, F.lit(n))


def token_set(text: Column, grams: bool = True) -> Column:
    """Distinct tokens: the whole value, its words, and with grams the 3- and 4-grams of the joined words."""
    value = squash(text)
    words = F.regexp_extract_all(value, F.lit("(?U)([^\\W_]+)"), F.lit(1))
    parts = [F.array(value), words]
    if grams:
        joined = F.array_join(words, "")
        for n in (3, 4):
            last = F.length(joined) - (n - 1)
            starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, _gram(joined, n)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda t: t != "")))


def token_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, score): cosine of token sets (id, tokens), through an equal-token join; pairs that share no token are left out."""
    ta = a.select(F.col("id").alias("a_id"), F.size("tokens").alias("na"), F.explode("tokens").alias("t"))
    tb = b.select(F.col("id").alias("b_id"), F.size("tokens").alias("nb"), F.explode("tokens").alias("t"))
    return ta.join(tb, "t").groupBy("a_id", "b_id", "na", "nb").agg(F.count("*").alias("both")).select(
        "a_id", "b_id", (F.col("both") / F.sqrt(F.col("na").cast("double") * F.col("nb"))).alias("score"))


def hashed_block(items: DataFrame, dim: int) -> DataFrame:
    """(id, bucket, x): L2-normalised counts of the tokens of (id, tokens) in dim buckets (the first 32 bits of MD5), zeros left out."""
    bucket = F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 8), 16, 10).cast("long") % dim
    counts = items.select("id", F.explode("tokens").alias("t")).groupBy("id", bucket.cast("int").alias("bucket")).agg(F.count("*").cast("double").alias("n"))
    return counts.withColumn("x", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("id")))).drop("n")


def _token_buckets(text: Column, dim: int) -> Column:
    return F.transform(token_set(F.coalesce(text, F.lit(""))), lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int"))


def field_vectors(df: DataFrame, name: str = "fields", dims: dict[str, int] = FIELD_DIMS, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with the hashed vectors of its text fields (columns by the names of dims), one after the other: of each field the L2-normalised counts of its tokens in so many buckets, zeros for a text without tokens.

    Rows with the same texts are hashed once. each: changes the table of different texts, with their vectors, before it meets the rows.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def counted(*fields: pd.Series) -> pd.Series:  # arrays are filled in place here; SQL would look through all tokens once a bucket
        rows = []
        for buckets in zip(*fields, strict=True):
            parts = [np.bincount(np.asarray(b, np.int64), minlength=dim).astype(float) for b, dim in zip(buckets, dims.values(), strict=True)]
            rows.append(np.concatenate([x / np.sqrt((x * x).sum()) if x.any() else x for x in parts]))
        return pd.Series(rows)

    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"__{f}") for f in dims]  # a missing text has no tokens either
    parts, keys = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), [f"__{f}" for f in dims]
    made = df.select(*texts).distinct().repartition(parts, *keys).withColumn(name, counted(*[_token_buckets(F.col(k), dim) for k, dim in zip(keys, dims.values(), strict=True)]))
    return df.select("*", *texts).join(written(each(made) if each else made, "texts"), keys).drop(*keys)


def dense(blocks: DataFrame, dim: int) -> DataFrame:
    """(id, v): sparse vectors (id, bucket, x) as arrays of dim values."""
    own = blocks.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "x"))).alias("m"))  # dim entries at most
    return own.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("v"))


def sparse_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, score) of normalised sparse vectors (id, bucket, x), through a join on the bucket."""
    x = a.select(F.col("id").alias("a_id"), "bucket", F.col("x").alias("ax"))
    y = b.select(F.col("id").alias("b_id"), "bucket", F.col("x").alias("bx"))
    return x.join(y, "bucket").groupBy("a_id", "b_id").agg(F.sum(F.col("ax") * F.col("bx")).alias("score"))


def unit(v: Column) -> Column:
    norm = F.sqrt(A.dot(v, v))
    return F.when(norm > 0, A.each_with(v, norm, lambda x, n: x / n)).otherwise(v)


def time_block(period: Column, weekday: Column, weekend: Column, holiday: Column, hour: Column) -> Column:
    """20 calendar components, normalised; four are unused."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    angle = hour * (2 * 3.141592653589793 / 24)
    cells = [flag(period == p) for p in ("night", "morning_peak", "midday", "evening_peak")] + [flag(weekday == d) for d in range(7)]
    cells += [flag(weekend), flag(holiday), flag(weekend | holiday), F.sin(angle), F.cos(angle)] + [F.lit(0.0)] * 4
    return unit(F.array(*cells))


def top_k(scored: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def cosine_recall(queries: DataFrame, items: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """query_id, item_id, score, rank: items (id, v) most alike to each of a stated set of queries (id, v). Products of blocks leave a few candidates a query, which are scored exactly."""
    found = blocks.candidates(queries, items, k, digits)
    pairs = blocks.scored(queries, items, found).withColumn("score", F.round(A.cosine(F.col("qv"), F.col("iv")), digits)).drop("qv", "iv")
    return top_k(pairs, ["query_id"], [F.desc("score"), F.col("item_id")], k)


# histories ---------------------------------------------------------------------------------------------------------
def haar(a: Column) -> Column:
    """A Haar pyramid of 12 normalised values (6 + 3 details, 3 means), the SQL stand-in for a scattering transform."""
    x = A.robust_normalise(a)
    high, low = _halves(x)
    return F.concat(high, *_halves(low))


def _halves(v: Column) -> tuple[Column, Column]:
    """Half differences and half sums of neighbours."""
    first, second = F.filter(v, lambda x, i: i % 2 == 0), F.filter(v, lambda x, i: i % 2 == 1)
    return F.zip_with(first, second, lambda x, y: (x - y) / 2), F.zip_with(first, second, lambda x, y: (x + y) / 2)


def dynamics(a: Column) -> Column:
    """Level, steps and pyramid of 12 values, normalised: what histories are recalled by."""
    return unit(F.concat(A.robust_normalise(a), A.robust_normalise(A.steps(a, 12), 11), haar(a)))


def incident_vector(blocks: list[Column]) -> Column:
    """The blocks of an incident's fields (each normalised) and its time block in one vector, normalised again."""
    return unit(F.concat(*blocks))


def one_hot(value: Column, values: list) -> Column:
    return F.array(*[F.when(value == v, 1.0).otherwise(0.0) for v in values])


def level_similarity(a: Column, b: Column, n: int = 12) -> Column:
    ma, mb = A.median(a, n), A.median(b, n)
    return F.exp(-2 * F.abs(ma - mb) / F.greatest(F.abs(ma), F.abs(mb), F.lit(1.0)))


def recent_similarity(a: Column, b: Column, last: int = 3) -> Column:
    x, y = F.slice(a, -last, last), F.slice(b, -last, last)
    return F.exp(-2 * A.rmse(x, y) / F.greatest(A.mean_abs(x), A.mean_abs(y), F.lit(1.0)))


def changepoint_similarity(a: Column, b: Column) -> Column:
    p, q = changepoint(a), changepoint(b)
    weak_p, weak_q = p["magnitude"] < 0.2, q["magnitude"] < 0.2
    like = F.exp(-F.abs(p["index"] - q["index"]) / 2) * F.exp(-F.abs(F.log1p(p["magnitude"]) - F.log1p(q["magnitude"])))
    return F.when(weak_p & weak_q, 1.0).when(weak_p | weak_q | (p["direction"] != q["direction"]), 0.0).otherwise(like)


def history_similarity(parts: dict[str, Column]) -> Column:
    return sum((parts[k] * w for k, w in HISTORY_WEIGHTS.items()), F.lit(0.0))


def network_similarity(km: tuple[Column, Column], seconds: tuple[Column, Column], bearing: tuple[Column, Column]) -> Column:
    """Mean of three likenesses; a missing value makes all 0."""
    near = lambda p, s: F.exp(-F.abs(p[0] - p[1]) / F.greatest(F.abs(p[0]), F.abs(p[1]), F.lit(s)))
    mean = (near(km, 0.5) + near(seconds, 60.0) + circular(*bearing, 360)) / 3
    return F.coalesce(mean, F.lit(0.0))


def incident_time_similarity(free: tuple[Column, Column], period: tuple[Column, Column], hour: tuple[Column, Column]) -> Column:
    same = lambda p: F.when(p[0] == p[1], 1.0).otherwise(0.0)
    return (same(free) + same(period) + circular(*hour, 24)) / 3


def retrieval_score(parts: dict[str, Column]) -> Column:
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return sum((clip(parts[k]) * w for k, w in RETRIEVAL_WEIGHTS.items()), F.lit(0.0)) / sum(RETRIEVAL_WEIGHTS.values())


def equal_share(pairs: list[tuple[Column, Column]]) -> Column:
    """Share of fields that are equal (two nulls are); the native stand-in for text similarity of attributes."""
    return sum((F.when(a.eqNullSafe(b), 1.0).otherwise(0.0) for a, b in pairs), F.lit(0.0)) / len(pairs)


def network_time(network: Column, time: Column, incident: Column) -> Column:
    return network * 0.55 + time * 0.25 + incident * 0.20


# Python where SQL has no equal ---------------------------------------------------------------------------------------
@F.pandas_udf(T.DoubleType())
def gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of squashed texts; both empty 1, one empty 0."""
    tidy = lambda s: " ".join((s or "").upper().split())
    out = []
    for x, y in zip(map(tidy, a), map(tidy, b), strict=True):
        out.append(1.0 if not x and not y else 0.0 if not x or not y else SequenceMatcher(None, x, y).ratio())
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def scattering(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Two orders of band-pass filters (Morlet, three octaves) with moduli and time means, log1p, of 12 normalised values.

    An own small filter bank: it approximates a scattering transform and is not bit-equal to any library's.
    """
    t = np.arange(12)
    freq = np.fft.fftfreq(12)
    bank = [np.exp(-0.5 * ((freq - f0) / (f0 / 2.5)) ** 2) for f0 in (0.35, 0.35 / 1.414, 0.35 / 2, 0.35 / 2.83, 0.35 / 4, 0.35 / 5.66)]
    for s in series:
        x = np.array([np.asarray(v, float) for v in s]).reshape(-1, len(t))
        med = np.median(x, axis=1, keepdims=True)
        z = np.clip((x - med) / np.maximum(1.4826 * np.median(np.abs(x - med), axis=1, keepdims=True), 1), -8, 8)
        first = [np.abs(np.fft.ifft(np.fft.fft(z) * h)) for h in bank]
        second = [np.abs(np.fft.ifft(np.fft.fft(u) * bank[j])) for i, u in enumerate(first) for j in range(i + 2, len(bank), 2)]
        out = np.log1p(np.abs(np.stack([z.mean(1), *(u.mean(1) for u in first), *(u.mean(1) for u in second)], axis=1)))
        yield pd.Series(list(out))
