"""Quality rules, in DataFrame operations only: base counts, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into equally many buckets each. Two multinomials are counted: one from all trusted documents, one from the whole
raw corpus, over all its documents. The trusted one is smoothed towards the raw one (a Dirichlet prior of PRIOR observations in the raw proportions), so a
bucket that trusted documents say little about weighs near 0 whatever the sizes of the two samples. A document's verdict is the mean over its n-grams of
log(trusted / raw); it is kept if the base rules pass and the mean is at least the threshold. At 0 the text is as likely among trusted texts as in
the raw corpus. The threshold is one fixed number at every size: a text stays if its n-grams are, in the geometric mean, at least exp(-0.15) = 0.86 times as likely there.
All steps are sums, so the verdict is the same however rows are dealt out (to rounding in the last bits).

The number of buckets grows with the square root of the corpus, as the number of different words does, from 2^15 up to 2^20 a kind; the
largest model, which every task reads, is 16 MB. Counting folds on the bucket before any exchange, so no document or word can make a task large.

Defined cases: null text has no words and fails the base rules, as do empty ones; a corpus without trusted documents gives every document the ratio 0, as does an
n-gram whose bucket is empty in the corpus; texts of any length are read whole; repeated rows are rows of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayglass.llm.shared import BLANK, written

#: Buckets a kind: the power of two next above sqrt(bytes of text) * BUCKETS_EACH, within these bounds.
LEAST_BUCKETS, MOST_BUCKETS, BUCKETS_EACH = 1 << 15, 1 << 20, 2
#: Observations of the raw distribution that are added to the trusted counts.
PRIOR = 1000.0
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.15
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{BLANK}+", -1), lambda w: w != "")


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def with_repeated_words(rows: DataFrame, windows: str, to: str) -> DataFrame:
    """rows with the number of words covered by windows (their hashes, in order) that occur twice or more.

    Each step is a column of its own, so that none is evaluated again within another's lambda; texts without a repeated window skip all.
    """
    h, placed, at = F.col(windows), F.col("__placed"), F.col("__at")
    rows = rows.withColumn("__placed", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.filter(placed, lambda e, k: (F.get(placed, k - 1)["h"] == e["h"]) | (F.get(placed, k + 1)["h"] == e["h"]))
    rows = rows.withColumn("__at", F.sort_array(F.transform(twice, lambda e: e["i"])))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")), lambda a, i: F.struct(
        (a["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + WINDOW).alias("end")))
    return rows.withColumn(to, F.coalesce(covered["n"], F.lit(0)).cast("long")).drop("__placed", "__at", windows)


def _joined(hashes: Column, gap: int) -> Column:
    """Hash of each entry with the one `gap` places on."""
    n = F.greatest(F.size(hashes) - gap, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + gap), n), lambda a, b: F.xxhash64(a, b))


def hashed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __n (words), __h1 and __h2 (hashes of words and of word pairs)."""
    return (
        docs.withColumn("__w", words_of(F.col(text_col)))
        .withColumn("__h1", F.transform("__w", lambda w: F.xxhash64(w))).drop("__w")
        .withColumn("__n", F.size("__h1").cast("long")).withColumn("__h2", _joined(F.col("__h1"), 1))
    )


def _buckets(n: Column) -> Column:
    """Buckets of a document's words (0 to n - 1) and word pairs (n to 2n - 1)."""
    return F.concat(F.transform("__h1", lambda h: F.pmod(h, n).cast("int")), F.transform("__h2", lambda h: (F.pmod(h, n) + n).cast("int")))


def bucket_count(docs: DataFrame, text_col: str = "text") -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    n = LEAST_BUCKETS
    while n < MOST_BUCKETS and n < BUCKETS_EACH * size**0.5:
        n *= 2
    return n


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """One row: the array w of the log ratios of all buckets, words first. trusted: the ids (doc_id) of trusted documents."""
    spark = docs.sparkSession
    n = buckets or bucket_count(docs, text_col)
    ids = trusted.select(F.col("doc_id").alias("__trusted")).where("__trusted is not null").distinct()
    known = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    known = known.join(ids.hint("merge"), F.col("__id") == F.col("__trusted"), "left")  # by a shuffle at every size; moves texts, not hashes
    marked = hashed(known, "__text")
    grams = marked.select(F.col("__trusted").isNotNull().cast("long").alias("t"), F.explode(_buckets(F.lit(n))).alias("bucket"))
    counts = written(grams.groupBy("bucket").agg(F.sum("t").alias("t"), F.count("*").alias("r")), "counts")  # read twice below
    kind = (F.col("bucket") >= n).cast("int")
    sums = counts.groupBy(kind.alias("kind")).agg(F.sum("t").alias("all_t"), F.sum("r").alias("all_r"))
    raw = F.col("r") / F.col("all_r")
    ratio = F.when(F.col("all_t") == 0, 0.0).otherwise(F.log((F.col("t") + raw * PRIOR) / (F.col("all_t") + PRIOR)) - F.log(raw))
    seen = counts.withColumn("kind", kind).join(F.broadcast(sums), "kind").select("bucket", ratio.alias("w"))  # two rows
    full = spark.range(2 * n).select(F.col("id").cast("int").alias("bucket")).join(seen, "bucket", "left")
    weights = full.select("bucket", F.coalesce("w", F.lit(0.0)).alias("w"))
    # 2 * MOST_BUCKETS rows at most.
    return written(weights.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "w"))), lambda x: x["w"]).alias("w")), "model")


def rate(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ratio, kept of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = hashed(base, "text").select(
        "doc_id", F.col("__n").alias("n_words"), F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        count_chars(text, "#*$%&|<>").alias("n_symbols"), lines.alias("lines"), "__h1", "__h2",
    )
    base = base.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    base = base.withColumn("__h4", _joined(F.col("__h2"), 2)).withColumn("__h8", _joined(F.col("__h4"), 4)).drop("__h4")
    base = with_repeated_words(base, "__h8", "n_repeat_words")
    n = model.select((F.size("w") / 2).cast("long").alias("n")).first()["n"]
    scored = base.withColumn("__b", _buckets(F.lit(n))).drop("__h1", "__h2").withColumn("w", model.scalar())
    total = F.aggregate("__b", F.lit(0.0), lambda a, b: a + F.get(F.col("w"), b))
    scored = scored.withColumn("log_ratio", F.when(F.size("__b") > 0, total / F.size("__b")).otherwise(F.lit(0.0))).drop("__b", "w")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("log_ratio") >= threshold)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept")
