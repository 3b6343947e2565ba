"""A corpus run in stages: toxic documents go, repeated lines go, one of each group of near copies stays, sources are mixed to target weights, and
the rest is tokenised. Every stage works on all rows that the one before has kept; all but the last return the columns of documents.

Defined cases are those of the operators: null text counts as empty, empty tables give empty results, and further columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayglass.llm import bpe, line_dedup, mixing, queries, simhash, toxicity
from wayglass.llm.shared import drop_written, n_written, ship, table, written

#: No oracle: SQL expresses neither the pattern grammar nor SimHash; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None
#: Tokens to take, as a share of what is left, and epochs of a source at most.
MIX = {"share": 0.8, "max_epochs": 1, "seed": 29}
#: Near copies: shingles of five words; fingerprints that differ in three bits or fewer, or sets of shingles with a Jaccard similarity of 0.8 or more.
NEAR = {"limit": 3, "shingle": 5, "jaccard": 0.8}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.keep_clean(docs, queries.toxic_grammar(spark, docs, sf_dir), queries.TOXIC_FROM)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    cleaned = line_dedup.dedup_lines(docs).withColumn("text", F.col("__kept"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.near_dedup(docs, **NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix(queries.with_domain(docs), queries.LEVELS, queries.WEIGHTS, **MIX)
    return mixing.mixed_documents(docs, taken, MIX["seed"])


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode_documents(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), n_written()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(spark, before, keep=docs)  # what the stage has needed, and what it has read
    return STAGES[-1][1](spark, docs, sf_dir)
