"""Exact deduplication over an extendible-hash index kept in shared files.

The key of a text is its 64-bit hash. A bucket holds the keys that start with some bits; the index starts as one bucket, and while buckets hold more than `capacity`
distinct keys the directory doubles and just these split on their next bit. The doublings of a round are counted together, each round's splits are a table of the
shared folder, and rounds go on, however deep, until no bucket is overfull. Every bucket is thus a range of keys.

Copies are then filed by bucket, and each bucket has one owner task: it chains the texts that share a key and compares their bytes, so two texts with one hash stay
apart, and writes the chains as the bucket's part of the index. Before they go to their owner, copies are folded (map-side, and in SALTS parts a
bucket), so a text that makes up a third of the corpus costs its owner SALTS rows. Only texts whose key occurs twice travel at all.

Defined cases: null text counts as empty; an empty table gives an empty result; repeated rows and equal
ids stay separate rows of the result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayglass.llm.shared import ascii_lower, fitting, written

#: Distinct keys a bucket holds at most.
CAPACITY = 4096
#: Levels by which the directory doubles in a round after the first, and levels of the first beyond those that an even spread needs.
ROUND, SPARE = 8, 2
#: Parts in which the copies of a bucket are folded before its owner sees them.
SALTS = 8
#: Repeated keys are broadcast up to this number (some 50 MB); beyond it the texts are shuffled to them.
BROADCAST_KEYS = 2_000_000


def _first_bits(key: str, n: int) -> Column:
    return F.shiftrightunsigned(key, 64 - n) if n else F.lit(0).cast("long")


def split_buckets(keys: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """The directory (bucket: its first key, depth, prefix, n_keys) and the keys (a written table: key, ...) with their bucket."""
    total = keys.count()
    depth, step = 0, max(1, math.ceil(math.log2(max(1.0, total / capacity))) + SPARE)
    rest, directories, filed = keys, [], []
    while True:
        step = min(step, 64 - depth)
        own = rest.withColumn("cell", _first_bits("key", depth + step))
        cells = written(own.groupBy("cell").agg(F.count("*").alias("n")), "cells")
        # The bucket of every level that a cell would be in.
        above = F.explode(F.array(*[F.struct(F.lit(depth + k).alias("depth"), F.shiftrightunsigned("cell", step - k).alias("prefix")) for k in range(step + 1)]))
        spread = cells.select("cell", "n", above.alias("at")).select("cell", "n", "at.depth", "at.prefix")
        levels = written(spread.groupBy("depth", "prefix").agg(F.sum("n").alias("n_keys")), "levels")
        parents = levels.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), F.col("n_keys").alias("in_parent"))
        whole = levels.withColumn("parent", F.shiftrightunsigned("prefix", 1)).join(parents, ["depth", "parent"], "left")
        whole = whole.where((F.col("n_keys") <= capacity) & (F.col("in_parent").isNull() | (F.col("in_parent") > capacity)))
        directory = written(whole.select(F.expr("shiftleft(prefix, 64 - depth)").alias("bucket"), "depth", "prefix", "n_keys"), "directory")
        directories.append(directory)
        at = written(spread.drop("n").join(directory, ["depth", "prefix"]).select("cell", "bucket"), "cell-buckets")
        filed.append(own.join(at, "cell").drop("cell"))
        overfull = cells.join(at, "cell", "left_anti").select("cell")
        if overfull.isEmpty():
            break
        rest = written(own.join(overfull, "cell", "left_semi").drop("cell"), "overfull")
        depth, step = depth + step, ROUND
    return reduce(DataFrame.unionByName, directories), reduce(DataFrame.unionByName, filed)


def chains_of(copies: DataFrame) -> DataFrame:
    """(bucket, key, slot, digest, chain_n, chain_top): the different texts of each key, found by the owners of the buckets from copies (bucket, key, norm, doc_id)."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    folded = copies.groupBy("bucket", "key", "norm", salt).agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
    owned = folded.repartition("bucket")  # the owners; grouping below needs no further exchange and compares the texts themselves
    texts = owned.groupBy("bucket", "key", "norm").agg(F.sum("n").alias("chain_n"), F.max("top").alias("chain_top"))
    texts = texts.select("bucket", "key", F.unhex(F.sha2("norm", 256)).alias("digest"), "chain_n", "chain_top")
    return texts.withColumn("slot", F.row_number().over(Window.partitionBy("bucket", "key").orderBy("digest"))).sortWithinPartitions("bucket", "key", "slot")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of docs: id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.

    All rows that carry keep_id are kept, as ids are meant to be unique. A null id is below every other.
    """
    norm = ascii_lower(F.col(text_col))
    source = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("key", F.xxhash64("norm"))
    entries = written(source.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("digest")), "entries")
    keys = written(entries.groupBy("key").agg(F.count("*").alias("n")), "keys")
    _, filed = split_buckets(keys, capacity)
    repeated = fitting(written(filed.where("n > 1").select("key", "bucket"), "repeated"), BROADCAST_KEYS)
    chains = written(chains_of(source.join(repeated, "key")), "chains")
    slots = chains.select("key", "digest", "chain_n", "chain_top")
    return (
        entries.join(slots, ["key", "digest"], "left")
        .select(
            "doc_id",
            F.when(F.col("chain_n").isNull(), F.col("doc_id")).otherwise(F.col("chain_top")).alias("keep_id"),
            F.coalesce("chain_n", F.lit(1)).cast("long").alias("group_size"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    kept = exact_groups(docs, id_col, text_col, capacity).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept_id"]), "left_semi")
