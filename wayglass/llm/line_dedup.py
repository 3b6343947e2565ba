"""Reversible line deduplication: sharded cuckoo filters in front of exact reference-count tables.

State of an index (all tables in the shared folder):
  ledger   (doc_id, body, pos, key)               the place of every key in every document: what a deletion has to take back
  refs     (key, word, n_lines, owner, last)      exact counts: lines that hold the key, the smallest and the largest document among them
  filters  (shard, slots)                         a cuckoo filter over the words (64-bit hashes of keys) of the shard

A batch is folded to one row per key first, so a line that half of the documents share is one row per map task. Then the filters are asked: a key that its
shard's filter has not seen is certainly new and goes to the exact table without a look at it; only the others are looked up there, and merged if they are
found. New keys enter the filters, each once. A corpus indexed at once is inserted in batches (by a hash of the document's id), so that from the second on the filters
spare most keys the exact table. Each shard is one task; shards double in number until none has more than SHARD_KEYS keys of the index or of a batch, which bounds a task's memory. A filter in which a
key finds no place is rebuilt, with twice the shards, from the exact table, which holds all keys.

Deletion subtracts the ledger rows of the documents, takes the keys whose count falls to zero out of the filters, and finds a new owner for keys that lost theirs.

A key is the SHA-256 of the line with white space [\\x20\\x09-\\x0D] stripped at both ends and A-Z lower-cased; lines whose
stripped form has fewer than `min_chars` code points have none and always stay. Lines are dropped by their places, so the work on a text is linear in its lines.
Defined cases: null text is one empty line; an empty table gives an empty result; rows that repeat a doc_id are one document, each row
filtered on its own; a null doc_id holds lines as the largest id; other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayglass.llm.shared import LOWER, UPPER, written

SHARD_KEYS = 131_072
SLOTS, KICKS = 4, 500
NULL_ID = (1 << 63) - 1
#: Batches in which dedup_lines inserts a corpus.
BATCHES = 2


class CuckooFilter:
    """16-bit fingerprints, four slots a bucket; 0 is a free slot. Keys are unsigned 64-bit numbers."""

    def __init__(self, n_keys: int = 0, slots: np.ndarray | None = None):
        if slots is None:
            slots = np.zeros((1 << max(2, math.ceil(math.log2(max(1, n_keys) / SLOTS / 0.8))), SLOTS), np.uint16)
        self.slots, self.mask = slots, np.uint64(len(slots) - 1)

    def places(self, keys: np.ndarray):
        print_ = ((keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = keys & self.mask
        return print_, first, self.other(first, print_)

    def other(self, bucket, print_):
        return bucket ^ ((print_.astype(np.uint64) * np.uint64(0x5BD1E995)) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self.places(keys)
        return (self.slots[a] == p[:, None]).any(1) | (self.slots[b] == p[:, None]).any(1)

    def add(self, keys: np.ndarray) -> bool:
        """Insert keys that are not yet in; False if no place is left (the caller then builds a larger filter)."""
        p, a, b = self.places(keys)
        for second in (False, True):
            for slot in range(SLOTS):
                if not len(p):
                    return True
                bucket = b if second else a
                free = np.flatnonzero(self.slots[bucket, slot] == 0)
                _, one = np.unique(bucket[free], return_index=True)  # one key a bucket each time
                take = free[one]
                self.slots[bucket[take], slot] = p[take]
                left = np.ones(len(p), bool)
                left[take] = False
                p, a, b = p[left], a[left], b[left]
        return all(self._kick(int(x), int(y)) for x, y in zip(p, a, strict=True))

    def _kick(self, print_: int, bucket: int) -> bool:
        for turn in range(KICKS):
            row = self.slots[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = print_
                return True
            out = int(row[turn % SLOTS])
            row[turn % SLOTS] = print_
            print_ = out
            bucket = int(bucket) ^ (print_ * 0x5BD1E995 & int(self.mask))
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that are known (from the exact table) to be in."""
        for p, a, b in zip(*self.places(keys), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.slots[bucket] == p)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break


def _filter_of(old: pd.DataFrame) -> CuckooFilter | None:
    return CuckooFilter(slots=np.frombuffer(old["slots"].iloc[0], np.uint16).reshape(-1, SLOTS).copy()) if len(old) else None


def _seen(_, batch: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """The words that the filter of the shard may hold."""
    words, known = batch["word"].to_numpy(np.int64), _filter_of(old)
    return pd.DataFrame({"word": words[known.contains(words.view(np.uint64))] if known is not None else words[:0]})


def _add(shard, fresh: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """The filter with new words; null slots where one finds no place."""
    filter_ = _filter_of(old) or CuckooFilter(SHARD_KEYS)
    fits = filter_.add(np.unique(fresh["word"].to_numpy(np.int64)).view(np.uint64))
    return pd.DataFrame({"shard": [shard[0]], "slots": [filter_.slots.tobytes() if fits else None]})


def _remove(shard, gone: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    filter_ = _filter_of(old)
    filter_.remove(np.unique(gone["word"].to_numpy(np.int64)).view(np.uint64))
    return pd.DataFrame({"shard": [shard[0]], "slots": [filter_.slots.tobytes()]})


def line_key(line: Column, min_chars: int) -> Column:
    stripped = F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)
    return F.when(F.length(stripped) >= min_chars, F.unhex(F.sha2(stripped, 256)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _id(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(NULL_ID)).cast("long")


FILTERS, REFS = "shard int, slots binary", ["key", "word", "n_lines", "owner", "last"]


@dataclass
class LineIndex:
    """An index after some batches. `insert` and `delete` return a new index; `drop_lines` cleans documents by it."""

    ledger: DataFrame | None = None
    refs: DataFrame | None = None
    filters: DataFrame | None = None
    shards: int = 0
    min_chars: int = 10

    def places(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, body, pos, key) of each line with a key; body: a hash of the text, as rows with one id may differ."""
        whole = docs.select(_id(id_col).alias("doc_id"), F.xxhash64(text_col).alias("body"), _lines(F.col(text_col)).alias("lines"))
        lines = whole.select("doc_id", "body", F.posexplode("lines").alias("pos", "line"))  # a step of its own: the body is hashed once, not for each line
        return lines.select("doc_id", "body", "pos", line_key(F.col("line"), self.min_chars).alias("key")).where("key is not null")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Add documents whose ids the index does not hold."""
        return self.insert_places(written(self.places(docs, id_col, text_col), "ledger"))

    def insert_places(self, fresh: DataFrame) -> LineIndex:
        """Add the lines of a written ledger."""
        folded = fresh.groupBy("key").agg(F.count("*").alias("n_lines"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        delta = written(folded.withColumn("word", F.xxhash64("key")).select(REFS), "delta")
        ledger = fresh if self.ledger is None else self.ledger.unionByName(fresh)
        n = delta.count()
        if self.refs is not None and n > self.shards * SHARD_KEYS:
            return self._refilled(n)._merged(ledger, delta, n)  # a shard's part of the batch is one task's as well
        return self._merged(ledger, delta, n)

    def _merged(self, ledger: DataFrame, delta: DataFrame, n: int) -> LineIndex:
        """The index with the n keys of a batch."""
        if self.refs is None:
            refs, unseen, total = delta, delta, n
        else:
            words = delta.select("word", self._shard())
            seen = written(words.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_seen, "word long"), "seen")
            asked = delta.join(seen.distinct(), "word", "left_semi")
            found = written(asked.join(self.refs.select("key"), "key", "left_semi"), "found")  # keys that the exact table has
            merged = found.unionByName(self.refs.join(found.select("key"), "key", "left_semi").select(found.columns)).groupBy("key", "word").agg(
                F.sum("n_lines").alias("n_lines"), F.min("owner").alias("owner"), F.max("last").alias("last"))
            unseen = written(delta.join(found.select("key"), "key", "left_anti").select(REFS), "unseen")
            old = self.refs.join(found.select("key"), "key", "left_anti").select(REFS)
            refs = written(old.unionByName(merged.select(REFS)).unionByName(unseen), "refs")
            total = refs.count()
        out = LineIndex(ledger, refs, self.filters, max(1, self.shards), self.min_chars)
        if total > out.shards * SHARD_KEYS // 2 or self.filters is None:
            return out._refilled(total)
        added = written(unseen.select("word", out._shard()).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_add, FILTERS), "filters")
        out.filters = added
        return out if added.where("slots is null").isEmpty() else out._refilled(total)

    def _shard(self) -> Column:
        return F.pmod("word", F.lit(self.shards)).cast("int").alias("shard")

    def _refilled(self, total: int) -> LineIndex:
        """All filters anew from the exact table, in as many shards as its keys need."""
        shards = self.shards
        while total > shards * SHARD_KEYS // 2:
            shards *= 2
        while True:
            out = LineIndex(self.ledger, self.refs, None, shards, self.min_chars)
            none = self.refs.sparkSession.createDataFrame([], FILTERS)
            out.filters = written(self.refs.select("word", out._shard()).groupBy("shard").cogroup(none.groupBy("shard")).applyInPandas(_add, FILTERS), "filters")
            if out.filters.where("slots is null").isEmpty():
                return out
            shards *= 2

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Take documents out again, as if they had never been inserted."""
        ids = ids.select(_id(id_col).alias("doc_id")).distinct()
        gone = self.ledger.join(ids, "doc_id", "left_semi")
        ledger = written(self.ledger.join(ids, "doc_id", "left_anti"), "ledger")
        delta = written(gone.groupBy("key").agg(F.count("*").alias("less")), "delta")
        hit = written(self.refs.join(delta, "key").withColumn("n_lines", F.col("n_lines") - F.col("less")).select("key", "word", "n_lines"), "hit")
        owners = ledger.join(hit.select("key"), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        alive = hit.where("n_lines > 0").join(owners, "key").select(REFS)
        refs = written(self.refs.join(delta, "key", "left_anti").select(REFS).unionByName(alive), "refs")
        zero = hit.where("n_lines = 0").join(refs.select("word"), "word", "left_anti").select("word", self._shard())  # two keys may share a word
        filters = written(zero.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_remove, FILTERS), "filters")
        return LineIndex(ledger, refs, filters, self.shards, self.min_chars)

    def drop_lines(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """docs with columns __n_lines, __n_dropped and __kept (the text without lines that an earlier document owns)."""
        shared = self.refs.where("owner <> last").select("key", "owner")  # in two documents or more
        lost = (
            self.ledger.join(shared, "key").where("doc_id <> owner").groupBy(F.col("doc_id").alias("__id"), F.col("body").alias("__body"))
            .agg(F.collect_set("pos").alias("__lost"))
        )
        keyed = docs.withColumn("__own", _id(id_col)).withColumn("__own_body", F.xxhash64(text_col)).withColumn("__lines", _lines(F.col(text_col)))
        joined = keyed.join(lost, (F.col("__own") == F.col("__id")) & (F.col("__own_body") == F.col("__body")), "left")
        joined = joined.withColumn("__n_lines", F.size("__lines").cast("long")).withColumn("__n_dropped", F.coalesce(F.size("__lost"), F.lit(0)).cast("long"))
        stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__lost"))  # by hashing, so linear in the lines
        kept = F.when(F.col("__lost").isNull(), F.col("__lines")).otherwise(F.transform(stay, lambda i: F.get(F.col("__lines"), i)))
        return joined.withColumn("__kept", F.array_join(kept, "\n")).drop("__id", "__body", "__own", "__own_body", "__lines", "__lost")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = BATCHES) -> DataFrame:
    """Index all documents, batch by batch, and clean them by the index."""
    index = LineIndex(min_chars=min_chars)
    ledger = written(index.places(docs, id_col, text_col), "ledger")
    for b in range(batches):
        index = index.insert_places(ledger.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
    index.ledger = ledger
    return index.drop_lines(docs, id_col, text_col)
