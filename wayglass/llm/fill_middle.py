"""Fill-in-middle over an index of distinct texts.

The index has one entry for each distinct text that several rows hold: rows are grouped by a 64-bit hash and by the text itself, so two texts of one hash get an
entry each, told apart by their SHA-256. An entry has the text and the boundaries of its tokens, `[A-Za-z]+|[^A-Za-z]` over code points, as an Elias-Fano
list: the low bits of all boundaries packed, the high bits in unary. It is built once an entry, however many rows hold the text. A text that one row
alone holds is its own entry; it stays where it is and its list is never stored.

Rows are then joined to their entries. A group of n copies is dealt over ceil(n / PER_SALT) copies of the entry, so no task gets more than some PER_SALT of its rows.
Each row reads the two boundaries of its seeded cut from the list (a select on the high bits), and the output is put together from the text.

Cuts and forms come from the four first 8-digit groups of the hex SHA-256 of `seed:doc_id`, h1 to h4. The prefix ends after the smaller of h1 % (n + 1) and
h2 % (n + 1) tokens, the middle after the larger. Texts that hold a mark and, by h3, a tenth of all rows stay plain; of the others a fifth, by h4, is spm, else psm.

Defined cases: null text counts as empty and is plain; a null id is hashed as no characters; whole texts are read, whatever their length; repeated rows and ids give a row each;
an empty table gives an empty result; other columns are ignored by `fill_in_middle`, whatever their names.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayglass.llm.shared import fitting, written

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentages of rows that may be cut, and of those that are then spm.
CUT, SPM = 90, 20
#: Rows of one text that join one copy of its entry.
PER_SALT = 256
#: Repeated hashes are broadcast up to this number (some 50 MB); beyond it rows are shuffled to them.
BROADCAST_KEYS = 2_000_000
_HEAD = struct.Struct("<QB")


def boundaries(text: str) -> np.ndarray:
    """Where each token starts, in code points, and the length of the text."""
    if not text:
        return np.zeros(1, np.int64)
    points = np.frombuffer(text.encode("latin-1"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = ((points | points.dtype.type(32)) - points.dtype.type(97)) < 26
    starts = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate(([0], starts, [len(points)]))


def elias_fano(values: np.ndarray) -> bytes:
    """A rising list of numbers from 0 on: its count and the width of the low parts, the low parts, and the high parts in unary."""
    n, width = len(values), max(0, (int(values[-1]) // len(values)).bit_length() - 1)
    low = np.packbits((values[:, None] >> np.arange(width)) & 1, bitorder="little") if width else np.zeros(0, np.uint8)
    ones = (values >> width) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    return _HEAD.pack(n, width) + low.tobytes() + np.packbits(high, bitorder="little").tobytes()


def n_values(packed: bytes) -> int:
    return _HEAD.unpack_from(packed)[0]


def select(packed: bytes, places: list[int]) -> list[int]:
    """The values at some places of the list."""
    n, width = _HEAD.unpack_from(packed)
    raw = np.frombuffer(packed, np.uint8, offset=_HEAD.size)
    n_low = (n * width + 7) // 8
    high = raw[n_low:]
    upto = np.cumsum(np.bitwise_count(high), dtype=np.int64)
    out = []
    for i in places:
        byte = int(np.searchsorted(upto, i + 1))
        nth = i - int(upto[byte] - np.bitwise_count(high[byte]))
        one = byte * 8 + int(np.flatnonzero(np.unpackbits(high[byte : byte + 1], bitorder="little"))[nth])
        first = i * width
        low = int.from_bytes(raw[first // 8 : (first + width + 7) // 8].tobytes(), "little") >> first % 8 & (1 << width) - 1 if width else 0
        out.append((one - i) << width | low)
    return out


@F.pandas_udf(T.BinaryType())
def boundary_list(text: pd.Series) -> pd.Series:
    return text.map(lambda t: elias_fano(boundaries(t)))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "cut", "turn")]))
def cuts(packed: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    """The number of tokens, and the code points before the middle and before the suffix."""
    rows = []
    for p, a, b in zip(packed, h1, h2, strict=True):
        n = n_values(p) - 1
        rows.append((n, *select(p, sorted((a % (n + 1), b % (n + 1))))))
    return pd.DataFrame(rows, columns=["n", "cut", "turn"])


def text_index(rows: DataFrame) -> DataFrame:
    """(key, digest, text, bounds, salts) of each distinct text of rows (key, n, text), n being the number of rows with the key."""
    distinct = rows.groupBy("key", "text").agg(F.max("n").alias("n"))
    return written(
        distinct.select("key", F.unhex(F.sha2("text", 256)).alias("digest"), "text", boundary_list("text").alias("bounds"), F.ceil(F.col("n") / PER_SALT).cast("int").alias("salts")), "texts"
    )


def draws(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def form_of(text: Column, h3: Column, h4: Column) -> Column:
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    return F.when((text == "") | marked | (h3 % 100 >= CUT), "plain").when(h4 % 100 < SPM, "spm").otherwise("psm")


def restore(output: Column, form: Column) -> Column:
    """The text from output and form alone. No mark can start inside another one or end inside a text, so the first of each kind is the one that was put there."""
    at = lambda mark: F.locate(mark, output)
    between = lambda a, b: F.substring(output, a + 3, b - a - 3)
    rest = lambda a: F.substring(output, a + 3, F.length(output))
    psm = F.concat(between(at(PREFIX), at(SUFFIX)), rest(at(MIDDLE)), between(at(SUFFIX), at(MIDDLE)))
    spm = F.concat(between(at(PREFIX), at(MIDDLE)), rest(at(MIDDLE)), between(at(SUFFIX), at(PREFIX)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain) and output of each row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    counted = source.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    repeated = fitting(written(counted, "repeated"), BROADCAST_KEYS)
    index = text_index(source.join(repeated, "key"))
    # Merged, not broadcast: Spark's estimate doesn't know how far a small index spreads.
    dealt = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").hint("merge")
    salt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.ceil(F.col("n") / PER_SALT)).cast("int")
    copies = source.join(repeated, "key").select("doc_id", "key", F.unhex(F.sha2("text", 256)).alias("digest"), salt.alias("salt")).join(dealt, ["key", "digest", "salt"])
    alone = source.join(repeated, "key", "left_anti").withColumn("bounds", boundary_list("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    of = lambda rows: rows.select("doc_id", "text", form_of(F.col("text"), h3, h4).alias("form"), cuts("bounds", h1, h2).alias("at"))
    cut = of(alone).unionByName(of(copies))  # each side by itself, so that a text of its own visits Python once
    part = lambda a, n: F.substring(F.col("text"), a + 1, n)
    before, turn, end = F.col("at.cut").cast("int"), F.col("at.turn").cast("int"), F.length("text")
    prefix, middle, suffix = part(F.lit(0), before), part(before, turn - before), part(turn, end)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col("text"))
    )
    known = F.col("form") != "plain"
    return cut.select(
        "doc_id", F.col("at.n").alias("n"), "form", F.when(known, F.col("at.cut")).alias("prefix_chars"), F.when(known, F.col("at.turn") - F.col("at.cut")).alias("middle_chars"), output.alias("output"),
    )
