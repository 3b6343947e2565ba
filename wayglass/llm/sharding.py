"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by seeded digests and ranked; the row of rank r among n stands at the fraction
(2r + 1) / 2n of its source. The shuffle goes by a digest of the text first (to 12 bits), then by one of id and text, so that equal texts, of one source or of
several, get near fractions and mostly one shard; a group too large for a shard, or at a cut, goes on in the next. All rows are sorted by fraction, and the sorted run is cut into shards whose row counts differ by
one at most, so every stretch of the run, and so every shard, has the sources in their proportion in the whole.

Neither ranking nor cutting sorts a source or the run in one task: both count rows per range first (of the digest, then of the
fraction), turn the counts into offsets, and rank inside a range only.

Defined cases: null text has size 16 and the CRC of no bytes; a null source is a source of its own; equal rows are ordered by id
and digest and keep a place each; an empty table gives an empty result; other columns pass through `sharded`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayglass.llm.shared import written

#: Ranges the run is counted in; each holds so small a part of it that one task ranks it with ease.
RANGES = 4096
#: Bits of the text's and of the row's digest that make the ranges a source is counted in: a text that is a third of all rows is split in 256.
TEXT_BITS, ROW_BITS = 12, 8


def _rank_in(rows: DataFrame, group: list[str], range_: str, order: list, to: str) -> DataFrame:
    """Rank rows from 0 within group by (range_, order...), through the number of rows in the ranges before."""
    counts = rows.groupBy(*group, range_).agg(F.count("*").alias("__n"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(over.orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = offsets.withColumn("__all", F.sum("__n").over(over)).drop("__n")
    ranked = rows.join(F.broadcast(offsets) if not group else offsets, [*group, range_])  # without groups: RANGES rows
    return ranked.withColumn(to, F.col("__before") + F.row_number().over(Window.partitionBy(*group, range_).orderBy(*order)) - 1).drop("__before")


def assign_shards(docs: DataFrame, n_shards: int = 40, seed: int = 23, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, text_group (a hash of the text), digest, shard (0 to n_shards - 1) and slot (gapless from 0 in its shard) of each row."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    light = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(source_col).isNull().alias("no_source"),
            (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
            F.xxhash64(F.lit(seed), F.col(id_col), body).alias("digest"), F.xxhash64(F.lit(seed), body).alias("text_group"),
        ), "light",
    )
    rows = light.withColumn("near", F.shiftrightunsigned("text_group", 64 - TEXT_BITS).cast("int")).withColumn("range", F.shiftrightunsigned("digest", 64 - ROW_BITS).cast("int"))
    source = ["source", "no_source"]
    # Rows before a range are those in the text ranges before, 4,096 a source, and those before in its own text range, 256 counts.
    counts = written(rows.groupBy(*source, "near", "range").agg(F.count("*").alias("n")), "counts")
    earlier = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = counts.groupBy(*source, "near").agg(F.sum("n").alias("n"))
    near = near.withColumn("__before", earlier(source, "near")).withColumn("__all", F.sum("n").over(Window.partitionBy(*source))).drop("n")
    inside = counts.withColumn("__inside", earlier([*source, "near"], "range")).drop("n")
    ranked = rows.join(inside.join(near, [*source, "near"]), [*source, "near", "range"])
    place = F.row_number().over(Window.partitionBy(*source, "near", "range").orderBy("digest", "doc_id", "text_crc32"))
    ranked = ranked.withColumn("rank", F.col("__before") + F.col("__inside") + place - 1).drop("near", "range", "__before", "__inside")
    run = ranked.withColumn("fraction", (F.col("rank") * 2 + 1) / (F.col("__all") * 2)).drop("__all")
    run = written(run.withColumn("range", F.least(F.floor(F.col("fraction") * RANGES), F.lit(RANGES - 1)).cast("int")), "run")
    cut = _rank_in(run, [], "range", ["fraction", "source", "no_source", "rank"], "place")
    return (
        cut.withColumn("shard", F.expr(f"cast((place * {n_shards}) div __all as int)"))
        .withColumn("slot", F.expr(f"place - (cast(shard as bigint) * __all + {n_shards - 1}) div {n_shards}"))
        .select("doc_id", "source", "no_source", "size", "text_crc32", "text_group", "digest", "shard", "slot")
    )


def sharded(docs: DataFrame, n_shards: int = 40, seed: int = 23, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with __shard and __slot. Rows alike in id and text may swap places with each other."""
    place = assign_shards(docs, n_shards, seed, id_col, text_col, source_col)
    twin = Window.partitionBy("digest").orderBy("shard", "slot")
    place = place.select("digest", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"), F.row_number().over(twin).alias("__twin"))
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    own = docs.withColumn("digest__", F.xxhash64(F.lit(seed), F.col(id_col), body))
    own = own.withColumn("__twin", F.row_number().over(Window.partitionBy("digest__").orderBy(id_col)))
    return own.join(place.withColumnRenamed("digest", "digest__"), ["digest__", "__twin"]).select(*docs.columns, "__shard", "__slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, seed: int = 23) -> None:
    """One folder a shard, rows in slot order."""
    out = sharded(docs, n_shards, seed)
    out.repartition(n_shards, "__shard").sortWithinPartitions("__shard", "__slot").write.partitionBy("__shard").parquet(path)
