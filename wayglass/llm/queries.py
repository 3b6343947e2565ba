"""One query for each operator over its whole table, with production parameters, and SQL where it can express the query."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayglass.llm import bpe, chat, exact_dedup, fill_middle, html_text, language, line_dedup, merkle, mixing, oracles, quality, sharding, simhash, toxicity
from wayglass.llm.shared import table

LEVELS = ["domain", "lang", "source"]
#: Target weights of the mixture: parts of the parent's budget. Sources not named weigh 1 each.
WEIGHTS = {"domain": {"core": 3, "web": 6, "tail": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}
MIX = {"share": 0.6, "max_epochs": 3, "seed": 17}
TOXIC_FROM = 0.7


def tokenizer_path() -> str:
    """WAYGLASS_TOKENIZER, else the installed public file."""
    if own := os.environ.get("WAYGLASS_TOKENIZER"):
        return own
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def with_domain(docs: DataFrame) -> DataFrame:
    """The domain of a source by its number: 0 is core, 1 to 9 are web, all else is the tail."""
    n = F.regexp_extract(F.coalesce(F.col("source").cast("string"), F.lit("")), "^src([0-9]{1,9})$", 1)
    return docs.withColumn("domain", F.when(n == "", "tail").when(n.try_cast("int") == 0, "core").when(n.try_cast("int") < 10, "web").otherwise("tail"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents with the times each is taken (0 too)."""
    taken = mixing.mix(with_domain(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")), LEVELS, WEIGHTS, **MIX)
    return taken.select(F.col("__id").alias("doc_id"), *LEVELS, F.col("tokens").alias("n_tokens"), F.col("copies").cast("long").alias("copies"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), limit=3, shingle=3)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat.format_chats(turns.unionByName(own)).drop("formatted", "loss")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), n_shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "text_group")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxic_grammar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Grammar:
    """Fitted to the labelled rows that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).where("toxic is not null").select("doc_id", "toxic").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "toxic").limit(toxicity.MAX_FIT)
    return toxicity.fit(docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id"))  # MAX_FIT rows at most


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxic_grammar(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.rate(docs, quality.fit(docs, trusted))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=1)
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, 1).otherwise(0)
    rows = merkle.manifest(table(spark, sf_dir, "documents"), {"n_chars": tampered})
    folded = rows.withColumn("folded_root", merkle.fold(F.col("changed_leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    aside = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = language.identify(docs, language.fit(docs.where(~aside)))
    return found.select("doc_id", aside.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_bpe, op3_simhash, op4_exact_dedup, op5_chat, op6_shards, op7_html_text, op8_toxicity, op9_quality, op10_line_dedup, op11_fill_in_middle, op12_merkle_manifest, op13_language_id)
}
ORACLES: dict[str, str] = {
    "op1_mix_sources": oracles.mixing_sql(LEVELS, WEIGHTS, **MIX),
    "op4_exact_dedup": oracles.EXACT,
    "op5_chat": oracles.CHAT,
    "op10_line_dedup": oracles.LINES,
    "op11_fill_in_middle": oracles.MIDDLE,
    "op12_merkle_manifest": oracles.merkle_sql(),
}
