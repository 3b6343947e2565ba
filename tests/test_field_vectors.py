"""Hashed text fields: rows with the same texts are hashed once, and each row keeps the vector of its own."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from wayglass.operators import similarity


def test_equal_texts_are_hashed_once(spark):
    dims = {"kind": 16, "road": 8}
    texts = spark.range(600).select("id", F.concat(F.lit("a crash of type "), F.col("id") % 3).alias("kind"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("road"))
    told = Observation("texts")
    got = similarity.field_vectors(texts, "v", dims, each=lambda t: t.observe(told, F.count(F.lit(1)).alias("n"))).collect()
    assert told.get["n"] == 15 and sorted(r.id for r in got) == list(range(600))
    one = similarity.field_vectors(texts.where("id < 15"), "v", dims).collect()
    alone = {(r.kind, r.road): r.v for r in one}
    assert len(alone) == 15 and all(r.v == alone[r.kind, r.road] for r in got)
    assert all(r.v[16:] == [0.0] * 8 for r in got if r.road is None) and all(abs(sum(x * x for x in r.v[:16]) - 1) < 1e-12 for r in got)
