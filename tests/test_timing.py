"""Times of real queries, from the engine."""

import time

import pytest
from pyspark.sql import functions as F

from wayglass.operators import metrics, timing


def test_timings_of_three_queries(spark):
    wait = F.udf(lambda x: time.sleep(0.3) or x, "long")
    began = time.time()
    with timing.module(spark, "read"):
        spark.range(10).count()
        with timing.module(spark, "wait"):
            spark.range(1).select(wait("id")).collect()
        spark.range(20).count()
    spark.range(5).count()  # outside
    spent = (time.time() - began) * 1000
    times = timing.timings(spark)
    summary = {r.module: r for r in timing.module_summary(times).collect()}
    assert set(summary) >= {"read", "wait"} and summary["read"].calls == 2 and summary["wait"].calls == 1
    assert 300 <= summary["wait"].total == summary["wait"].least == summary["wait"].most == summary["wait"].mean <= spent
    read = summary["read"]
    assert read.least + read.most == read.total == pytest.approx(2 * read.mean) and read.total + summary["wait"].total <= spent
    whole = metrics.processing_summary(times.where("module in ('read', 'wait')"), "ms").first()
    assert (whole.incidents, whole.total_ms) == (3, read.total + summary["wait"].total)


def test_failed_queries_are_timed_too(spark):
    with pytest.raises(Exception, match="wrong"), timing.module(spark, "fails"):
        spark.range(1).select(F.raise_error(F.lit("wrong"))).collect()
    assert timing.timings(spark).where("module = 'fails'").count() == 1 and spark.sparkContext.getLocalProperty("spark.job.description") is None
