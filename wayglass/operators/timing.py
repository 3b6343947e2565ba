"""Times of a run's parts as Spark itself has measured them: each query that a part runs is an execution of the engine, with its start and end."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "module: "
SCHEMA = "module string, execution long, started timestamp, ms double"


@contextmanager
def module(spark: SparkSession, name: str) -> Iterator[None]:
    """Queries that this thread runs inside are named after a module; modules may nest."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    context.setJobDescription(MARK + name)
    try:
        yield
    finally:
        context.setLocalProperty("spark.job.description", before)


def timings(spark: SparkSession) -> DataFrame:
    """module, execution, started and ms of each ended query that ran inside a module, as far as the engine keeps them (spark.sql.ui.retainedExecutions)."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    kept, rows = spark._jsparkSession.sharedState().statusStore().executionsList(), []
    for i in range(kept.size()):
        x = kept.apply(i)
        if x.completionTime().isDefined() and (x.description() or "").startswith(MARK):
            start = x.submissionTime()
            rows.append((x.description().removeprefix(MARK), x.executionId(), start, float(x.completionTime().get().getTime() - start)))
    made = spark.createDataFrame(rows, "module string, execution long, started long, ms double")
    return made.withColumn("started", F.timestamp_millis("started"))


def module_summary(times: DataFrame) -> DataFrame:
    """module, calls, total, least, most and mean of the ms of its queries."""
    return times.groupBy("module").agg(F.count("*").alias("calls"), F.sum("ms").alias("total"), F.min("ms").alias("least"), F.max("ms").alias("most"), F.avg("ms").alias("mean"))
