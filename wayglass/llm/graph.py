"""Connected components of a table of links, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayglass.llm.shared import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours above (large) or not above (small) each node to its smallest neighbour or itself."""
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ends.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = ends.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b: long), root being the smallest node reachable.

    Rounds grow with the logarithm of the longest chain. Self-links count for nothing; no links give no rows.
    """
    links = written(links.select("a", "b").where("a <> b").distinct(), "links")
    last = None
    while True:
        links = written(_star(_star(links, True), False), "stars")
        now = tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0))).first())
        if now == last:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = now
