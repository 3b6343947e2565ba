"""The evidence of each (incident, node) in one nested row, and the records of a run over such rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayglass.schema import FUTURE

GROUPS = ("base", "normal", "patterns", "memory", "upstream")


def assemble(windows: DataFrame, incidents: DataFrame, base: DataFrame | None = None, normal: DataFrame | None = None, patterns: DataFrame | None = None, memory: DataFrame | None = None,
             upstream: DataFrame | None = None, enabled: tuple[str, ...] = GROUPS) -> DataFrame:
    """incident_id, node, status, evidence (a struct) and evaluation of each incident at each of its nodes.

    windows: node, step, hist, fut. incidents: incident_id, node, step, layer and any further columns, which are the incident's payload; its duration is not known yet and left out. base: node, step,
    base. normal: incident_id, node, normal, ... . patterns, memory and upstream: incident_id, node and columns of evidence, several rows each, gathered in order. Parts that
    are not given or not enabled are null. A window of zeros is a sensor that is down: its evidence stays empty, whatever is given.
    """
    at = incidents.join(windows.select("node", "step", "hist", "fut"), ["node", "step"])
    hidden = {"incident_id", "node", "step", "duration_minutes", "layer", "hist", "fut"}
    payload = [c for c in incidents.columns if c not in hidden]
    down = F.forall("hist", lambda x: x == 0)
    out = at.withColumn("status", F.when(down, "missing_all_zero").otherwise("observed"))
    keys = ["incident_id", "node"]
    if base is not None:
        out = out.join(base.select("node", "step", "base"), ["node", "step"], "left")
    if normal is not None:
        parts = [c for c in normal.columns if c not in keys]
        out = out.join(normal.select(*keys, F.struct(*parts).alias("normal")), keys, "left")
    for name, part in (("patterns", patterns), ("memory", memory), ("upstream", upstream)):
        if part is not None:
            columns = [c for c in part.columns if c not in keys]
            out = out.join(part.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name)), keys, "left")  # bounded: top-k lists and the layer before
    given = [n for n in GROUPS if n in out.columns and n in enabled]
    whole = lambda c: F.when(F.col("status") == "observed", c)
    evidence = F.struct(F.col("hist").alias("history"), F.struct("incident_id", "step", "layer", *payload).alias("incident"), *[whole(F.col(n)).alias(n) for n in given])
    evaluation = F.struct(F.col("fut").alias("y"), *([F.col("base")] if "base" in given else []))
    return out.select(*keys, "layer", "status", evidence.alias("evidence"), evaluation.alias("evaluation"))


def without(evidence: str, dropped: tuple[str, ...]) -> Column:
    """The evidence without some of its parts, for readers that may not see them."""
    return F.col(evidence).dropFields(*dropped)


def rendered(contexts: DataFrame) -> DataFrame:
    """Adds body: the evidence as JSON."""
    return contexts.withColumn("body", F.to_json("evidence"))


def result_records(contexts: DataFrame, predictions: DataFrame) -> DataFrame:
    """One record a node: prediction, the mask of its metrics, and where it came from.

    predictions: incident_id, node, prediction (FUTURE values). A sensor that is down gets zeros, which go on to the next layer, and no metric counts them; an observed one without a prediction has none.
    """
    zeros = F.array_repeat(F.lit(0.0), FUTURE)
    out = contexts.join(predictions.select("incident_id", "node", "prediction"), ["incident_id", "node"], "left")
    down = F.col("status") == "missing_all_zero"
    return out.select(
        "incident_id", "node", "layer", "status", F.when(down, zeros).otherwise(F.col("prediction")).alias("prediction"), F.col("evaluation.y").alias("y"),
        F.array_repeat(~down & F.col("prediction").isNotNull(), FUTURE).alias("metric_mask"), F.when(down, "skip_metrics_zero_sensor").alias("policy"))
