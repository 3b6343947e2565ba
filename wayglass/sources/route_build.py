"""The route table of incidents and sensors, built block by block and resumed where it broke off.

A block is a range of incidents and a range of destinations; blocks are numbered, and so many in a row are one commit: its rows are written to a folder of their own, then a note under `done` names the folder. Rows without a note don't count,
and a commit that has a note is never built again, so a build may end at any time and start anew. The plan (inputs by their contents, sizes) is kept beside the notes; another plan under the same path raises.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayglass.functions.keys import bearing_deg, haversine_km
from wayglass.operators.ranks import ranked
from wayglass.sources.scratch import written
from wayglass.sources.tables import _path, exists, fingerprint, read_json, write_json

#: From pairs (incident_id, node_index, a_lat, a_lng, b_lat, b_lng) to incident_id, node_index, distance_m, duration_s; pairs without a route may be missing or null.
Router = Callable[[DataFrame], DataFrame]
#: Incidents and destinations of a block, blocks of a commit.
INCIDENTS, DESTINATIONS, BLOCKS = 1_000, 99, 25


def straight(factor: float = 1.3, metres_a_second: float = 13.8889) -> Router:
    """The straight line made longer, in place of a routing service."""

    def route(pairs: DataFrame) -> DataFrame:
        m = haversine_km(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")) * 1000 * factor
        return pairs.select("incident_id", "node_index", m.alias("distance_m"), (m / metres_a_second).alias("duration_s"))

    return route


def _done(spark: SparkSession, path: str) -> dict[int, str]:
    """Commits with a note, and their folders."""
    at, fs = _path(spark, f"{path}/done")
    if not fs.exists(at):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return {int(n[:-5]): read_json(spark, f"{path}/done/{n}")["data"] for n in names if n.endswith(".json")}


def build_routes(incidents: DataFrame, sensors: DataFrame, router: Router, path: str, rows: int = INCIDENTS, destinations: int = DESTINATIONS, blocks: int = BLOCKS, commits: int | None = None) -> int:
    """Build what is missing of the table of all incidents (incident_id, lat, lng) and sensors (node_index, lat, lng); the number of commits that are still missing. commits: so many at most in this run.

    Every pair gets a row; distance, duration and bearing are null without a route. A router that raises ends the run and loses its commit alone.
    """
    if min(rows, destinations, blocks) <= 0:
        raise ValueError("rows, destinations and blocks must be above 0")
    spark = incidents.sparkSession
    plan = {"incidents": fingerprint(incidents, ["incident_id", "lat", "lng"]), "sensors": fingerprint(sensors, ["node_index", "lat", "lng"]), "rows": rows, "destinations": destinations, "blocks": blocks}
    if exists(spark, f"{path}/plan.json") and (kept := read_json(spark, f"{path}/plan.json")) != plan:
        raise ValueError(f"{path} was begun with other inputs or sizes: {sorted(k for k in plan if kept.get(k) != plan[k])}")
    write_json(spark, f"{path}/plan.json", plan)
    a = incidents.select("incident_id", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"))
    b = sensors.select("node_index", F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"))
    a = written(ranked(a, [], [F.col("incident_id")], "__at").withColumn("i", F.expr(f"(__at - 1) div {rows}")).drop("__at"), "incidents")
    b = written(ranked(b, [], [F.col("node_index")], "__at").withColumn("j", F.expr(f"(__at - 1) div {destinations}")).drop("__at"), "sensors")
    n_i, n_j = (x.agg(F.max(c)).first()[0] for x, c in ((a, "i"), (b, "j")))
    if n_i is None or n_j is None:
        return 0
    n_blocks = (n_i + 1) * (n_j + 1)
    missing = [g for g in range(-(-n_blocks // blocks)) if g not in _done(spark, path)]
    for g in missing[:commits]:
        own = spark.range(g * blocks, min((g + 1) * blocks, n_blocks)).select(F.expr(f"id div {n_j + 1}").alias("i"), (F.col("id") % (n_j + 1)).alias("j"))
        pairs = a.join(own, "i").join(b, "j").select("incident_id", "node_index", "a_lat", "a_lng", "b_lat", "b_lng")
        known = router(pairs).where("distance_m >= 0 and duration_s >= 0 and not isnan(distance_m) and not isnan(duration_s)").select("incident_id", "node_index", "distance_m", "duration_s")
        bearing = bearing_deg(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
        out = pairs.withColumn("bearing", bearing).join(known, ["incident_id", "node_index"], "left")
        data = f"data/{g}-{uuid.uuid4().hex}"
        out.select("incident_id", "node_index", "distance_m", "duration_s", F.when(F.col("distance_m").isNotNull(), F.col("bearing")).alias("bearing_deg")).write.parquet(f"{path}/{data}")
        if not exists(spark, f"{path}/done/{g}.json"):
            write_json(spark, f"{path}/done/{g}.json", {"data": data})
    return max(0, len(missing) - (len(missing) if commits is None else commits))


def built_routes(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all commits with a note."""
    folders = sorted(_done(spark, path).values())
    if not folders:
        raise FileNotFoundError(f"nothing is built under {path}")
    return spark.read.parquet(*[f"{path}/{f}" for f in folders])
