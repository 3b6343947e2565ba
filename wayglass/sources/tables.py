"""Reading and writing the library's inputs: tab-separated incidents and sensors, dense arrays, JSON lines, Parquet by month."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayglass.operators.memory import prune, upsert
from wayglass.operators.records import typed_incidents
from wayglass.schema import SENSORS, TRAFFIC

#: The columns of an incident file.
INCIDENT_COLUMNS = ("incident_id", "dt", "duration", "Latitude", "Longitude", "DESCRIPTION", "Type", "AREA", "LOCATION", "Fwy", "Freeway_direction")


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, then typed; ordered queries sort on dt themselves."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"`{c}` string" for c in INCIDENT_COLUMNS))
    return typed_incidents(raw.withColumnsRenamed({"Fwy": "freeway", "Freeway_direction": "direction"}))


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=SENSORS, enforceSchema=False)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def read_episodes(spark: SparkSession, path: str, schema: str, version: str, required: list[str] | None = None) -> DataFrame:
    """JSON lines of one schema version, without empty lines and rows that lack a required column; a malformed line fails the read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path).where(F.col("schema_version") == version)
    return df.na.drop("any", subset=required) if required else df


def clear_episodes(spark: SparkSession, path: str) -> int:
    """Empty a Parquet memory, keeping its columns; the number of rows it had."""
    df = spark.read.parquet(path)
    n = df.count()
    empty = spark.createDataFrame([], df.schema)
    empty.write.mode("overwrite").parquet(path)
    return n


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_json(spark: SparkSession, path: str) -> dict:
    """One JSON object of a file system that Spark reads."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one file
    return json.loads(text)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write a JSON object so that readers see the old or the new one: to a file beside it, which then takes its name."""
    target, fs = _path(spark, path)
    fresh, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    out.hsync()
    out.close()
    if not fs.rename(fresh, target):  # some file systems don't rename over a file
        fs.delete(target, False)
        if not fs.rename(fresh, target):
            raise OSError(f"could not write {path}")


ROUTE_VERSION = 1


def write_routes(routes: DataFrame, path: str, version: int = ROUTE_VERSION) -> None:
    """The route table in single precision, null where there is no route (missing, NaN or negative), with its version."""
    ok = lambda c: F.when(~F.isnan(c) & (F.col(c) >= 0), F.col(c).cast("float")).alias(c)
    out = routes.select(F.col("incident_id").cast("string").alias("incident_id"), F.col("node_index").cast("int").alias("node_index"), ok("distance_m"), ok("duration_s"), ok("bearing_deg"))
    out.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(path)


def read_routes(spark: SparkSession, path: str, version: int = ROUTE_VERSION) -> DataFrame:
    """A route (or index) table of this version; any other version raises."""
    df = spark.read.parquet(path)
    found = sorted(r["version"] for r in df.select("version").distinct().limit(5).collect())
    if found not in ([], [version]):
        raise ValueError(f"{path} holds version {found}, not {version}")
    return df.drop("version")


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """A hash of the rows' contents, whatever their order and partitions: what a cached table is keyed by."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(columns)])
    r = df.select(h.alias("h")).agg(F.count("*").alias("n"), F.expr("bit_xor(h)").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{sorted(columns)}|{r['n']}|{r['x']}|{r['s']}".encode()).hexdigest()


def validate_sources(spark: SparkSession, months: list[str], others: list[str]) -> None:
    """Twelve monthly files and the others have to be there."""
    if len(months) != 12:
        raise ValueError(f"12 monthly files are needed, got {len(months)}")
    if missing := [p for p in [*months, *others] if not exists(spark, p)]:
        raise FileNotFoundError(", ".join(missing))


def ordered_sensors(sensors: DataFrame, order: DataFrame, counties: list[str]) -> DataFrame:
    """Sensors of the counties with node_index, their place among those of `order` (position, node_id) that are theirs; a sensor that the order lacks, or holds twice, raises."""
    own = sensors.where(F.col("county").isin(counties)).drop("node_index")
    placed = own.join(order.select("node_id", "position"), "node_id", "left")
    n, m = own.count(), placed.where("position is not null").count()
    if n != m:
        raise ValueError(f"{n} sensors, but {m} places in the node order")
    index = placed.select("node_id", "position").withColumn("node_index", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("position")) - 1)  # sensors only: thousands
    return placed.drop("position").join(index.select("node_id", "node_index"), "node_id").orderBy("node_index")


def region_incidents(raw: DataFrame, areas: list[str]) -> tuple[DataFrame, DataFrame]:
    """Incidents of the areas, and their number per area."""
    own = raw.withColumn("AREA", F.trim(F.coalesce("AREA", F.lit("")))).where(F.col("AREA").isin(areas))
    return own, own.groupBy("AREA").agg(F.count("*").alias("n"))


def whole_year(traffic: DataFrame) -> DataFrame:
    """The traffic table if it has all twelve months, else an error that names the missing ones."""
    found = {r["month"] for r in traffic.select("month").distinct().limit(13).collect()}
    if found != set(range(1, 13)):
        raise ValueError(f"months missing: {sorted(set(range(1, 13)) - found)}, unknown: {sorted(found - set(range(1, 13)))}")
    return traffic


def positions(region: DataFrame, statewide: DataFrame) -> DataFrame:
    """node_index of the region's sensors and their statewide place (node_id, position); a sensor without one raises."""
    if missing := [r["node_id"] for r in region.join(statewide, "node_id", "left_anti").select("node_id").limit(5).collect()]:
        raise ValueError(f"no statewide place for {missing}")
    return region.select("node_id", "node_index").join(statewide.select("node_id", "position"), "node_id")


def network_distance(edges: DataFrame, at: DataFrame) -> DataFrame:
    """src, dst (node_index) and distance_km of statewide edges (src, dst as positions, distance_m): 0 on the diagonal, null where not above 0 or not finite."""
    side = lambda n: at.select(F.col("position").alias(n), F.col("node_index").alias(f"{n}_index"))
    m = F.col("distance_m")
    km = F.when(F.col("src") == F.col("dst"), 0.0).when(~F.isnan(m) & (m > 0) & (m < float("inf")), m / 1000)
    return edges.withColumn("distance_km", km).join(side("src"), "src").join(side("dst"), "dst").select(F.col("src_index").alias("src"), F.col("dst_index").alias("dst"), "distance_km")


def manifest(dataset: str, region: str, traffic: DataFrame | None, edges: DataFrame | None, incidents: DataFrame, sensors: DataFrame) -> dict:
    """What a regional extract holds: complete, missing_adjacency or metadata_only, with rows per month, edges, incidents per area and nodes."""
    months = None if traffic is None else [r.asDict() for r in traffic.groupBy("month").agg(F.count("*").alias("rows"), F.count_distinct("node_index").alias("nodes"), F.max("step").alias("last_step")).orderBy("month").collect()]
    adjacency = None if edges is None else {"edges": edges.where("weight <> 0").count()}
    status = "metadata_only" if months is None else "missing_adjacency" if adjacency is None else "complete"
    per = {r["AREA"]: r["n"] for r in incidents.groupBy("AREA").agg(F.count("*").alias("n")).orderBy("AREA").collect()}
    return {"dataset": dataset, "region": region, "status": status, "node_count": sensors.count(), "months": months, "adjacency": adjacency, "incidents": per, "channels": ["flow", "occupancy", "speed"]}


#: What a run leaves, and in which file.
RESULT_FILES = {
    "errors": "errors.json", "errors_by_step": "errors-by-step.json", "timings": "timings.json", "parts": "parts.json", "asked": "asked.json", "answered": "answered.json",
    "usable": "usable.tsv", "unusable": "unusable.tsv", "left_out": "left-out.tsv",
}


def result_path(root: str, region: str, model: str, mode: str, name: str) -> str:
    if name not in RESULT_FILES:
        raise ValueError(f"unknown result: {name}")
    return f"{root.rstrip('/')}/runs/{region}/{model}/{mode}/{RESULT_FILES[name]}"


def dense_to_rows(months: DataFrame, loader) -> DataFrame:
    """Rows of the traffic table from dense monthly arrays. months: month, path, start (timestamp); loader(path) gives [node, step, 3] on an executor."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for month, path, start in zip(f["month"], f["path"], f["start"], strict=True):
                data = loader(path)
                steps = np.arange(data.shape[1])
                for node in range(data.shape[0]):  # one node at a time, so memory is bounded by one series
                    x = np.asarray(data[node], float)
                    yield pd.DataFrame({"node_index": node, "month": month, "step": steps, "ts": pd.Timestamp(start) + pd.to_timedelta(steps * 5, unit="m"), "flow": x[:, 0], "occupancy": x[:, 1], "speed": x[:, 2]})

    return months.mapInPandas(run, TRAFFIC)


def write_traffic(traffic: DataFrame, path: str) -> None:
    """Parquet by month, sorted by node and step, so that a month's or a node's rows can be pruned."""
    traffic.repartition("month", "node_index").sortWithinPartitions("node_index", "step").write.mode("overwrite").partitionBy("month").parquet(path)


def read_traffic(spark: SparkSession, path: str, months: list[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("month").isin(months)) if months else df


def region_extract(sensors: DataFrame, counties: list[str], traffic: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sensors of the counties with their rows of traffic and the edges between them."""
    own = sensors.where(F.col("county").isin(counties))
    ids = own.select("node_index")
    inner = edges.join(ids.withColumnRenamed("node_index", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_index", "dst"), "dst", "left_semi")
    return own, traffic.join(ids, "node_index", "left_semi"), inner


def upsert_memory(spark: SparkSession, path: str, fresh: DataFrame, out: str, key: list[str], seq: str, time: str) -> None:
    """Old and fresh rows, the last of each key, within retention, written to a new folder (a reader never sees a half-written state)."""
    both = spark.read.parquet(path).unionByName(fresh) if path else fresh
    prune(upsert(both, key, seq), time, seq).write.mode("errorifexists").parquet(out)
