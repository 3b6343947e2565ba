"""Row types of the inputs and the tables the catalogue's queries run over.

The library's own inputs are sensors, incidents, a dense traffic grid, edges, routes and episodes (see `wayglass.sources`). The builders
below derive such tables from generic event, order and embedding tables; each is a plain DataFrame, so any other source with these columns will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayglass.functions.exact import round_ratio, units

SENSORS = T.StructType([
    T.StructField("node_index", T.IntegerType()), T.StructField("node_id", T.LongType()), T.StructField("county", T.StringType()),
    T.StructField("freeway", T.StringType()), T.StructField("direction", T.StringType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()), T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("freeway_name", T.StringType()),
])
TRAFFIC = "node_index int, month int, step int, ts timestamp_ntz, flow double, occupancy double, speed double"
EDGES = "src int, dst int, weight double"
ROUTES = "incident_id string, node_index int, distance_m float, duration_s float, bearing_deg float"

STEPS, STEP_MINUTES, CHUNK, FIRST_HOUR, EPOCH = 720, 60, 240, 473352, 1704067200
HISTORY = FUTURE = 12


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_step(ts: str = "ts"):
    return (F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(3_600_000_000)) - FIRST_HOUR).cast("long")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, step 0..719, flow (the exact sum of values of four decimal places), occupancy, speed; hours without an event are 0."""
    events = read(spark, sf_dir, "events")
    spine = events.select(F.col("event_type").alias("node")).distinct().select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(STEPS - 1).cast("long"))).alias("step"))
    seen = events.groupBy(F.col("event_type").alias("node"), hour_step().alias("step")).agg(
        F.sum(units(F.col("value"), 4)).alias("__units"), F.count("*").alias("occupancy"))
    seen = seen.select("node", "step", (F.col("__units").cast("double") / 10_000).alias("flow"), "occupancy", round_ratio(F.col("__units"), F.col("occupancy") * 10_000, 4).alias("speed"))
    return spine.join(seen, ["node", "step"], "left").na.fill(0.0, ["flow", "speed"]).na.fill(0, ["occupancy"])


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All error events as incidents."""
    errors = read(spark, sf_dir, "events").where("event_type = 'error'")
    return errors.select(F.col("event_id").alias("incident_id"), F.col("ts").alias("dt"), hour_step().alias("step"), F.expr("cast((event_id % 5 - 1) * 30 as bigint)").alias("duration_minutes"),
                         F.concat(F.lit("type "), (F.col("event_id") % 4).cast("string")).alias("kind"), F.concat(F.lit("area "), (F.col("event_id") % 7).cast("string")).alias("area"))


def incident_texts(incidents: DataFrame) -> DataFrame:
    """incident_id and the six texts of an incident: type, description, area, location, freeway and direction."""
    i = F.col("incident_id")
    n = lambda m: (i % m).cast("string")
    return incidents.select(
        "incident_id", F.col("kind").alias("type"), F.concat(F.lit("collision of "), F.col("kind"), F.lit(" near "), F.col("area"), F.lit(", lanes closed: "), n(5)).alias("description"), "area",
        F.concat(F.lit("exit "), n(97), F.lit(" in "), F.col("area")).alias("location"), F.concat(F.lit("US-"), n(9)).alias("freeway"), F.substring(F.lit("NSEW"), (i % 4 + 1).cast("int"), F.lit(1)).alias("direction"))


def incident_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """incident_id, node, km, seconds, bearing: a route of each incident to each node, at up to 250 km (2 % are within 5 km); null for every 13th."""
    nodes = read(spark, sf_dir, "events").select(F.col("event_type").alias("node")).distinct()
    pairs = incidents(spark, sf_dir).select("incident_id").join(F.broadcast(nodes.agg(F.collect_set("node").alias("nodes"))))  # one row: the named nodes
    pairs = pairs.select("incident_id", F.explode("nodes").alias("node"))
    spot = (F.col("incident_id") * 7919 + F.length("node") * 104729) % 100003
    km = F.when((F.col("incident_id") + F.length("node")) % 13 != 0, spot / 400.0)
    return pairs.select("incident_id", "node", km.alias("km"), F.round(km * 72, 4).alias("seconds"), F.when(km.isNotNull(), (spot % 360).cast("double")).alias("bearing"))


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as sensor", "38 + (s_suppkey % 97) / 100.0D as lat", "-121 - (s_suppkey % 89) / 100.0D as lng",
        "cast(s_nationkey % 7 as string) as road", "case s_suppkey % 4 when 0 then 'N' when 1 then 'S' when 2 then 'E' else 'W' end as direction")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey as site", "38 + (c_custkey * 7 % 97) / 100.0D as lat", "-121 - (c_custkey * 3 % 89) / 100.0D as lng",
        "cast(c_nationkey % 7 as string) as road", "case c_custkey % 4 when 0 then 'N' when 1 then 'S' when 2 then 'E' else 'W' end as direction")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst (nations of supplier and customer), weight in (0, 1]: order lines between them over the largest number."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("src"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("dst"))
    counts = (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(orders, line.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey).groupBy("src", "dst").agg(F.count("*").alias("n"))
    )
    return counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("most")))).select("src", "dst", (F.col("n") / F.col("most")).alias("weight"))  # one row


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    hours = lambda n: F.make_dt_interval(F.lit(0), n)
    v = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        v.alias("memory_id"), F.col("label").alias("node"), F.slice(e, 1, 16).alias("state"), F.slice(e, 17, 24).alias("decision"),
        F.slice(e, 41, 6).alias("reliability"), F.slice(e, 47, 12).alias("gap"),
        (start + hours(v.cast("int"))).alias("origin"), (start + hours((v + 12).cast("int"))).alias("available"),
        (v % 50).alias("incident"), (v % 3).alias("layer"), (v % 10 != 9).alias("has_normal"), (v % 24).alias("hour"), (F.element_at(e, 12) - F.element_at(e, 11)).alias("history_change"), (v % 37).alias("signature"),
        F.when(v % 11 != 0, F.col("label") % 7).alias("road"), (v % 4).alias("direction"), (v % 2 == 0).alias("same_direction"), F.when(v % 5 != 0, v % 3 == 0).alias("same_road"))
