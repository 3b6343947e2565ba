"""The catalogue: one query per operator over whole tables, each with the same query in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayglass import schema as S
from wayglass.functions import arrays as A
from wayglass.functions.exact import near_round
from wayglass.functions.keys import period
from wayglass.operators import counterfactual as N
from wayglass.operators import memory as M
from wayglass.operators import metrics as E
from wayglass.operators import patterns as R
from wayglass.operators import asof, blocks, context, forecasts, records, spatial, token_index, vector_index
from wayglass.operators import similarity as V
from wayglass.operators import timeseries as TS
from wayglass.operators.records import rounded
from wayglass.sources.registry import Registry
from wayglass.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BANDS_KM = ((0.0, 20.0), (20.0, 40.0), (40.0, 60.0))
#: Straight kilometres within which routes are looked up: the last band over the 1.3 by which routes are longer. Kilometres of the pair queries.
ROUTE_KM, PAIR_KM = 46.2, 10.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def ratio_(num: str, den: str, digits: int) -> str:
    """num / den, whole numbers, rounded half away from zero: see functions.exact."""
    return f"(sign({num}) * CAST((2 * abs({num}) * {10**digits}::HUGEINT + {den}) // (2 * {den}) AS DOUBLE) / {10.0**digits}::DOUBLE + 0.0)"


# pieces of SQL -----------------------------------------------------------------------------------------------------
GRID = """grid AS (SELECT n.node, s.step, coalesce(a.flow, 0.0) AS flow, coalesce(a.occupancy, 0) AS occupancy, coalesce(a.speed, 0.0) AS speed
 FROM (SELECT DISTINCT event_type AS node FROM events) n CROSS JOIN (SELECT unnest(range(720)) AS step) s
 LEFT JOIN (SELECT node, step, CAST(u AS DOUBLE) / 10000.0::DOUBLE AS flow, n AS occupancy, """ + ratio_("u", "(n * 10000)", 4) + """ AS speed
  FROM (SELECT event_type AS node, CAST(floor(epoch(ts)/3600) AS BIGINT) - 473352 AS step, sum(CAST(round(value * 10000) AS HUGEINT)) AS u, count(*) AS n FROM events GROUP BY 1, 2)) a ON a.node = n.node AND a.step = s.step)"""
WIN = GRID + """, win AS (SELECT * FROM (SELECT node, step, step // 240 AS chunk, list(flow) OVER h AS hist, list(flow) OVER f AS fut, list(CAST(occupancy AS DOUBLE)) OVER h AS occ, list(speed) OVER h AS spd
 FROM grid WINDOW h AS (PARTITION BY node, step // 240 ORDER BY step ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), f AS (PARTITION BY node, step // 240 ORDER BY step ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING))
 WHERE len(hist) = 12 AND len(fut) = 12)"""
INC = """inc AS (SELECT event_id AS incident_id, ts AS dt, CAST(floor(epoch(ts)/3600) AS BIGINT) - 473352 AS step, CAST((event_id % 5 - 1) * 30 AS BIGINT) AS duration_minutes, 'type ' || (event_id % 4) AS kind, 'area ' || (event_id % 7) AS area FROM events WHERE event_type = 'error'),
 loc AS (SELECT *, round(km * 72, 4) AS seconds, CAST(spot % 360 AS DOUBLE) AS bearing FROM (SELECT *, CASE WHEN (incident_id + length(node)) % 13 <> 0 THEN spot / 400.0::DOUBLE END AS km FROM (SELECT inc.*, node, (incident_id * 7919 + length(node) * 104729) % 100003 AS spot FROM inc CROSS JOIN (SELECT DISTINCT event_type AS node FROM events))) WHERE km BETWEEN 0 AND 5)"""
EXC = """exc AS (SELECT node, epoch(dt) - 1704067200 - 1800 - 3600 AS lo, epoch(dt) - 1704067200 + (CASE WHEN duration_minutes > 0 THEN duration_minutes ELSE 60 END) * 60 + 3300 AS hi FROM loc)"""
FREE = "free AS (SELECT * FROM win w WHERE NOT EXISTS (SELECT 1 FROM exc e WHERE e.node = w.node AND w.step * 3600 BETWEEN e.lo AND e.hi))"
SEN = "sen AS (SELECT s_suppkey AS sensor, 38 + (s_suppkey % 97) / 100.0::DOUBLE AS lat, -121 - (s_suppkey % 89) / 100.0::DOUBLE AS lng, CAST(s_nationkey % 7 AS VARCHAR) AS road, CASE s_suppkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' ELSE 'W' END AS direction FROM supplier)"
SIT = "sit AS (SELECT c_custkey AS site, 38 + (c_custkey * 7 % 97) / 100.0::DOUBLE AS lat, -121 - (c_custkey * 3 % 89) / 100.0::DOUBLE AS lng, CAST(c_nationkey % 7 AS VARCHAR) AS road, CASE c_custkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' ELSE 'W' END AS direction FROM customer)"


def hav(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    return f"(2 * 6371.0088 * atan2(sqrt({a}), sqrt(greatest(1 - {a}, 0.0))))"


def bear(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    y = f"sin(radians({lng2} - {lng1})) * cos(radians({lat2}))"
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lng2} - {lng1}))"
    return f"((degrees(atan2({y}, {x})) + 720) % 360)"


HAV, BEAR = hav("a.lat", "a.lng", "b.lat", "b.lng"), bear("a.lat", "a.lng", "b.lat", "b.lng")
ROUTES = f"""{SIT}, {SEN}, rt0 AS (SELECT a.site, b.sensor, CASE WHEN (a.site + b.sensor) % 11 <> 0 THEN round({HAV} * 1300, 4) END AS distance_m, CASE WHEN (a.site + b.sensor) % 11 <> 0 THEN round({BEAR}, 4) END AS bearing_deg,
 a.road = b.road AS same_road, a.direction = b.direction AS same_direction FROM sit a CROSS JOIN sen b WHERE round({HAV}, 6) <= 46.2),
 rt AS (SELECT *, round(distance_m / 13.8889, 4) AS duration_s FROM rt0),
 scoped AS (SELECT *, CASE WHEN distance_m / 1000 >= 0 AND distance_m / 1000 <= 20 THEN 0 WHEN distance_m / 1000 > 20 AND distance_m / 1000 <= 40 THEN 1 WHEN distance_m / 1000 > 40 AND distance_m / 1000 <= 60 THEN 2 END AS layer FROM rt)"""
EDG = """cnt AS (SELECT CAST(s_nationkey AS INT) AS src, CAST(c_nationkey AS INT) AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
 edg AS (SELECT src, dst, n::DOUBLE / (SELECT max(n) FROM cnt) AS weight FROM cnt)"""
EPI = """epi AS (SELECT vec_id AS memory_id, label AS node, e[1:16] AS state, e[17:40] AS decision, e[41:46] AS reliability, e[47:58] AS gap, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * vec_id AS origin, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (vec_id + 12) AS available,
 vec_id % 50 AS incident, vec_id % 3 AS layer, vec_id % 10 <> 9 AS has_normal, vec_id % 24 AS hour, e[12] - e[11] AS history_change, vec_id % 37 AS signature, CASE WHEN vec_id % 11 <> 0 THEN label % 7 END AS road, vec_id % 4 AS direction, vec_id % 2 = 0 AS same_direction, CASE WHEN vec_id % 5 <> 0 THEN vec_id % 3 = 0 END AS same_road
 FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))"""


def each(expr: str, n: int = 12, lo: int = 1) -> str:
    return f"[{expr} for i in range({lo}, {n + 1})]"


def mean_(expr: str, n: int = 12) -> str:
    return f"(list_sum({each(expr, n)}) / {n})"


def rmse_(a: str, b: str, n: int = 12) -> str:
    return f"sqrt({mean_(f'({a}[i] - {b}[i]) * ({a}[i] - {b}[i])', n)})"


def median_(a: str) -> str:
    return f"((list_sort({a})[6] + list_sort({a})[7]) / 2)"


def robust_(a: str) -> str:
    """The scaled list, as SQL; its median and scale are computed inline."""
    return f"list_transform({a}, lambda x: greatest(least((x - {median_(a)}) / greatest(1.4826 * {median_(f'list_transform({a}, lambda z: abs(z - {median_(a)}))')}, 1.0), 8.0), -8.0))"


def features_(p: str = "") -> str:
    out = []
    for c, least in TS.CHANNELS:
        scale = f"greatest({mean_(f'abs({c}[i])')}, {least})"
        out.append(f"{scale} AS scale_{c}, list_sum({each(f'{c}[i] * (i - 6.5)')}) / 143.0 / {scale} AS trend_{c}, sqrt(greatest({mean_(f'{c}[i] * {c}[i]')} - {mean_(f'{c}[i]')} * {mean_(f'{c}[i]')}, 0.0)) / {scale} AS vol_{c}")
    return ", ".join(out)


HOLI = ", ".join(f"'{d}'" for d in ("2024-01-01", "2024-01-15", "2024-02-19", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-10-14", "2024-11-11", "2024-11-28", "2024-12-25"))


def calendar_(ts: str) -> str:
    return f"CAST({ts} AS DATE) AS day, CAST(hour({ts}) AS INT) AS hour, CAST(isodow({ts}) - 1 AS INT) AS weekday, isodow({ts}) >= 6 AS weekend, strftime({ts}, '%Y-%m-%d') IN ({HOLI}) AS holiday, CASE WHEN hour({ts}) < 6 OR hour({ts}) >= 20 THEN 'night' WHEN hour({ts}) < 10 THEN 'morning_peak' WHEN hour({ts}) < 16 THEN 'midday' ELSE 'evening_peak' END AS period"


# scans and time series -------------------------------------------------------------------------------------------
def _raw(spark, d):
    return S.read(spark, d, "events").select(
        F.col("event_id").cast("string").alias("incident_id"), F.date_format("ts", "MM/dd/yyyy HH:mm:ss").alias("dt"), F.round("value", 2).cast("string").alias("duration"),
        F.expr("case event_id % 3 when 0 then concat(cast(user_id as string), '.0') when 1 then ' US-50 ' else cast(user_id as string) end").alias("freeway"),
        F.expr("case event_id % 2 when 0 then ' n ' else 'S' end").alias("direction"))


@query("""SELECT CAST(event_id AS VARCHAR) AS incident_id, date_trunc('second', ts) AS dt, round(value, 2) AS duration_minutes, CASE event_id % 3 WHEN 1 THEN 'US-50' ELSE CAST(user_id AS VARCHAR) END AS road, CASE event_id % 2 WHEN 0 THEN 'N' ELSE 'S' END AS direction FROM events""")
def scan_typed_incidents(spark, d):
    return records.typed_incidents(_raw(spark, d))


@query("SELECT trim(n_name) AS area, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1")
def region_extract_counts(spark, d):
    nation = S.read(spark, d, "nation").join(S.read(spark, d, "region").where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    joined = S.read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.trim("n_name").alias("area")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT event_type AS node, time_bucket(INTERVAL '5 minutes', ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def step_bucketing_5min(spark, d):
    return S.read(spark, d, "events").groupBy(F.col("event_type").alias("node"), F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n")).select("node", F.col("w.start").alias("bucket"), "n")


@query(f"WITH {GRID} SELECT node, step, flow, occupancy, speed FROM grid")
def dense_grid_fill(spark, d):
    return S.grid(spark, d).select("node", "step", "flow", "occupancy", "speed")


@query(f"SELECT event_id, {calendar_('ts')} FROM events")
def calendar_features(spark, d):
    return TS.with_calendar(S.read(spark, d, "events").select("event_id", "ts"), F.col("ts")).drop("ts", "free")


@query(f"WITH {WIN} SELECT node, step, chunk, round(list_sum(hist), 4) AS hist_sum, round(list_sum(fut), 4) AS fut_sum, hist[1] AS first, hist[12] AS last, fut[1] AS next, fut[12] AS final FROM win")
def window_12_12(spark, d):
    at = lambda c, i: F.element_at(c, i)
    return TS.windows(S.grid(spark, d)).select("node", "step", "chunk", F.round(A.total(F.col("hist")), 4).alias("hist_sum"), F.round(A.total(F.col("fut")), 4).alias("fut_sum"), at("hist", 1).alias("first"), at("hist", 12).alias("last"), at("fut", 1).alias("next"), at("fut", 12).alias("final"))


@query(f"WITH {WIN} SELECT node, step, round(list_sum(hist), 4) AS flow, CAST(list_sum(occ) AS BIGINT) AS occupancy, round(list_sum(spd), 4) AS speed, NOT list_contains([x <> 0 for x in hist], true) AS all_zero FROM win")
def window_three_channel(spark, d):
    return TS.windows(S.grid(spark, d)).select("node", "step", F.round(A.total(F.col("hist")), 4).alias("flow"), A.total(F.col("occ")).cast("bigint").alias("occupancy"), F.round(A.total(F.col("spd")), 4).alias("speed"), F.forall("hist", lambda x: x == 0).alias("all_zero"))


@query("""SELECT p.event_id, (SELECT arg_max(c.event_id, (c.ts, c.event_id)) FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts < p.ts) AS click_id FROM events p WHERE p.event_type = 'purchase'""")
def asof_last_click(spark, d):
    """Each purchase with the user's last click before it."""
    e = S.read(spark, d, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    clicks = e.where("event_type = 'click'").select("user_id", "at", F.col("event_id").alias("click_id"))
    return asof.asof_join(e.where("event_type = 'purchase'"), clicks, ["user_id"], "at", ["click_id"], 5 * 86_400, strict=True, tie="click_id").select("event_id", "click_id")


FEATS = [f"{p}_{c}" for c, _ in TS.CHANNELS for p in ("scale", "trend", "vol")]


@query(f"WITH {WIN}, f AS (SELECT node, step, {features_()} FROM win) SELECT node, step, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in FEATS)} FROM f")
def trend_volatility_features(spark, d):
    return rounded(TS.with_features(TS.windows(S.grid(spark, d))).select("node", "step", *FEATS), 6)


@query(f"WITH {WIN} SELECT node, step, hist[1] AS first, hist[12] AS last, round({mean_('hist[i]')}, 6) AS mean, list_min(hist) AS least, list_max(hist) AS most, round(hist[12] - hist[1], 6) + 0.0 AS change, round(list_max({each('abs(hist[i + 1] - hist[i])', 11)}), 6) AS largest_step FROM win")
def series_summary(spark, d):
    h = F.col("hist")
    return rounded(TS.windows(S.grid(spark, d)).select("node", "step", F.element_at(h, 1).alias("first"), F.element_at(h, 12).alias("last"), A.mean(h).alias("mean"), F.array_min(h).alias("least"), F.array_max(h).alias("most"), (F.element_at(h, 12) - F.element_at(h, 1)).alias("change"), F.array_max(F.transform(A.steps(h, 12), lambda x: F.abs(x))).alias("largest_step")), 6)


CHANGE = """(SELECT *, [abs(x) for x in dd] AS ad FROM (SELECT *, [hist[i + 1] - hist[i] for i in range(1, 12)] AS dd FROM win))"""


@query(f"""WITH {WIN} SELECT node, step, CAST(pos - 1 AS INT) AS place, CAST(sign(dd[pos]) AS INT) AS direction, round(ad[pos] / greatest(list_median(hist[1:pos]), 1.0), 4) AS magnitude FROM (SELECT *, list_position(ad, list_max(ad)) AS pos FROM {CHANGE})""")
def dominant_changepoint(spark, d):
    c = TS.changepoint(F.col("hist"))
    return TS.windows(S.grid(spark, d)).select("node", "step", c["index"].alias("place"), c["direction"].alias("direction"), F.round(c["magnitude"], 4).alias("magnitude"))


HOURLY = "hm AS (SELECT node, list(m ORDER BY h) AS means FROM (SELECT node, step % 24 AS h, round(avg(flow), 4) AS m FROM grid GROUP BY 1, 2) GROUP BY 1)"
NORMAL = f"{HOURLY}, wn AS (SELECT w.*, [means[1 + (w.step + i) % 24] for i in range(1, 13)] AS normal FROM win w JOIN hm USING (node))"


def with_hourly_normal(spark, d, windows: DataFrame) -> DataFrame:
    """Adds normal: the mean flow of the node at the hours of the future steps."""
    means = S.grid(spark, d).groupBy("node", (F.col("step") % 24).alias("h")).agg(F.round(F.avg("flow"), 4).alias("m"))
    lists = means.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("h", "m"))), lambda x: x["m"]).alias("means"))
    normal = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.get(F.col("means"), ((F.col("step") + i) % 24).cast("int")))
    return windows.join(lists, "node").withColumn("normal", normal).drop("means")


def shape_(e: str, ref: str) -> str:
    ph = [f"(list_sum({e}[{3 * k + 1}:{3 * k + 3}]) / 3)" for k in range(4)]
    return " || ".join(f"CASE WHEN ({b} - {a}) / greatest({mean_(f'abs({ref}[i])')}, 1.0) > 0.02 THEN 'U' WHEN ({b} - {a}) / greatest({mean_(f'abs({ref}[i])')}, 1.0) < -0.02 THEN 'D' ELSE 'F' END" for a, b in zip(ph, ph[1:], strict=False))


def dir_(e: str, ref: str) -> str:
    lim, m = f"greatest(5.0, 0.02 * {mean_(f'abs({ref}[i])')})", mean_(f"{e}[i]")
    return f"CASE WHEN {m} > {lim} THEN 'positive' WHEN {m} < -{lim} THEN 'negative' ELSE 'neutral' END"


EFFECT = f"eff AS (SELECT *, {each('fut[i] - normal[i]')} AS e FROM wn)"


@query(f"WITH {WIN}, {NORMAL}, {EFFECT} SELECT node, step, round({mean_('e[i]')}, 6) + 0.0 AS mean_effect, {dir_('e', 'normal')} AS effect_direction, {shape_('e', 'normal')} AS shape FROM eff")
def effect_shape_direction(spark, d):
    return R.effects(with_hourly_normal(spark, d, TS.windows(S.grid(spark, d)))).select("node", "step", (F.round("mean_effect", 6) + 0.0).alias("mean_effect"), "effect_direction", "shape")


@query(f"WITH {WIN}, {NORMAL}, {EFFECT} SELECT node, step, {shape_('e', 'normal')} AS shape FROM eff WHERE {dir_('e', 'normal')} <> 'neutral'")
def historical_effect(spark, d):
    return R.effects(with_hourly_normal(spark, d, TS.windows(S.grid(spark, d)))).where("effect_direction <> 'neutral'").select("node", "step", "shape")


@query(f"WITH {WIN} SELECT node, step, round(list_sum(fut), 4) AS total, fut[12] AS last, CAST(NULL AS DOUBLE) AS mean_effect, CAST(NULL AS VARCHAR) AS shape FROM win")
def continuation_only(spark, d):
    """Windows without a reference: what came after, and no effect."""
    out = R.future_only(TS.windows(S.grid(spark, d)))
    return out.select("node", "step", F.round(A.total(F.col("continuation")), 4).alias("total"), F.element_at("continuation", -1).alias("last"), "mean_effect", "shape")


@query(f"""WITH {WIN}, o AS (SELECT node, step, row_number() OVER (PARTITION BY node ORDER BY step) AS pos, count(*) OVER (PARTITION BY node) AS n FROM win),
 s AS (SELECT node, CASE WHEN pos <= round_even(n * 0.7, 0) THEN 'train' WHEN pos <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split, step FROM o)
 SELECT node, split, count(*) AS n, min(step) AS lo, max(step) AS hi FROM s GROUP BY 1, 2""")
def chronological_split(spark, d):
    parts = TS.chronological_split(TS.windows(S.grid(spark, d)).select("node", "step"), "step", group=["node"])
    return parts.groupBy("node", "split").agg(F.count("*").alias("n"), F.min("step").alias("lo"), F.max("step").alias("hi"))


# space and graph ---------------------------------------------------------------------------------------------------
def _site_pairs(spark, d):
    measured = lambda p: spatial.once(spatial.with_geometry(p), km_4=F.round("km", 4), bearing_3=F.round("bearing", 3))
    place = ("lat", "lng")
    return spatial.near_pairs(S.sites(spark, d).select("site", *place), S.sensors(spark, d).select("sensor", *place), PAIR_KM, measured)


@query(f"WITH {SIT}, {SEN} SELECT a.site, b.sensor, round({HAV}, 4) AS km FROM sit a CROSS JOIN sen b WHERE round({HAV}, 6) <= 10")
def haversine_pairs(spark, d):
    return _site_pairs(spark, d).select(F.col("a_site").alias("site"), F.col("b_sensor").alias("sensor"), F.col("km_4").alias("km"))


@query(f"WITH {SIT}, {SEN} SELECT a.site, b.sensor, round({BEAR}, 3) AS bearing FROM sit a CROSS JOIN sen b WHERE (a.lat <> b.lat OR a.lng <> b.lng) AND round({HAV}, 6) <= 10")
def bearing_pairs(spark, d):
    return _site_pairs(spark, d).where("a_lat <> b_lat or a_lng <> b_lng").select(F.col("a_site").alias("site"), F.col("b_sensor").alias("sensor"), F.col("bearing_3").alias("bearing"))


NEAR = "SELECT site, arg_min(sensor, (round(d2, 10), sensor)) AS sensor FROM (SELECT a.site, b.sensor, pow(a.lat - b.lat, 2) + pow(a.lng - b.lng, 2) AS d2 FROM sit a {}) GROUP BY 1"


@query(f"WITH {SIT}, {SEN} " + NEAR.format("CROSS JOIN sen b"))
def nearest_sensor(spark, d):
    return spatial.nearest(S.sites(spark, d), S.sensors(spark, d))


@query(f"WITH {SIT}, {SEN}, m AS (" + NEAR.format("JOIN sen b ON a.road = b.road AND a.direction = b.direction") + ") SELECT site, m.sensor FROM sit LEFT JOIN m USING (site)")
def nearest_same_road_sensor(spark, d):
    return spatial.nearest(S.sites(spark, d), S.sensors(spark, d), ["road", "direction"])


@query(f"""WITH {SEN} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sensor ORDER BY km, neighbour) AS INT) AS rank FROM (SELECT a.sensor, b.sensor AS neighbour, round({HAV}, 6) AS km FROM sen a JOIN sen b ON a.sensor <> b.sensor) WHERE km <= 5) WHERE rank <= 8""")
def radius_neighbors(spark, d):
    return spatial.within(S.sensors(spark, d), 5.0, 8)


@query(f"""WITH {SEN}, p AS (SELECT a.sensor AS target, b.sensor AS node, {HAV} AS km FROM sen a JOIN sen b ON a.sensor <> b.sensor AND a.road = b.road), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY km, node) AS place FROM p WHERE km > 0 AND round(km, 6) <= 30)
 SELECT target, node, CASE WHEN km <= 10 THEN 1 WHEN km <= 20 THEN 2 ELSE 3 END AS layer, round(km, 6) AS km FROM k WHERE place < 6 UNION ALL SELECT sensor, sensor, 0, 0.0 FROM sen""")
def distance_layers(spark, d):
    return spatial.distance_layers(S.sensors(spark, d), ((0.0, 10.0), (10.0, 20.0), (20.0, 30.0)), 6).select("target", "node", "layer", F.round("km", 6).alias("km"))


@query(f"WITH {EDG} SELECT src, dst, round(weight, 6) AS weight FROM edg WHERE weight > 0.5")
def one_hop_edges(spark, d):
    return spatial.one_hop(S.edges(spark, d)).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"WITH {EDG} SELECT src AS target, dst AS node, CASE WHEN src = dst THEN 0 WHEN weight > 0.5 AND weight <= 1 THEN 1 ELSE 2 END AS layer FROM edg WHERE src = dst OR weight > 0.2")
def edge_weight_layers(spark, d):
    return spatial.edge_layers(S.edges(spark, d), ((0.5, 1.0), (0.2, 0.5)))


@query(f"""WITH {EDG}, nodes AS (SELECT src AS n FROM edg UNION SELECT dst FROM edg), f AS (SELECT src, dst, sum(weight) AS w FROM (SELECT * FROM edg UNION ALL SELECT n, n, 1.0 FROM nodes) GROUP BY 1, 2)
 SELECT src, dst, round(w / greatest(sum(w) OVER (PARTITION BY src), 1e-6), 6) AS weight FROM f""")
def row_normalized_adjacency(spark, d):
    return spatial.row_normalised(S.edges(spark, d)).select("src", "dst", F.round("weight", 6).alias("weight"))


def _bfs_sql(hops: int) -> str:
    sql = f"""WITH {EDG}, g AS (SELECT * FROM edg WHERE src <> dst AND round(weight, 9) > (SELECT round(quantile_cont(weight, 0.9), 9) FROM edg)),
 d0 AS (SELECT DISTINCT src AS source, src AS node, 0 AS hops, [src] AS path FROM edg)"""
    for k in range(1, hops + 1):
        sql += f", d{k} AS (SELECT * FROM d{k - 1} UNION ALL SELECT source, dst, {k}, min(list_append(path, dst)) FROM d{k - 1} p JOIN g ON node = src WHERE hops = {k - 1} AND NOT EXISTS (SELECT 1 FROM d{k - 1} x WHERE x.source = p.source AND x.node = dst) GROUP BY source, dst)"
    return sql + f" SELECT source, node, hops, array_to_string(path, '>') AS path FROM d{hops}"


@query(_bfs_sql(6))
def bfs_shortest_path(spark, d):
    """From every node along the heaviest tenth of all edges."""
    edges = written(S.edges(spark, d), "edges")
    least = edges.agg(F.round(F.percentile("weight", F.lit(0.9)), 9).alias("least"))  # one row
    heavy = edges.where("src <> dst").crossJoin(F.broadcast(least)).where(F.round("weight", 9) > F.col("least"))
    found = spatial.shortest_paths(heavy, edges.select(F.col("src").alias("source")), 6)
    return found.select("source", "node", "hops", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"""WITH {EDG}, dist AS (SELECT src, dst, round((1 - weight) * 1000, 3) AS m FROM edg WHERE weight < 1)
 SELECT a.src AS anchor, a.dst AS prev, t.dst AS target, a.m AS m_ap, t.m AS m_at FROM dist a JOIN dist p ON a.dst = p.src JOIN dist t ON t.src = a.src AND t.dst = p.dst WHERE a.m < t.m AND a.src <> a.dst AND a.dst <> t.dst AND a.src <> t.dst""")
def directed_predecessor(spark, d):
    dist = S.edges(spark, d).where("weight < 1").select("src", "dst", F.round((1 - F.col("weight")) * 1000, 3).alias("m"))
    return spatial.predecessors(dist).select("anchor", "prev", "target", "m_ap", "m_at")


def _routed(spark, d):
    """Routes of each site to sensors at any distance, from the sensors by the remainder that the route generator leaves out: 11 rows."""
    by = S.sensors(spark, d).groupBy(F.pmod("sensor", F.lit(11)).alias("r")).agg(F.count("*").alias("n"))
    out = S.sites(spark, d).select("site", F.pmod(-F.col("site"), F.lit(11)).alias("r")).join(F.broadcast(by), "r", "left")
    return out.select("site", (F.lit(by.agg(F.sum("n")).scalar()) - F.coalesce("n", F.lit(0))).alias("routed"))


@query(f"""WITH {ROUTES} SELECT site, sensor, layer, distance_m, same_road, same_direction, CAST(row_number() OVER (PARTITION BY site, layer ORDER BY distance_m, sensor) AS INT) AS place, arg_min(sensor, (distance_m, sensor)) OVER (PARTITION BY site) AS anchor FROM scoped WHERE layer IS NOT NULL""")
def impact_scope_bands(spark, d):
    return spatial.scoped_routes(S.sites(spark, d), S.sensors(spark, d), ROUTE_KM, BANDS_KM).select("site", "sensor", "layer", "distance_m", "same_road", "same_direction", "place", "anchor")


ELIG = f"""WITH {ROUTES}, far AS (SELECT site, count(*) FILTER ((site + sensor) % 11 <> 0) AS routed FROM sit CROSS JOIN sen GROUP BY 1), per AS (SELECT site, count(layer) AS nodes, arg_min(sensor, (distance_m, sensor)) FILTER (layer IS NOT NULL) AS anchor, min(distance_m) FILTER (layer IS NOT NULL) AS anchor_m FROM scoped GROUP BY 1),
 el AS (SELECT s.site, coalesce(nodes, 0) AS nodes, anchor, anchor_m, CASE WHEN routed = 0 THEN 'missing_osrm_route_cache' WHEN coalesce(nodes, 0) = 0 THEN 'no_osrm_route_in_distance_bands' ELSE '' END AS skip_reason FROM sit s JOIN far USING (site) LEFT JOIN per USING (site))"""


def _eligible(spark, d):
    sites = S.sites(spark, d)
    per = spatial.route_summary(sites, S.sensors(spark, d), ROUTE_KM, BANDS_KM)
    return spatial.skip_reasons(sites, _routed(spark, d).join(per, "site", "left"))


@query(ELIG + " SELECT site, nodes, anchor, anchor_m, skip_reason FROM el")
def eligibility_rows(spark, d):
    return _eligible(spark, d).select("site", "nodes", "anchor", "anchor_m", "skip_reason")


@query(ELIG + " SELECT skip_reason, count(*) AS n FROM el GROUP BY 1")
def eligibility_summary(spark, d):
    return _eligible(spark, d).groupBy("skip_reason").agg(F.count("*").alias("n"))


@query(f"""WITH {ROUTES}, up AS (SELECT sensor, sensor % 7 + 1 AS prev FROM sen), sc AS (SELECT site, sensor, layer, distance_m AS base FROM scoped WHERE layer IS NOT NULL),
 l0 AS (SELECT site, sensor, layer, base AS prediction FROM sc WHERE layer = 0),
 l1 AS (SELECT s.site, s.sensor, s.layer, coalesce((base + up) / 2, base) AS prediction FROM sc s LEFT JOIN (SELECT l0.site, up.sensor, avg(prediction) AS up FROM up JOIN l0 ON up.prev = l0.sensor GROUP BY 1, 2) e USING (site, sensor) WHERE layer = 1),
 l2 AS (SELECT s.site, s.sensor, s.layer, coalesce((base + up) / 2, base) AS prediction FROM sc s LEFT JOIN (SELECT l1.site, up.sensor, avg(prediction) AS up FROM up JOIN l1 ON up.prev = l1.sensor GROUP BY 1, 2) e USING (site, sensor) WHERE layer = 2)
 SELECT site, sensor, layer, round(prediction, 7) AS prediction FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)""")
def layered_propagation(spark, d):
    place = ("lat", "lng")
    sites, sensors = S.sites(spark, d).select("site", *place), S.sensors(spark, d).select("sensor", *place)
    upstream = sensors.select("sensor", (F.col("sensor") % 7 + 1).alias("prev"))
    return records.layers_over_routes(sites, sensors, upstream, ROUTE_KM, BANDS_KM, 7)


# text, vectors, histories --------------------------------------------------------------------------------------------
TOK = """b AS (SELECT item_id AS id, regexp_replace(trim(lower(text)), '\\s+', ' ', 'g') AS v FROM benchmark), w AS (SELECT id, v, regexp_extract_all(v, '[\\p{L}\\p{M}\\p{N}]+') AS ws FROM b),
 j AS (SELECT *, array_to_string(ws, '') AS s FROM w), tk AS (SELECT id, list_sort(list_distinct(list_filter(list_concat([v], ws, [s[i:i + 2] for i in range(1, greatest(len(s) - 1, 1))], [s[i:i + 3] for i in range(1, greatest(len(s) - 2, 1))]), lambda t: t <> ''))) AS tokens FROM j)"""


def _tokens(spark, d):
    return S.read(spark, d, "benchmark").select(F.col("item_id").alias("id"), V.token_set(F.col("text")).alias("tokens"))


@query(f"WITH {TOK} SELECT id, CAST(len(tokens) AS INT) AS n, md5(array_to_string(tokens, '|')) AS digest FROM tk")
def token_ngram_sets(spark, d):
    return _tokens(spark, d).select("id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", "|").cast("binary")).alias("digest"))


@query(f"""WITH {TOK}, x AS (SELECT id, len(tokens) AS n, unnest(tokens) AS t FROM tk), p AS (SELECT a.id AS a_id, b.id AS b_id, round(count(*) / sqrt(a.n::DOUBLE * b.n), 4) AS score FROM x a JOIN x b USING (t) WHERE a.id <> b.id GROUP BY a.id, b.id, a.n, b.n)
 SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS INT) AS rank FROM p) WHERE rank <= 3""")
def token_cosine_recall(spark, d):
    return token_index.token_topk(_tokens(spark, d), 3)


@query(f"""WITH {TOK}, x AS (SELECT id, CAST('0x' || substr(md5(unnest(tokens)), 1, 8) AS BIGINT) % 256 AS bucket FROM tk), c AS (SELECT id, bucket, count(*)::DOUBLE AS n FROM x GROUP BY 1, 2), u AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS x FROM c),
 p AS (SELECT a.id AS a_id, b.id AS b_id, round(sum(a.x * b.x), 4) AS score FROM u a JOIN u b USING (bucket) WHERE a.id <> b.id GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS INT) AS rank FROM p) WHERE rank <= 3""")
def hashed_text_vector_recall(spark, d):
    dim = V.FIELD_DIMS["description"]
    v = V.dense(V.hashed_block(_tokens(spark, d), dim), dim)
    found = vector_index.search(vector_index.build_index(v), v, 3).where("score > 0")
    return found.select(F.col("query_id").alias("a_id"), F.col("item_id").alias("b_id"), "score", "rank")


def _vectors(spark, d):
    return S.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def cos_sql(a: str, b: str) -> str:
    return f"least(greatest(list_cosine_similarity({a}, {b}), 0.0), 1.0)"


TOP_VECTORS = f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.id AS query_id, i.id AS item_id, round({cos_sql('q.v', 'i.v')}, 4) AS score FROM v q JOIN v i ON q.id <> i.id WHERE q.id % 100 = 0)
 SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM p) WHERE rank <= 10"""


@query(TOP_VECTORS)
def vector_cosine_topk(spark, d):
    v = _vectors(spark, d)
    return V.cosine_recall(v.where("id % 100 = 0"), v, 10)


@query(TOP_VECTORS)
def vector_index_topk(spark, d):
    """The same through the index."""
    v = _vectors(spark, d)
    return vector_index.search(vector_index.build_index(v), v.where("id % 100 = 0"), 10)


HALVES = "v AS (SELECT vec_id AS id, (embedding::DOUBLE[])[1:32] AS h1, (embedding::DOUBLE[])[33:64] AS h2 FROM embeddings)"


def _recall_sql(h: str) -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM (SELECT q.id AS query_id, i.id AS item_id, round({cos_sql(f'q.{h}', f'i.{h}')}, 4) AS score FROM v q JOIN v i ON q.id <> i.id WHERE q.id % 100 = 0)) WHERE rank <= 50"


@query(f"WITH {HALVES}, a AS ({_recall_sql('h1')}), b AS ({_recall_sql('h2')}) SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.item_id, b.item_id) AS item_id, a.score AS metadata_score, a.rank AS metadata_rank, b.score AS history_score, b.rank AS history_rank FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.item_id = b.item_id")
def dual_recall_merge(spark, d):
    v = _vectors(spark, d)
    half = lambda at: v.select("id", F.slice("v", at, 32).alias("v"))
    recall = lambda h: V.cosine_recall(h.where("id % 100 = 0"), h, 50)
    return R.merge_recalls(recall(half(1)), recall(half(33)), ["query_id", "item_id"], ("metadata", "history"))


def groups_sql(pool: str, by: str, least: float, history: float, score: str) -> str:
    """CTEs gp (groups and place) from a pool (by, id, network_time, history, state, ...)."""
    return f"""r AS (SELECT *, CASE WHEN network_time >= {least} THEN row_number() OVER (PARTITION BY {by}, network_time >= {least} ORDER BY network_time DESC, id) END AS rn, CASE WHEN history >= {history} THEN row_number() OVER (PARTITION BY {by}, history >= {history} ORDER BY history DESC, id) END AS rh, CASE WHEN state IS NOT NULL THEN row_number() OVER (PARTITION BY {by}, state IS NOT NULL ORDER BY state, id) END AS rs FROM {pool}),
 g AS (SELECT *, (CASE WHEN rn <= 3 THEN 1 ELSE 0 END) + (CASE WHEN rh <= 3 THEN 1 ELSE 0 END) AS legacy FROM r WHERE rn <= 3 OR rh <= 3 OR rs <= 3),
 gp AS (SELECT *, array_to_string(list_filter([CASE WHEN rn <= 3 THEN 'network_time' END, CASE WHEN rh <= 3 THEN 'history' END, CASE WHEN rs <= 3 THEN 'state' END], lambda x: x IS NOT NULL), ',') AS groups, CAST(row_number() OVER (PARTITION BY {by} ORDER BY legacy DESC, CASE WHEN legacy > 0 THEN -{score} ELSE rs END, id) AS INT) AS place FROM g)"""


@query(f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.id AS query_id, i.id AS id, round({cos_sql('q.e[1:32]', 'i.e[1:32]')}, 4) AS network_time, round({cos_sql('q.e[33:64]', 'i.e[33:64]')}, 4) AS history, round(sqrt(list_sum([(q.e[k] - i.e[k]) * (q.e[k] - i.e[k]) for k in range(1, 13)]) / 12), 4) AS state FROM v q JOIN v i ON q.id <> i.id WHERE q.id % 100 = 0),
 {groups_sql('p', 'query_id', 0.2, 0.75, 'greatest(network_time, history)')} SELECT query_id, id, groups, place FROM gp""")
def evidence_group_selection(spark, d):
    v = _vectors(spark, d)
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    cos = lambda at: F.round(A.cosine(F.slice("q", at, 32), F.slice("v", at, 32)), 4)
    part = lambda at, n: v.select("id", F.slice("v", at, n).alias("v"))
    best = lambda x, scores: blocks.candidates(x.where("id % 100 = 0"), x, 3, 4, scores)  # noqa: E731  three of each group can come to a place
    found = best(part(1, 32), "cosine").union(best(part(33, 32), "cosine")).union(best(part(1, 12), "distance")).distinct().withColumnRenamed("item_id", "id")
    p = found.join(q, "query_id").join(v, "id").select("query_id", "id", cos(1).alias("network_time"), cos(33).alias("history"), F.round(A.rmse(F.slice("q", 1, 12), F.slice("v", 1, 12)), 4).alias("state"))
    return R.evidence_groups(p, ["query_id"], least=0.2).select("query_id", "id", F.array_join("groups", ",").alias("groups"), "place")


@query(f"WITH {WIN}, z AS (SELECT node, step, {robust_('hist')} AS z FROM win) SELECT node, step, round(z[1], 6) + 0.0 AS first, round(z[12], 6) + 0.0 AS last, round(list_sum(z), 6) + 0.0 AS total, round(list_min(z), 6) + 0.0 AS least, round(list_max(z), 6) + 0.0 AS most FROM z")
def robust_normalize(spark, d):
    z = TS.windows(S.grid(spark, d)).select("node", "step", A.robust_normalise(F.col("hist")).alias("z"))
    return rounded(z.select("node", "step", F.element_at("z", 1).alias("first"), F.element_at("z", 12).alias("last"), A.total(F.col("z")).alias("total"), F.array_min("z").alias("least"), F.array_max("z").alias("most")), 6)


def _day_pairs(spark, d):
    """Each window (a) with the one a day later (b) of the same node."""
    w = TS.windows(S.grid(spark, d))
    return w.select("node", "step", F.col("hist").alias("a"), F.col("fut").alias("fa")).join(w.select("node", (F.col("step") - 24).alias("step"), F.col("hist").alias("b"), F.col("fut").alias("fb")), ["node", "step"])


PAIR = "dp AS (SELECT x.node, x.step, x.hist AS a, x.fut AS fa, y.hist AS b, y.fut AS fb FROM win x JOIN win y ON x.node = y.node AND y.step = x.step + 24)"


def _change_cols(x: str) -> str:
    return f"[{x}[i + 1] - {x}[i] for i in range(1, 12)] AS d{x}"


HIST_PARTS = f"""z AS (SELECT *, {robust_('a')} AS za, {robust_('b')} AS zb, {_change_cols('a')}, {_change_cols('b')} FROM dp),
 lo AS (SELECT *, [(za[2 * i - 1] + za[2 * i]) / 2 for i in range(1, 7)] AS la, [(zb[2 * i - 1] + zb[2 * i]) / 2 for i in range(1, 7)] AS lb, list_position([abs(v) for v in da], list_max([abs(v) for v in da])) AS pa, list_position([abs(v) for v in db], list_max([abs(v) for v in db])) AS pb FROM z),
 h AS (SELECT *, list_concat([(za[2 * i - 1] - za[2 * i]) / 2 for i in range(1, 7)], [(la[2 * i - 1] - la[2 * i]) / 2 for i in range(1, 4)], [(la[2 * i - 1] + la[2 * i]) / 2 for i in range(1, 4)]) AS ha,
  list_concat([(zb[2 * i - 1] - zb[2 * i]) / 2 for i in range(1, 7)], [(lb[2 * i - 1] - lb[2 * i]) / 2 for i in range(1, 4)], [(lb[2 * i - 1] + lb[2 * i]) / 2 for i in range(1, 4)]) AS hb,
  abs(da[pa]) / greatest(list_median(a[1:pa]), 1.0) AS ma, abs(db[pb]) / greatest(list_median(b[1:pb]), 1.0) AS mb FROM lo),
 hs AS (SELECT *, CASE WHEN list_sum([x * x for x in ha]) = 0 AND list_sum([x * x for x in hb]) = 0 THEN 1.0 WHEN list_sum([x * x for x in ha]) = 0 OR list_sum([x * x for x in hb]) = 0 THEN 0.0 ELSE {cos_sql('ha', 'hb')} END AS wavelet,
  exp(-2 * abs({median_('a')} - {median_('b')}) / greatest(abs({median_('a')}), abs({median_('b')}), 1.0)) AS level,
  exp(-2 * sqrt(list_sum([(a[i] - b[i]) * (a[i] - b[i]) for i in range(10, 13)]) / 3) / greatest(list_sum([abs(a[i]) for i in range(10, 13)]) / 3, list_sum([abs(b[i]) for i in range(10, 13)]) / 3, 1.0)) AS recent,
  CASE WHEN ma < 0.2 AND mb < 0.2 THEN 1.0 WHEN ma < 0.2 OR mb < 0.2 OR sign(da[pa]) <> sign(db[pb]) THEN 0.0 ELSE exp(-abs(pa - pb) / 2.0) * exp(-abs(ln(1 + ma) - ln(1 + mb))) END AS changepoint FROM h)"""
HIST_SIM = f"""WITH {WIN}, {PAIR}, {HIST_PARTS} SELECT node, step, round(wavelet, 4) AS wavelet, round(level, 4) AS level, round(recent, 4) AS recent, round(changepoint, 4) AS changepoint, round(0.45 * wavelet + 0.20 * level + 0.20 * recent + 0.15 * changepoint, 3) AS score FROM hs"""


@query(HIST_SIM)
def history_similarity_components(spark, d):
    a, b = F.col("a"), F.col("b")
    p = _day_pairs(spark, d).withColumn("ha", V.haar(a)).withColumn("hb", V.haar(b))
    parts = {"wavelet": A.cosine(F.col("ha"), F.col("hb")), "level": V.level_similarity(a, b), "recent": V.recent_similarity(a, b), "changepoint": V.changepoint_similarity(a, b)}
    p = p.select("node", "step", *[c.alias(k) for k, c in parts.items()])
    return p.select("node", "step", *[F.round(k, 4).alias(k) for k in parts], F.round(V.history_similarity({k: F.col(k) for k in parts}), 3).alias("score"))


@query()
def scattering_embedding_udf(spark, d):
    return TS.windows(S.grid(spark, d)).select("node", "step", V.scattering("hist").alias("v")).withColumn("v", V.unit(F.col("v")))


@query()
def attribute_text_similarity(spark, d):
    b = S.read(spark, d, "benchmark")
    p = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return p.select("item_id", F.round(V.gestalt("text", "other"), 4).alias("ratio"))


#: DuckDB's distance counts bytes, so its SQL first gives each letter beyond ASCII one byte, a control character, of its own.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
ONE_BYTE = f"translate({{}}.text, '{LETTERS}', {' || '.join(f'chr({i})' for i in [*range(1, 9), 11, 12, *range(14, 25)])})"


@query(f"SELECT a.item_id, CAST(levenshtein({ONE_BYTE.format('a')}, {ONE_BYTE.format('b')}) AS INT) AS distance FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def attribute_edit_distance(spark, d):
    b = S.read(spark, d, "benchmark")
    p = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return p.select("item_id", F.levenshtein("text", "other").alias("distance"))


PER = "CASE WHEN {0} % 24 < 6 OR {0} % 24 >= 20 THEN 'night' WHEN {0} % 24 < 10 THEN 'morning_peak' WHEN {0} % 24 < 16 THEN 'midday' ELSE 'evening_peak' END"


def _asked(spark, d):
    """q_site, sensor (its anchor, with lat and lng), q_km, q_duration_s and q_bearing_deg of the sites whose id is divisible by 100."""
    asked, sensors = S.sites(spark, d).where("site % 100 = 0"), S.sensors(spark, d).select("sensor", "lat", "lng")
    anchors = spatial.route_summary(asked, sensors, ROUTE_KM, BANDS_KM).select("site", F.col("anchor").alias("sensor"))
    return written(spatial.routes_of(anchors, asked, sensors).select(F.col("site").alias("q_site"), "sensor", "lat", "lng", (F.col("distance_m") / 1000).alias("q_km"), F.col("duration_s").alias("q_duration_s"), F.col("bearing_deg").alias("q_bearing_deg")), "asked")


@query(f"""WITH {ROUTES}, an AS (SELECT site, arg_min(sensor, (distance_m, sensor)) AS sensor FROM scoped WHERE layer IS NOT NULL AND site % 100 = 0 GROUP BY 1),
 p AS (SELECT q.site AS query_site, c.site, q.sensor, coalesce((exp(-abs(q.distance_m - c.distance_m) / 1000 / greatest(abs(q.distance_m) / 1000, abs(c.distance_m) / 1000, 0.5)) + exp(-abs(q.duration_s - c.duration_s) / greatest(abs(q.duration_s), abs(c.duration_s), 60.0)) + (cos((q.bearing_deg - c.bearing_deg) * (2 * 3.141592653589793 / 360)) + 1) / 2) / 3, 0.0) AS net,
 ((CASE WHEN q.site % 2 = c.site % 2 THEN 1.0 ELSE 0.0 END) + (CASE WHEN {PER.format('q.site')} = {PER.format('c.site')} THEN 1.0 ELSE 0.0 END) + (cos((q.site % 24 - c.site % 24) * (2 * 3.141592653589793 / 24)) + 1) / 2) / 3 AS tm,
 ((CASE WHEN x.road = y.road THEN 1.0 ELSE 0.0 END) + (CASE WHEN x.direction = y.direction THEN 1.0 ELSE 0.0 END)) / 2 AS inc
 FROM an JOIN rt q ON q.site = an.site AND q.sensor = an.sensor JOIN rt c ON q.sensor = c.sensor AND q.site <> c.site JOIN sit x ON x.site = q.site JOIN sit y ON y.site = c.site)
 SELECT query_site, site, sensor, round(net, 4) AS network, round(tm, 4) AS time, round(0.55 * net + 0.25 * tm + 0.20 * inc, 4) AS score, round((0.2 * tm + net + 0.5 * inc) / 2.7, 4) AS combined FROM p""")
def network_time_score(spark, d):
    """Of sites whose id is divisible by 100, the scores of all others that have a route to the query's anchor; histories are scored in incident_pattern_retrieval."""
    sites = S.sites(spark, d)
    q = _asked(spark, d).join(sites.select(F.col("site").alias("q_site"), F.col("road").alias("q_road"), F.col("direction").alias("q_direction")), "q_site")

    def networks(p: DataFrame) -> DataFrame:
        both = lambda q, c: (F.col(f"b_q_{q}"), c)
        n = V.network_similarity(both("km", F.col("distance_m") / 1000), both("duration_s", F.col("duration_s")), both("bearing_deg", F.col("bearing_deg")))
        p = spatial.once(p, routed_n=n)
        return spatial.once(p, routed_network=F.round("routed_n", 4))

    hour = lambda c: F.col(c) % 24
    when = lambda df, own, p: df.withColumns({f"{p}_two": F.col(own) % 2, f"{p}_hour": hour(own), f"{p}_period": period(hour(own))})
    p = spatial.route_table(when(sites.withColumnsRenamed({"road": "c_road", "direction": "c_direction"}), "site", "c"), when(q, "q_site", "q"), ROUTE_KM, networks).where("q_site <> site")
    both = lambda c: (F.col(f"q_{c}"), F.col(f"c_{c}"))
    net = lambda c: F.when(F.col("distance_m").isNotNull(), F.col(c)).otherwise(0.0)
    p = p.withColumns({"n": net("routed_n"), "network": net("routed_network"), "t": V.incident_time_similarity(both("two"), both("period"), both("hour")), "i": V.equal_share([both("road"), both("direction")])})
    combined = V.retrieval_score({"time": F.col("t"), "network": F.col("n"), "history": F.lit(0.0), "incident": F.col("i")})
    p = p.withColumns({"score": V.network_time(F.col("n"), F.col("t"), F.col("i")), "combined": combined})
    return p.select(F.col("q_site").alias("query_site"), "site", "sensor", "network", *[near_round(F.col(c), 4).alias(n) for c, n in (("t", "time"), ("score", "score"), ("combined", "combined"))])


@query(f"""WITH {ROUTES}, an AS (SELECT site, arg_min(sensor, (distance_m, sensor)) AS sensor FROM scoped WHERE layer IS NOT NULL AND site % 100 = 0 GROUP BY 1)
 SELECT an.site AS query_site, c.site, an.sensor, round(q.distance_m / 1000, 4) AS query_km, round(c.distance_m / 1000, 4) AS km, round(c.duration_s, 4) AS seconds, c.distance_m IS NULL AS no_route FROM an JOIN rt q ON q.site = an.site AND q.sensor = an.sensor JOIN rt c ON c.sensor = an.sensor AND c.site <> an.site""")
def route_relations(spark, d):
    """Routes of the sites whose id is divisible by 100 to their anchors, beside those of all other sites to the same sensors."""
    near = lambda p: spatial.once(p, routed_km=F.round(F.col("distance_m") / 1000, 4), routed_seconds=F.round("duration_s", 4))
    p = spatial.route_table(S.sites(spark, d).select("site", "lat", "lng"), _asked(spark, d).withColumn("query_km", F.round("q_km", 4)), ROUTE_KM, near).where("q_site <> site")
    none = F.col("distance_m").isNull()
    return p.select(F.col("q_site").alias("query_site"), "site", "sensor", "query_km", F.when(~none, F.col("routed_km")).alias("km"), F.when(~none, F.col("routed_seconds")).alias("seconds"), none.alias("no_route"))


# the incident-free reference ---------------------------------------------------------------------------------------
def _local(spark, d):
    return N.local_incidents(S.incidents(spark, d), S.incident_routes(spark, d))


@query(f"WITH {INC} SELECT incident_id, node, round(km, 4) AS km FROM loc")
def local_incident_filter(spark, d):
    return _local(spark, d).select("incident_id", "node", F.round("km", 4).alias("km"))


@query(f"WITH {WIN}, {INC}, {EXC}, {FREE} SELECT node, step FROM free")
def interval_anti_join(spark, d):
    return N.incident_free(TS.windows(S.grid(spark, d)), _local(spark, d)).select("node", "step")


@query(f"WITH {WIN}, {INC}, {EXC}, {FREE} SELECT node, step FROM free")
def interval_anti_join_sweep(spark, d):
    w = TS.windows(S.grid(spark, d)).select("node", "step", (F.col("step") * 3600).alias("sec"))
    return N.interval_anti_join_sweep(w, "sec", N.exclusions(_local(spark, d)).select("node", "lo", "hi"), "node").select("node", "step")


SCORE = f"""{WIN}, {INC}, {EXC}, {FREE}, feat AS (SELECT *, {features_()}, {calendar_("(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * step)")} FROM win),
 q AS (SELECT loc.incident_id, feat.* FROM loc JOIN feat ON loc.step = feat.step AND loc.node = feat.node),
 c AS (SELECT feat.* FROM feat SEMI JOIN free ON feat.node = free.node AND feat.step = free.step),
 sc0 AS (SELECT q.incident_id, q.node, q.step AS query_step, c.step, c.day, c.fut,
  round(({' + '.join(f"exp(-{rmse_(f'q.{x}', f'c.{x}')} / q.scale_{x})" for x, _ in TS.CHANNELS)} + exp(-({' + '.join(f'abs(q.trend_{x} - c.trend_{x})' for x, _ in TS.CHANNELS)}) / 3) + exp(-({' + '.join(f'abs(q.vol_{x} - c.vol_{x})' for x, _ in TS.CHANNELS)}) / 3)) / 5, 6) AS traffic_score,
  round(((CASE WHEN (q.weekend OR q.holiday) = (c.weekend OR c.holiday) THEN 1.0 ELSE 0.0 END) + (CASE WHEN q.weekday = c.weekday THEN 1.0 ELSE 0.0 END) + (CASE WHEN q.period = c.period THEN 1.0 ELSE 0.0 END) + (cos((q.hour - c.hour) * (2 * 3.141592653589793 / 24)) + 1) / 2 + (cos((month(q.day) - month(c.day)) * (2 * 3.141592653589793 / 12)) + 1) / 2) / 5, 6) AS time_score
  FROM q JOIN c ON q.node = c.node AND c.step <= q.step - 1),
 sc AS (SELECT *, round(traffic_score * 0.75 + time_score * 0.25, 8) AS score FROM sc0)"""
SEL = f"""{SCORE}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, node, day ORDER BY score DESC, step) AS dr FROM sc WHERE score >= 0.6) WHERE dr = 1),
 sel AS (SELECT *, score / sum(score) OVER (PARTITION BY incident_id, node) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, node ORDER BY score DESC, step) AS rank FROM best) WHERE rank <= 10)"""


def _features(spark, d):
    """The windows and their features, once as a table: a query reads them up to six times."""
    return written(TS.with_features(TS.windows(S.grid(spark, d))), "features")


def _scores(spark, d):
    feat, local = _features(spark, d), _local(spark, d)
    return N.candidate_scores(feat.join(local.select("incident_id", "node", "step"), ["node", "step"]), N.incident_free(feat, local))


def _selected(spark, d, feat=None):
    return N.normal_counterfactual(feat if feat is not None else _features(spark, d), S.incidents(spark, d), S.incident_routes(spark, d))


def kept_references(spark, d, registry: Registry) -> DataFrame:
    """References of all local incidents from kept tables: features of the grid's windows, then selections and references of them. What a later run finds it doesn't build."""
    grid, incidents, routes = S.grid(spark, d), S.incidents(spark, d), S.incident_routes(spark, d)
    feat, feat_key = registry.table("features", {"grid": grid}, lambda: TS.with_features(TS.windows(grid)))
    chosen, key = registry.table("selections", {"features": feat_key, "incidents": incidents, "routes": routes}, lambda: N.normal_counterfactual(feat, incidents, routes), {"k": N.K, "least": N.LEAST_SCORE, "radius_km": N.LOCAL_KM})
    return registry.table("references", {"selections": key}, lambda: N.reference(chosen))[0]


@query(f"WITH {SCORE} SELECT incident_id, node, query_step, step, traffic_score, time_score, score FROM sc")
def normal_candidate_scores(spark, d):
    return _scores(spark, d).drop("day")


TIMED = """SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY incident_id, node ORDER BY tq DESC, step) AS place FROM (SELECT q.incident_id, q.node, q.step AS query_step, c.step,
  ((CASE WHEN (q.weekend OR q.holiday) = (c.weekend OR c.holiday) THEN 1.0 ELSE 0.0 END) + (CASE WHEN q.weekday = c.weekday THEN 1.0 ELSE 0.0 END) + (CASE WHEN q.period = c.period THEN 1.0 ELSE 0.0 END) + (cos((q.hour - c.hour) * (2 * 3.141592653589793 / 24)) + 1) / 2 + (cos((month(q.day) - month(c.day)) * (2 * 3.141592653589793 / 12)) + 1) / 2) / 5 AS tq,
  q.weekday = c.weekday OR q.period = c.period OR (q.weekend OR q.holiday) = (c.weekend OR c.holiday) OR least(abs(q.hour - c.hour), 24 - abs(q.hour - c.hour)) <= 3 OR month(q.day) = month(c.day) AS broad FROM q JOIN c ON q.node = c.node AND c.step <= q.step - 1) WINDOW w AS (PARTITION BY incident_id, node)"""


@query(f"WITH {SCORE}, t AS ({TIMED}), k AS (SELECT *, row_number() OVER (PARTITION BY incident_id, node ORDER BY tq DESC, step) AS again FROM t WHERE n <= 100 OR broad OR place <= 20) SELECT incident_id, node, query_step, step FROM k WHERE n <= 100 OR again <= 100")
def coarse_time_filter(spark, d):
    """The time filter with a limit of 100 candidates, of which 20 by time score in any case (in use: 16,384 and 4,096)."""
    feat, local = _features(spark, d), _local(spark, d)
    q = TS.with_calendar(feat.join(local.select("incident_id", "node", "step"), ["node", "step"]), TS.step_time(F.col("step"))).select("incident_id", "node", *[F.col(x).alias(f"q_{x}") for x in ["step", *N.CAL]])
    c = TS.with_calendar(N.incident_free(feat, local), TS.step_time(F.col("step"))).select("node", *[F.col(x).alias(f"c_{x}") for x in ["step", *N.CAL]])
    p = N.time_filter(q.join(c, "node").where("c_step <= q_step - 1"), ["incident_id", "node"], 100, 20)
    return p.select("incident_id", "node", F.col("q_step").alias("query_step"), F.col("c_step").alias("step"))


REF = f"""{SEL}, ref0 AS (SELECT *, sum(weight * y) OVER (PARTITION BY incident_id, node, horizon) AS normal FROM (SELECT incident_id, node, score, weight, h AS horizon, fut[h] AS y FROM sel, (SELECT unnest(range(1, 13)) AS h))),
 ref AS (SELECT incident_id, node, horizon, any_value(normal) AS normal, sqrt(sum(weight * (y - normal) * (y - normal))) AS spread, 1 / sum(weight * weight) AS ess, count(*) AS n, min(score) AS least_score, {ratio_('sum(CAST(round(score * 100000000) AS HUGEINT))', '(count(*) * 100000000)', 6)} AS mean_score FROM ref0 GROUP BY 1, 2, 3)"""


@query(f"WITH {REF} SELECT incident_id, node, CAST(horizon AS INT) AS horizon, round(normal, 4) AS normal, round(spread, 3) AS spread, round(ess, 4) AS ess, n, least_score, mean_score FROM ref")
def normal_counterfactual(spark, d):
    r = N.reference(_selected(spark, d))
    return r.select("incident_id", "node", "horizon", F.round("normal", 4).alias("normal"), F.round("spread", 3).alias("spread"), F.round("ess", 4).alias("ess"), "n", "least_score", "mean_score")


@query(f"WITH {REF} SELECT incident_id, node, CAST(horizon AS INT) AS horizon, round(normal, 4) AS normal, round(spread, 3) AS spread, round(ess, 4) AS ess, n, least_score, mean_score FROM ref")
def incremental_references(spark, d):
    """The same in two steps: the references of five sixths of the incidents, then an update with the rest."""
    feat, incidents, routes = _features(spark, d), S.incidents(spark, d), S.incident_routes(spark, d)
    late = F.pmod("incident_id", F.lit(6)) == 0
    before = N.normal_counterfactual(feat, incidents.where(~late), routes)
    r = N.reference(N.update_counterfactual(before, feat, incidents.where(~late), incidents.where(late), routes))
    return r.select("incident_id", "node", "horizon", F.round("normal", 4).alias("normal"), F.round("spread", 3).alias("spread"), F.round("ess", 4).alias("ess"), "n", "least_score", "mean_score")


def slope_(a: str) -> str:
    return f"(list_sum({each(f'{a}[i] * (i - 6.5)')}) / 143.0)"


@query(f"""WITH {REF}, s AS (SELECT incident_id, node, list(normal ORDER BY horizon) AS normal FROM ref GROUP BY 1, 2), r AS (SELECT s.*, q.hist FROM s JOIN q USING (incident_id, node))
 SELECT incident_id, node, round(list_sum([abs(hist[12] - normal[i]) for i in range(1, 13)]) / 12, 4) AS gap, round(hist[12], 4) AS last_flow, round({slope_('hist')}, 5) + 0.0 AS history_slope, round({slope_('normal')}, 5) + 0.0 AS normal_slope, round(list_sum([x - hist[12] for x in normal]), 3) + 0.0 AS change FROM r""")
def normal_recovery(spark, d):
    """Gap of the last-value forecast from the reference, and recovery evidence."""
    feat = _features(spark, d)
    at = feat.join(_local(spark, d).select("incident_id", "node", "step"), ["node", "step"]).select("incident_id", "node", "hist")
    r = N.sequences(N.reference(_selected(spark, d, feat))).join(at, ["incident_id", "node"])
    back = N.recovery(F.col("hist"), F.col("normal"))
    gap = N.forecast_gap(F.col("normal"), F.array_repeat(F.element_at("hist", 12), 12))
    return r.select("incident_id", "node", F.round(gap, 4).alias("gap"), F.round(back["last_flow"], 4).alias("last_flow"), (F.round(back["history_slope"], 5) + 0.0).alias("history_slope"), (F.round(back["normal_slope"], 5) + 0.0).alias("normal_slope"), (F.round(A.total(back["change"]), 3) + 0.0).alias("change"))


QUANT = """SELECT incident_id, node, horizon, {} FROM (SELECT *, round(sum(weight) OVER (PARTITION BY incident_id, node, horizon ORDER BY v, step ROWS UNBOUNDED PRECEDING), 9) AS run, sum(weight) OVER (PARTITION BY incident_id, node, horizon) AS al, max(v) OVER (PARTITION BY incident_id, node, horizon) AS mx FROM x) GROUP BY 1, 2, 3"""
PS = ", ".join(f"coalesce(min(v) FILTER (run >= round(al * {q}, 9)), max(mx)) AS p{round(q * 100)}" for q in (0.1, 0.5, 0.9))


@query(f"WITH {SEL}, x AS (SELECT incident_id, node, step, CAST(h AS INT) AS horizon, fut[h] AS v, weight FROM sel, (SELECT unnest(range(1, 13)) AS h)) " + QUANT.format(PS))
def weighted_quantiles(spark, d):
    x = _selected(spark, d).select("incident_id", "node", "step", "weight", F.posexplode("fut").alias("h", "v")).withColumn("horizon", F.col("h") + 1)
    return N.weighted_quantiles(x, ["incident_id", "node", "horizon"], "v", "weight", "step")


@query(f"""WITH {SEL}, x0 AS (SELECT incident_id, node, sel.step, CAST(h AS INT) AS horizon, round(sel.fut[h] - win.hist[12], 4) AS v, weight FROM sel JOIN win USING (node, step), (SELECT unnest(range(1, 13)) AS h)), x AS (SELECT *, sum(weight * v) OVER (PARTITION BY incident_id, node, horizon) AS m FROM x0)
 SELECT q.*, round(m, 3) AS mean, round(s, 3) AS std, round(a, 3) AS mae FROM ({QUANT.format(PS)}) q JOIN (SELECT incident_id, node, horizon, any_value(m) AS m, sqrt(sum(weight * (v - m) * (v - m))) AS s, sum(weight * abs(v)) AS a FROM x GROUP BY 1, 2, 3) USING (incident_id, node, horizon)""")
def residual_distribution(spark, d):
    feat = _features(spark, d)
    base = feat.select("node", "step", F.array_repeat(F.element_at("hist", 12), 12).alias("base"))
    e = N.base_evidence(_selected(spark, d, feat), base)
    return e.select("incident_id", "node", "horizon", "p10", "p50", "p90", *[F.round(c, 3).alias(c) for c in ("mean", "std", "mae")])


EFFECTS = f"""{SEL}, hm AS (SELECT node, list(m ORDER BY h) AS means FROM (SELECT node, step % 24 AS h, round(avg(flow), 4) AS m FROM grid GROUP BY 1, 2) GROUP BY 1),
 n AS (SELECT sel.*, [means[1 + (step + i) % 24] for i in range(1, 13)] AS normal FROM sel JOIN hm USING (node)), f AS (SELECT *, {each('fut[i] - normal[i]')} AS e FROM n),
 g0 AS (SELECT *, {mean_('e[i]')} AS me, {mean_('abs(e[i])')} AS size, {dir_('e', 'normal')} AS edir, {shape_('e', 'normal')} AS shape, score / sum(score) OVER (PARTITION BY incident_id, node) AS w FROM f),
 g AS (SELECT *, sum(w * me) OVER (PARTITION BY incident_id, node) AS m FROM g0)"""


@query(f"""WITH {EFFECTS},
 sh AS (SELECT incident_id, node, arg_min(shape, (round(-sw, 9), shape)) AS medoid_shape, array_to_string(list(shape || ':' || sn ORDER BY shape), ' ') AS shapes FROM (SELECT incident_id, node, shape, sum(w) AS sw, count(*) AS sn FROM g GROUP BY 1, 2, 3) GROUP BY 1, 2)
 SELECT incident_id, node, count(*) AS n, round(sum(CASE WHEN edir = 'positive' THEN w ELSE 0 END), 4) AS positive_weight, round(sum(CASE WHEN edir = 'negative' THEN w ELSE 0 END), 4) AS negative_weight, count(*) FILTER (edir = 'neutral') AS neutral_n, round(any_value(m), 3) AS effect_mean, round(sqrt(sum(w * (me - m) * (me - m))), 2) AS effect_std, round(1 / sum(w * w), 4) AS effective, round(avg(size), 3) AS magnitude_mean, round(stddev_pop(size), 2) AS magnitude_std, any_value(medoid_shape) AS medoid_shape, any_value(shapes) AS shapes,
  round(sum(w * (CASE WHEN shape[1:1] = medoid_shape[1:1] THEN 1 ELSE 0 END + CASE WHEN shape[1:2] = medoid_shape[1:2] THEN 1 ELSE 0 END + CASE WHEN shape = medoid_shape THEN 1 ELSE 0 END) / 3), 4) AS shape_agreement FROM g JOIN sh USING (incident_id, node) GROUP BY 1, 2""")
def effect_aggregation(spark, d):
    e = R.effects(with_hourly_normal(spark, d, _selected(spark, d).drop("weight", "rank")))
    a = R.aggregate_effects(e, ["incident_id", "node"])
    digits = {"positive_weight": 4, "negative_weight": 4, "effect_mean": 3, "effect_std": 2, "effective": 4, "magnitude_mean": 3, "magnitude_std": 2, "shape_agreement": 4}
    listed = F.array_join(F.transform("shapes", lambda x: F.concat(x["shape"], F.lit(":"), x["n"].cast("string"))), " ")
    return a.select("incident_id", "node", "n", "neutral_n", "medoid_shape", listed.alias("shapes"), *[F.round(c, k).alias(c) for c, k in digits.items()])


@query(f"""WITH {EFFECTS}, x0 AS (SELECT incident_id, node, step, CAST(h AS INT) AS horizon, round(e[h], 4) AS v, w AS weight FROM g, (SELECT unnest(range(1, 13)) AS h)), x AS (SELECT *, sum(weight * v) OVER (PARTITION BY incident_id, node, horizon) AS m FROM x0)
 SELECT q.*, round(m, 3) AS mean, round(s, 2) AS std FROM ({QUANT.format(PS)}) q JOIN (SELECT incident_id, node, horizon, any_value(m) AS m, sqrt(sum(weight * (v - m) * (v - m))) AS s FROM x GROUP BY 1, 2, 3) USING (incident_id, node, horizon)""")
def effect_by_step(spark, d):
    e = R.effects(with_hourly_normal(spark, d, _selected(spark, d).drop("weight", "rank"))).withColumn("id", F.col("step"))
    x = R.effect_steps(e, ["incident_id", "node"])
    return x.select("incident_id", "node", "horizon", "p10", "p50", "p90", F.round("mean", 3).alias("mean"), F.round("std", 2).alias("std"))


def robust11_(a: str) -> str:
    med = lambda x: f"list_sort({x})[6]"
    dev = f"list_transform({a}, lambda z: abs(z - {med(a)}))"
    return f"list_transform({a}, lambda x: greatest(least((x - {med(a)}) / greatest(1.4826 * {med(dev)}, 1.0), 8.0), -8.0))"


def cosine_(a: str, b: str) -> str:
    zero = lambda x: f"list_sum([y * y for y in {x}]) = 0"
    return f"CASE WHEN {zero(a)} AND {zero(b)} THEN 1.0 WHEN {zero(a)} OR {zero(b)} THEN 0.0 ELSE {cos_sql(a, b)} END"


ANGLE = "hour * (2 * 3.141592653589793 / 24)"
BLOCK = ", ".join([*(f"CASE WHEN period = '{k}' THEN 1.0 ELSE 0.0 END" for k in ("night", "morning_peak", "midday", "evening_peak")), *(f"CASE WHEN weekday = {k} THEN 1.0 ELSE 0.0 END" for k in range(7)),
                   "CASE WHEN weekend THEN 1.0 ELSE 0.0 END", "CASE WHEN holiday THEN 1.0 ELSE 0.0 END", "CASE WHEN weekend OR holiday THEN 1.0 ELSE 0.0 END", f"sin({ANGLE})", f"cos({ANGLE})", "0.0", "0.0", "0.0", "0.0"])
FIELD_TEXTS = "CASE f WHEN 'type' THEN kind WHEN 'description' THEN 'collision of ' || kind || ' near ' || area || ', lanes closed: ' || incident_id % 5 WHEN 'area' THEN area WHEN 'location' THEN 'exit ' || incident_id % 97 || ' in ' || area WHEN 'freeway' THEN 'US-' || incident_id % 9 ELSE 'NSEW'[incident_id % 4 + 1] END"
FIELD_LIST = ", ".join(f"({i}, '{f}', {dim})" for i, (f, dim) in enumerate(V.FIELD_DIMS.items()))
FIELD_VECTORS = f"""fd AS (SELECT incident_id, k, dim, regexp_replace(trim(lower({FIELD_TEXTS})), '\\s+', ' ', 'g') AS v FROM inc, (VALUES {FIELD_LIST}) x(k, f, dim)),
 fw AS (SELECT *, regexp_extract_all(v, '[\\p{{L}}\\p{{M}}\\p{{N}}]+') AS ws FROM fd), fj AS (SELECT *, array_to_string(ws, '') AS s FROM fw),
 ft AS (SELECT incident_id, k, dim, list_distinct(list_filter(list_concat([v], ws, [s[i:i + 2] for i in range(1, greatest(len(s) - 1, 1))], [s[i:i + 3] for i in range(1, greatest(len(s) - 2, 1))]), lambda t: t <> '')) AS tokens FROM fj),
 fb AS (SELECT incident_id, k, dim, [CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % dim for t in tokens] AS b FROM ft), fc AS (SELECT incident_id, k, list_transform(range(dim), lambda i: CAST(len(list_filter(b, lambda y: y = i)) AS DOUBLE)) AS c FROM fb),
 fvec AS (SELECT incident_id, flatten(list([x / sqrt(list_sum([y * y for y in c])) for x in c] ORDER BY k)) AS fields FROM fc GROUP BY 1)"""
PATTERN_ITEMS = f"""{REF}, {FIELD_VECTORS}, sq AS (SELECT incident_id, node, list(normal ORDER BY horizon) AS normal FROM ref GROUP BY 1, 2),
 it0 AS (SELECT loc.incident_id AS id, loc.node, loc.step, loc.km, loc.seconds, loc.bearing, loc.kind, loc.area, f.hist, f.fut, f.weekend OR f.holiday AS free, f.period, f.hour, f.weekday, f.weekend, f.holiday, sq.normal, [f.hist[12] for i in range(12)] AS base, [f.hist[i + 1] - f.hist[i] for i in range(1, 12)] AS dd, {robust_('f.hist')} AS z,
  list_concat([x / sqrt(7.0) for x in v.fields], (SELECT [y / sqrt(list_sum([x * x for x in b])) / sqrt(7.0) for y in b] FROM (SELECT [{BLOCK}] AS b))) AS meta
  FROM loc JOIN fvec v ON v.incident_id = loc.incident_id JOIN feat f ON f.node = loc.node AND f.step = loc.step LEFT JOIN sq ON sq.incident_id = loc.incident_id AND sq.node = loc.node),
 it1 AS (SELECT *, [(z[2 * i - 1] + z[2 * i]) / 2 for i in range(1, 7)] AS lw, {robust11_('dd')} AS zd FROM it0),
 it AS (SELECT *, list_concat(z, zd, [(z[2 * i - 1] - z[2 * i]) / 2 for i in range(1, 7)], [(lw[2 * i - 1] - lw[2 * i]) / 2 for i in range(1, 4)], [(lw[2 * i - 1] + lw[2 * i]) / 2 for i in range(1, 4)]) AS dyn, greatest({mean_('abs(hist[i])')}, 1.0) AS scale FROM it1)"""
NEAR_ = "exp(-abs(q_{0} - c_{0}) / greatest(abs(q_{0}), abs(c_{0}), {1}))"
Q_COLS = ", ".join(f"q.{c} AS q_{c}, c.{c} AS c_{c}" for c in ("km", "seconds", "bearing", "kind", "area", "fut", "free", "period", "hour", "normal", "base", "scale", "step"))


def axis_(name: str, a: str, b: str) -> str:
    diffs = f"[({a}[i + 1] - {a}[i]) - ({b}[i + 1] - {b}[i]) for i in range(1, 12)]"
    return f"{rmse_(a, b)} AS {name}_rmse, sqrt(list_sum([x * x for x in {diffs}]) / 11) AS {name}_step_rmse"


PATTERNS = f"""WITH {PATTERN_ITEMS}, pr AS (SELECT q.id AS query_id, q.node, c.id, round({cosine_('q.meta', 'c.meta')}, 4) AS ms, round({cosine_('q.dyn', 'c.dyn')}, 4) AS ds FROM it q JOIN it c ON q.node = c.node AND c.step <= q.step - 1 AND c.id <> q.id),
 rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY ms DESC, id) AS mr, row_number() OVER (PARTITION BY query_id, node ORDER BY ds DESC, id) AS dr FROM pr),
 dp AS (SELECT rk.query_id, rk.node, rk.id, CASE WHEN mr <= 5 THEN mr END AS metadata_rank, CASE WHEN dr <= 5 THEN dr END AS history_rank, q.hist AS a, c.hist AS b, {Q_COLS} FROM rk JOIN it q ON q.id = rk.query_id AND q.node = rk.node JOIN it c ON c.id = rk.id AND c.node = rk.node WHERE mr <= 5 OR dr <= 5),
 {HIST_PARTS}, sc1 AS (SELECT *, 0.45 * wavelet + 0.20 * level + 0.20 * recent + 0.15 * changepoint AS hsim,
  coalesce(({NEAR_.format('km', 0.5)} + {NEAR_.format('seconds', 60.0)} + (cos((q_bearing - c_bearing) * (2 * 3.141592653589793 / 360)) + 1) / 2) / 3, 0.0) AS net,
  ((CASE WHEN q_free = c_free THEN 1.0 ELSE 0.0 END) + (CASE WHEN q_period = c_period THEN 1.0 ELSE 0.0 END) + (cos((q_hour - c_hour) * (2 * 3.141592653589793 / 24)) + 1) / 2) / 3 AS tm,
  ((CASE WHEN q_kind = c_kind THEN 1.0 ELSE 0.0 END) + (CASE WHEN q_area = c_area THEN 1.0 ELSE 0.0 END)) / 2 AS inc, [c_base[i] - c_normal[i] for i in range(1, 13)] AS cg, [q_base[i] - q_normal[i] for i in range(1, 13)] AS qg FROM hs),
 sc2 AS (SELECT *, round(0.55 * net + 0.25 * tm + 0.20 * inc, 4) AS network_time, round(hsim, 4) AS history, round((0.2 * tm + net + hsim + 0.5 * inc) / 2.7, 4) AS score, {axis_('base', 'c_base', 'q_base')}, {axis_('normal', 'c_normal', 'q_normal')}, {axis_('gap', 'cg', 'qg')} FROM sc1),
 sc3 AS (SELECT *, CASE WHEN c_normal IS NOT NULL AND q_normal IS NOT NULL THEN list_reverse_sort([round(x / q_scale, 6) for x in [base_rmse, base_step_rmse, normal_rmse, normal_step_rmse, gap_rmse, gap_step_rmse]]) END AS axes FROM sc2),
 sc4 AS (SELECT *, CASE WHEN axes IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, node, axes IS NOT NULL ORDER BY axes, score DESC, c_step, id) END AS state FROM sc3), {groups_sql('sc4', 'query_id, node', 0.5, 0.75, 'score')}"""


@query(f"WITH {INC}, {FIELD_VECTORS} SELECT incident_id, CAST(len(fields) AS INT) AS n, CAST(len(list_filter(fields, lambda x: x > 0)) AS INT) AS used, round(list_sum(fields), 6) AS total, round(list_sum([fields[i] * i for i in range(1, len(fields) + 1)]), 3) AS places FROM fvec")
def incident_field_vectors(spark, d):
    """The six hashed text fields of every incident in one vector."""
    places = A.total(F.transform("fields", lambda x, i: x * (i + 1)))
    told = {"n": F.size("fields"), "used": F.size(F.filter("fields", lambda x: x > 0)), "total": F.round(A.total(F.col("fields")), 6), "places": F.round(places, 3)}
    v = V.field_vectors(S.incident_texts(S.incidents(spark, d)), each=lambda t: t.withColumns(told).drop("fields"))
    return v.select("incident_id", *told)


def _pattern_items(spark, d):
    """Local incidents with their window, calendar, reference (null if there is none), last-value forecast and vectors."""
    windows = _features(spark, d)
    feat = TS.with_calendar(windows, TS.step_time(F.col("step"))).select("node", "step", "hist", "fut", "free", "period", "hour", "weekday", "weekend", "holiday")
    normal = N.sequences(N.reference(_selected(spark, d, windows))).select("incident_id", "node", "normal")
    normal = written(normal, "references")
    it = _local(spark, d).select("incident_id", "node", "step", "km", "seconds", "bearing", "kind", "area").join(feat, ["node", "step"]).join(normal, ["incident_id", "node"], "left").withColumnRenamed("incident_id", "id")
    h = F.col("hist")
    vectors = V.field_vectors(S.incident_texts(it.select(F.col("id").alias("incident_id"), "kind", "area").distinct())).select(F.col("incident_id").alias("id"), "fields")
    it = it.join(vectors, "id")
    meta = V.incident_vector([F.col("fields"), V.time_block(F.col("period"), F.col("weekday"), F.col("weekend"), F.col("holiday"), F.col("hour"))])
    return written(it.withColumns({"base": F.array_repeat(F.element_at(h, 12), 12), "scale": F.greatest(A.mean_abs(h), F.lit(1.0)), "meta": meta, "dyn": V.dynamics(h)}), "items")


def _patterns(spark, d):
    return R.retrieve(_pattern_items(spark, d), recall_k=5, least=0.5)


@query(PATTERNS + """ SELECT query_id, node, id, CAST(metadata_rank AS INT) AS metadata_rank, CAST(history_rank AS INT) AS history_rank, network_time, history, score, round(axes[1], 4) AS worst_axis, CAST(state AS INT) AS state_rank, groups, place FROM gp""")
def incident_pattern_retrieval(spark, d):
    """The whole retrieval: two recalls, their merge, scores, paired states of both sides' references, groups and final order."""
    p = _patterns(spark, d)
    return p.select("query_id", "node", "id", "metadata_rank", "history_rank", "network_time", "history", "score", F.round("worst_axis", 4).alias("worst_axis"), F.col("state").alias("state_rank"), F.array_join("groups", ",").alias("groups"), "place")


@query(PATTERNS + f""", ps AS (SELECT *, [x for x in range(1, 13) if c_fut[x] <> 0] AS ok FROM gp WHERE c_normal IS NOT NULL AND q_normal IS NOT NULL)
 SELECT query_id, node, id, round(exp(-base_rmse / q_scale), 4) AS base_alike, round(exp(-normal_rmse / q_scale), 4) AS normal_alike, round(exp(-gap_rmse / q_scale), 4) AS gap_alike, round(list_sum([CASE WHEN sign(round(cg[i], 9)) = sign(round(qg[i], 9)) THEN 1.0 ELSE 0.0 END for i in range(1, 13)]) / 12, 4) AS sign_agreement, CAST(len(ok) AS INT) AS valid_steps,
  round(list_sum([abs(c_base[i] - c_fut[i]) for i in ok]) / len(ok), 4) AS base_mae, round(list_sum([abs(c_normal[i] - c_fut[i]) for i in ok]) / len(ok), 4) AS normal_mae, round(list_sum([c_fut[i] - c_normal[i] for i in range(1, 13)]) / 12, 4) + 0.0 AS mean_effect, {dir_('[c_fut[i] - c_normal[i] for i in range(1, 13)]', 'c_normal')} AS effect_direction FROM ps""")
def paired_state_evidence(spark, d):
    """Of the selected cases: how their forecast and reference compare with the query's, and the effect that was observed."""
    p = _patterns(spark, d).where("c_normal is not null and q_normal is not null")
    p = R.effects(p.withColumn("fut", F.col("c_fut")).withColumn("normal", F.col("c_normal")))
    return p.select("query_id", "node", "id", "effect_direction", "valid_steps", (F.round("mean_effect", 4) + 0.0).alias("mean_effect"), *[F.round(c, 4).alias(c) for c in ("base_alike", "normal_alike", "gap_alike", "sign_agreement", "base_mae", "normal_mae")])


CMP = f"""cm AS (SELECT node, step, round({mean_('fa[i] - fb[i]')}, 4) AS offset_, round({rmse_('fa', 'fb')}, 4) AS rmse, round(sqrt(greatest({mean_('((fa[i] - list_sum(fa) / 12) - (fb[i] - list_sum(fb) / 12)) * ((fa[i] - list_sum(fa) / 12) - (fb[i] - list_sum(fb) / 12))')}, 0.0)), 4) AS centred_rmse,
 round(sqrt(list_sum([((fa[i + 1] - fa[i]) - (fb[i + 1] - fb[i])) * ((fa[i + 1] - fa[i]) - (fb[i + 1] - fb[i])) for i in range(1, 12)]) / 11), 4) AS step_rmse, round((fa[12] - fa[1]) - (fb[12] - fb[1]), 4) AS change_gap FROM dp)"""


def _compared(spark, d):
    c = R.compare(F.col("fa"), F.col("fb"))
    return _day_pairs(spark, d).select("node", "step", *[F.round(x, 4).alias("offset_" if k == "offset" else k) for k, x in c.items()])


@query(f"WITH {WIN}, {PAIR}, {CMP} SELECT * FROM cm")
def paired_state_compare(spark, d):
    return _compared(spark, d)


@query(f"WITH {WIN}, {PAIR}, {CMP} SELECT node, step, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY list_reverse_sort([rmse, centred_rmse, step_rmse]), step) AS INT) AS rank FROM cm) ")
def minimax_rank(spark, d):
    return R.minimax(_compared(spark, d), ["node"], ["rmse", "centred_rmse", "step_rmse"], [F.col("step")]).select("node", "step", F.col("rank").cast("int").alias("rank"))


# memory ------------------------------------------------------------------------------------------------------------
@query("""WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1)
 SELECT user_id, event_type, event_id, ts FROM u WHERE ts >= (SELECT max(ts) FROM u) - INTERVAL 10 DAY ORDER BY ts DESC, event_id DESC LIMIT 200""")
def memory_upsert_prune(spark, d):
    latest = M.upsert(S.read(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "event_id")
    return M.prune(latest, "ts", "event_id", days=10, keep=200)


@query(f"""WITH {WIN}, {NORMAL}, s AS (SELECT *, greatest(sqrt(greatest({mean_('hist[i] * hist[i]')} - {mean_('hist[i]')} * {mean_('hist[i]')}, 0.0)), 0.1 * abs({mean_('hist[i]')}), 1.0) AS scale FROM wn WHERE list_sum([abs(x) for x in hist]) > 0)
 SELECT node, step, round(scale, 6) AS scale, round(list_sum([(x - hist[12]) / scale for x in hist]) + (hist[12] - hist[8]) / scale, 6) + 0.0 AS state_sum, round(list_sum([(x - hist[12]) / scale for x in normal]), 6) + 0.0 AS decision_sum, round(list_sum([(hist[12] - x) / scale for x in normal]), 6) + 0.0 AS gap_sum FROM s""")
def memory_descriptor(spark, d):
    w = with_hourly_normal(spark, d, TS.windows(S.grid(spark, d))).where(~F.forall("hist", lambda x: x == 0))
    w = w.withColumn("base", F.array_repeat(F.element_at("hist", 12), 12))
    x = M.descriptor(F.col("hist"), F.col("base"), F.col("normal"))
    return rounded(w.select("node", "step", x["scale"].alias("scale"), A.total(x["state"]).alias("state_sum"), A.total(x["decision"]).alias("decision_sum"), A.total(x["gap"]).alias("gap_sum")), 6)


def _kern(c: str, n: int) -> str:
    return f"round(exp(-{rmse_(f'q.{c}', f'm.{c}', n)}), 6) AS s_{c}"


def _one_of(cs: tuple[str, ...]) -> str:
    known = " + ".join(f"CASE WHEN q.{c} IS NOT NULL AND m.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in cs)
    same = " + ".join(f"CASE WHEN q.{c} = m.{c} THEN 1.0::DOUBLE ELSE 0.0 END" for c in cs)
    return f"CASE WHEN ({known}) > 0 THEN ({same}) / ({known}) ELSE 0.5 END"


def pit_(queries: str) -> str:
    return f"""p0 AS (SELECT q.memory_id AS query_id, m.memory_id, m.node, m.origin, m.signature, m.has_normal, {_kern('state', 16)}, CASE WHEN m.has_normal THEN {_kern('decision', 24).split(' AS ')[0]} ELSE {_kern('decision', 12).split(' AS ')[0]} END AS s_decision,
  CASE WHEN m.has_normal THEN {_kern('reliability', 6).split(' AS ')[0]} ELSE 1.0 END AS s_reliability, CASE WHEN m.has_normal THEN {_kern('gap', 12).split(' AS ')[0]} ELSE 1.0 END AS s_gap, {_one_of(M.PHYSICAL)} AS physical, (epoch(q.origin) - epoch(m.origin)) / 86400.0 AS age,
  array_to_string(list_filter([CASE WHEN q.node <> m.node THEN 'sensor' END, CASE WHEN q.layer <> m.layer THEN 'distance layer' END, CASE WHEN q.direction IS DISTINCT FROM m.direction THEN 'direction' END, CASE WHEN least(abs(q.hour - m.hour), 24 - abs(q.hour - m.hour)) >= 3 THEN 'time of day' END, CASE WHEN sign(q.history_change) <> sign(m.history_change) THEN 'latest change' END], lambda x: x IS NOT NULL), ',') AS differences
  FROM epi q JOIN epi m ON m.available <= q.origin AND m.incident <> q.incident AND m.has_normal = q.has_normal WHERE {queries}),
 p1 AS (SELECT *, pow(2.0, -age / 30) AS recency, row_number() OVER (PARTITION BY query_id ORDER BY s_state DESC, memory_id) AS rs, row_number() OVER (PARTITION BY query_id ORDER BY s_decision DESC, memory_id) AS rd FROM p0 WHERE age >= 0 AND age <= 120),
 p2 AS (SELECT *, round((0.45 * s_state + 0.45 * s_decision + 0.1 * physical) * (0.9 + 0.1 * recency), 6) AS fits, round(CASE WHEN has_normal THEN 0.35 * s_state + 0.35 * s_decision + 0.12 * s_reliability + 0.08 * s_gap + 0.1 * physical ELSE 0.45 * s_state + 0.45 * s_decision + 0.1 * physical END * (0.9 + 0.1 * recency), 6) AS rank_score FROM p1 WHERE rs <= 24 OR rd <= 24)"""


PIT = f"{EPI}, {pit_('q.memory_id % 100 = 0')}"


def _recalled(spark, d):
    e = S.episodes(spark, d)
    return M.point_in_time(e.where("memory_id % 100 = 0"), e)


@query(f"WITH {PIT} SELECT query_id, memory_id, s_state, s_decision, fits, rank_score, round(physical, 4) AS physical, fits >= 0.4 AND s_state >= 0.5 AND s_decision >= 0.5 AS ok FROM p2")
def memory_point_in_time(spark, d):
    p = _recalled(spark, d)
    ok = (F.col("qualify") >= 0.4) & (F.col("s_state") >= 0.5) & (F.col("s_decision") >= 0.5)
    return p.select("query_id", "memory_id", "s_state", "s_decision", F.col("qualify").alias("fits"), "rank_score", F.round("physical", 4).alias("physical"), ok.alias("ok"))


def _greedy_sql(pool: str, within_s: int) -> str:
    """The fold over each query's ranked pool (query_id, memory_id, node, origin, signature, rank_score) as a recursion."""
    near = f"len(list_filter(kept, lambda y: y.node = q.node AND (y.signature = q.signature OR abs(epoch(y.origin) - epoch(q.origin)) <= {within_s}))) > 0"
    item = "{'id': q.memory_id, 'node': q.node, 'signature': q.signature, 'origin': q.origin}"
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, memory_id) AS rn FROM {pool}),
 gr AS (SELECT query_id, 1 AS rn, [{item}] AS kept FROM rk q WHERE rn = 1 UNION ALL SELECT g.query_id, q.rn, CASE WHEN len(kept) >= 3 OR {near} THEN kept ELSE list_append(kept, {item}) END FROM gr g JOIN rk q ON q.query_id = g.query_id AND q.rn = g.rn + 1),
 fin AS (SELECT query_id, kept FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn DESC) AS back FROM gr) WHERE back = 1)"""


@query(f"WITH RECURSIVE {PIT}, {_greedy_sql('p2', 7200)} SELECT query_id, [x.id for x in kept] AS kept FROM fin")
def memory_greedy_dedupe(spark, d):
    pool = _recalled(spark, d).join(S.episodes(spark, d).select("memory_id", "signature"), "memory_id")
    return M.greedy_suppress(pool, k=3, within_s=7200)


def off_(x: str, lo: int, hi: int) -> str:
    return f"list_transform(list_filter(range({lo}, {hi + 1}), lambda i: fut[i] <> 0), lambda i: {x}[i] - fut[i])"


def mae_(x: str, lo: int, hi: int) -> str:
    return f"(CASE WHEN len({off_(x, lo, hi)}) > 0 THEN list_sum([abs(z) for z in {off_(x, lo, hi)}]) / len({off_(x, lo, hi)}) END)"


def bias_(x: str, lo: int, hi: int) -> str:
    return f"(CASE WHEN len({off_(x, lo, hi)}) > 0 THEN list_sum({off_(x, lo, hi)}) / len({off_(x, lo, hi)}) END)"


def rel_(x: str) -> str:
    return f"[(z - hist[12]) / sc for z in {x}]"


def verdict_(delta: str) -> str:
    return f"CASE WHEN {delta} < -1e-6 THEN 'improved' WHEN {delta} > 1e-6 THEN 'degraded' WHEN {delta} IS NOT NULL THEN 'equal' END"


SPANS = ((1, 3), (4, 6), (7, 12))
EPISODES = f"""{PATTERN_ITEMS}, be AS (SELECT incident_id, sel.node, CASE WHEN h <= 3 THEN 1 WHEN h <= 6 THEN 4 ELSE 7 END AS lo, sum(sel.weight * abs(win.hist[12] - sel.fut[h])) / sum(sel.weight) AS m, sum(sel.weight * (win.hist[12] - sel.fut[h])) / sum(sel.weight) AS b
  FROM sel JOIN win ON win.node = sel.node AND win.step = sel.step, (SELECT unnest(range(1, 13)) AS h) GROUP BY 1, 2, 3),
 bl AS (SELECT incident_id, node, flatten(list([m, b] ORDER BY lo)) AS bands FROM be GROUP BY 1, 2),
 e0 AS (SELECT it.*, bands, greatest(sqrt(greatest({mean_('hist[i] * hist[i]')} - {mean_('hist[i]')} * {mean_('hist[i]')}, 0.0)), abs({mean_('hist[i]')}) * 0.1, 1.0) AS sc, CASE WHEN km <= 1 THEN 0 WHEN km <= 3 THEN 1 ELSE 2 END AS layer, [round((hist[12] + coalesce(normal[i], hist[12])) / 2, 2) for i in range(1, 13)] AS prediction,
  TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * it.step AS origin FROM it LEFT JOIN bl ON bl.incident_id = it.id AND bl.node = it.node WHERE list_sum([abs(x) for x in hist]) > 0),
 e1 AS (SELECT *, {mae_('base', 1, 12)} AS base_mae, {mae_('prediction', 1, 12)} AS prediction_mae, {bias_('base', 1, 12)} AS base_bias, {bias_('prediction', 1, 12)} AS prediction_bias, {', '.join(f"len({off_('base', lo, hi)}) AS n{lo}, {mae_('base', lo, hi)} AS b{lo}, {mae_('prediction', lo, hi)} AS p{lo}" for lo, hi in SPANS)} FROM e0),
 epi AS (SELECT *, 'incident_' || id || '_node_' || node || '_layer_' || layer AS memory_id, id AS incident, origin + INTERVAL 60 MINUTE AS available, normal IS NOT NULL AS has_normal, list_concat({rel_('hist')}, [(hist[i + 1] - hist[i]) / sc for i in range(8, 12)]) AS state,
  list_concat({rel_('base')}, CASE WHEN normal IS NOT NULL THEN {rel_('normal')} ELSE [0.0 for i in range(12)] END) AS decision, CASE WHEN normal IS NOT NULL THEN [(base[i] - normal[i]) / sc for i in range(1, 13)] ELSE [0.0 for i in range(12)] END AS gap,
  CASE WHEN normal IS NOT NULL THEN [x / sc for x in bands] ELSE [0.0 for i in range(6)] END AS reliability, hist[12] - hist[11] AS history_change, sha256(array_to_string([CAST(round(x, 4) AS VARCHAR) for x in hist], ',')) AS signature, area AS road, kind AS direction, bearing < 180 AS same_direction, km < 2.5 AS same_road,
  prediction_mae - base_mae AS delta FROM e1)"""


def _episodes(spark, d):
    """Episodes of all local incidents: the last value as base, half way to the reference as prediction, reliability of the base over the reference's windows."""
    feat = _features(spark, d)
    chosen = _selected(spark, d, feat)
    errors = chosen.join(feat.select("node", "step", F.element_at("hist", 12).alias("last")), ["node", "step"]).select("incident_id", "node", "weight", "last", F.posexplode("fut").alias("h", "y"))
    lo = F.when(F.col("h") < 3, 1).when(F.col("h") < 6, 4).otherwise(7)
    off = F.col("last") - F.col("y")
    errors = errors.groupBy("incident_id", "node", lo.alias("lo")).agg((F.sum(F.col("weight") * F.abs(off)) / F.sum("weight")).alias("mae"), (F.sum(F.col("weight") * off) / F.sum("weight")).alias("bias"))
    bands = errors.groupBy("incident_id", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("lo", "mae", "bias"))), lambda x: F.struct(x["mae"].alias("mae"), x["bias"].alias("bias"))).alias("bands"))
    normal = N.sequences(N.reference(chosen)).select("incident_id", "node", "normal")
    it = _local(spark, d).drop("dt", "duration_minutes").join(feat.select("node", "step", "hist", "fut"), ["node", "step"]).join(written(normal, "references"), ["incident_id", "node"], "left").join(bands, ["incident_id", "node"], "left")
    last = F.element_at("hist", 12)
    guess = F.when(F.col("normal").isNotNull(), F.transform("normal", lambda x: F.round((F.element_at("hist", 12) + x) / 2, 2))).otherwise(F.array_repeat(F.round(last, 2), 12))
    it = it.withColumns({"base": F.array_repeat(last, 12), "prediction": guess, "layer": F.when(F.col("km") <= 1, 0).when(F.col("km") <= 3, 1).otherwise(2), "dt": TS.step_time(F.col("step")),
                         "road": F.col("area"), "direction": F.col("kind"), "same_direction": F.col("bearing") < 180, "same_road": F.col("km") < 2.5})
    it = it.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "incident_id", "node")  # few bytes, but much work a row
    return written(M.build_episodes(it).where("state is not null"), "episodes")


@query(f"""WITH {EPISODES} SELECT memory_id, origin, available, has_normal, round(base_mae, 6) AS base_mae, round(prediction_mae, 6) AS prediction_mae, round(delta, 6) + 0.0 AS delta, {verdict_('delta')} AS verdict,
 CASE WHEN delta > 1e-6 THEN CASE WHEN -base_bias * (prediction_bias - base_bias) < 0 THEN 'sign_error' WHEN ratio > 1.5 THEN 'over_correction' WHEN ratio < 0.5 THEN 'under_correction' WHEN prediction_bias - base_bias < -base_bias THEN 'too_low' WHEN prediction_bias - base_bias > -base_bias THEN 'too_high' ELSE 'phase_mismatch' END END AS failure,
 {" || ' ' || ".join(f"n{lo} || ':' || coalesce({verdict_(f'p{lo} - b{lo}')}, '-')" for lo, _ in SPANS)} AS outcomes, round(list_sum(state), 5) + 0.0 AS state_sum, round(list_sum(decision), 5) + 0.0 AS decision_sum, round(list_sum(gap), 5) + 0.0 AS gap_sum, round(list_sum(reliability), 5) + 0.0 AS reliability_sum, n1 + n4 + n7 AS points,
 CASE WHEN n1 + n4 + n7 = 0 THEN 'no_valid_outcome' WHEN base_mae >= 15 THEN 'large_base_error' WHEN delta >= 10 THEN 'large_tool_regression' ELSE 'low_value_success' END AS reason
 FROM (SELECT *, CASE WHEN base_bias <> 0 THEN (prediction_bias - base_bias) / -base_bias WHEN prediction_bias = base_bias THEN 1.0 ELSE 999.0 END AS ratio FROM epi)""")
def episode_building(spark, d):
    """Whole episodes from windows, references and forecasts, with what they are worth to learn from."""
    e = _episodes(spark, d).withColumn("relevance", M.learning_relevance(F.col("outcomes")))
    told = F.transform("outcomes", lambda x: F.concat(x["base"]["points"].cast("string"), F.lit(":"), F.coalesce(x["outcome"], F.lit("-"))))
    sums = [(F.round(A.total(F.col(c)), 5) + 0.0).alias(f"{c}_sum") for c in ("state", "decision", "gap", "reliability")]
    return e.select("memory_id", "origin", "available", "has_normal", F.round("metrics.base.mae", 6).alias("base_mae"), F.round("metrics.prediction.mae", 6).alias("prediction_mae"), (F.round("metrics.delta", 6) + 0.0).alias("delta"), "verdict", "failure",
                    F.array_join(told, " ").alias("outcomes"), *sums, F.col("relevance.points").cast("bigint").alias("points"), F.col("relevance.reason").alias("reason"))


@query(f"WITH {EPISODES}, {pit_('true')} SELECT query_id, memory_id, s_state, s_decision, s_reliability, s_gap, fits, rank_score, round(physical, 4) AS physical, fits >= 0.5 AND s_state >= 0.5 AND s_decision >= 0.5 AS ok FROM p2")
def episode_point_in_time(spark, d):
    """What each episode could recall of those before it."""
    e = _episodes(spark, d)
    ok = (F.col("qualify") >= 0.5) & (F.col("s_state") >= 0.5) & (F.col("s_decision") >= 0.5)
    return M.point_in_time(e, e).select("query_id", "memory_id", "s_state", "s_decision", "s_reliability", "s_gap", F.col("qualify").alias("fits"), "rank_score", F.round("physical", 4).alias("physical"), ok.alias("ok"))


@query(f"""WITH RECURSIVE {EPISODES}, {pit_('true')}, ok AS (SELECT p2.* FROM p2 JOIN epi USING (memory_id) WHERE fits >= 0.5 AND s_state >= 0.5 AND s_decision >= 0.5 AND n1 + n4 + n7 > 0 AND (base_mae >= 15 OR delta >= 10)), {_greedy_sql('ok', 900)},
 un AS (SELECT query_id, unnest(range(1, len(kept) + 1)) AS place, kept FROM fin) SELECT un.query_id, CAST(place AS INT) AS place, kept[place].id AS memory_id, rank_score, differences FROM un JOIN p2 ON p2.query_id = un.query_id AND p2.memory_id = kept[place].id""")
def episode_retrieval(spark, d):
    """The whole retrieval over real episodes, with the thresholds in use."""
    e = _episodes(spark, d)
    relevance = e.select("memory_id", M.learning_relevance(F.col("outcomes"))["eligible"].alias("eligible"))
    return M.retrieve(e, e, relevance).select("query_id", "place", "memory_id", "rank_score", F.array_join("differences", ",").alias("differences"))


LEARN = "lr AS (SELECT memory_id, round(abs(gap[1]) * 40, 4) AS base_mae, round(gap[2] * 30, 4) AS delta, memory_id % 7 AS points FROM epi)"


@query(f"""WITH RECURSIVE {PIT}, {LEARN}, ok AS (SELECT p2.* FROM p2 JOIN lr USING (memory_id) WHERE fits >= 0.1 AND s_state >= 0.1 AND s_decision >= 0.1 AND points > 0 AND (base_mae >= 1 OR delta >= 10)), {_greedy_sql('ok', 900)},
 un AS (SELECT query_id, unnest(range(1, len(kept) + 1)) AS place, kept FROM fin) SELECT un.query_id, CAST(place AS INT) AS place, kept[place].id AS memory_id, rank_score, differences FROM un JOIN p2 ON p2.query_id = un.query_id AND p2.memory_id = kept[place].id""")
def memory_retrieval(spark, d):
    """The whole retrieval: eligibility, dual recall, qualification, relevance, suppression, differences. Thresholds are low, as these vectors are random."""
    e = S.episodes(spark, d)
    gap = lambda i, k: F.round(F.element_at("gap", i) * k, 4)
    relevance = e.select("memory_id", M.eligible_to_learn(F.round(F.abs(F.element_at("gap", 1)) * 40, 4), gap(2, 30), F.col("memory_id") % 7, 1.0).alias("eligible"))
    out = M.retrieve(e.where("memory_id % 100 = 0"), e, relevance, least=0.1, kernels=0.1)
    return out.select("query_id", "place", "memory_id", "rank_score", F.array_join("differences", ",").alias("differences"))


@query(f"""WITH {EPI}, x AS (SELECT memory_id, round(abs(gap[1]) * 40, 4) AS base_mae, round(gap[2] * 30, 4) AS delta, memory_id % 7 AS points, round(gap[3] * 10, 4) AS g, round(gap[4] * 10, 4) AS c FROM epi)
 SELECT memory_id, CASE WHEN points = 0 THEN 'no_valid_outcome' WHEN base_mae >= 15 THEN 'large_base_error' WHEN delta >= 10 THEN 'large_tool_regression' ELSE 'low_value_success' END AS reason, CASE WHEN delta < -1e-6 THEN 'improved' WHEN delta > 1e-6 THEN 'degraded' ELSE 'equal' END AS verdict,
 CASE WHEN g * c < 0 THEN 'sign_error' WHEN ratio > 1.5 THEN 'over_correction' WHEN ratio < 0.5 THEN 'under_correction' WHEN c < g THEN 'too_low' WHEN c > g THEN 'too_high' ELSE 'phase_mismatch' END AS mode FROM (SELECT *, CASE WHEN g <> 0 THEN c / g WHEN c = 0 THEN 1.0 ELSE 999.0 END AS ratio FROM x)""")
def memory_learning_filter(spark, d):
    gap = lambda i, k: F.round(F.element_at("gap", i) * k, 4)
    x = S.episodes(spark, d).select("memory_id", F.round(F.abs(F.element_at("gap", 1)) * 40, 4).alias("base_mae"), gap(2, 30).alias("delta"), (F.col("memory_id") % 7).alias("points"), gap(3, 10).alias("g"), gap(4, 10).alias("c"))
    return x.select("memory_id", M.learning_reason(F.col("base_mae"), F.col("delta"), F.col("points")).alias("reason"), M.verdict(F.col("delta")).alias("verdict"), M.failure_mode(F.col("g"), F.col("c")).alias("mode"))


# evaluation --------------------------------------------------------------------------------------------------------
LONG = "lg AS (SELECT node, step, CAST(h AS INT) AS horizon, fut[h] AS y, hist[12] AS p FROM win, (SELECT unnest(range(1, 13)) AS h))"


def _forecasts(spark, d):
    """Last-value forecasts of all windows, one row a step."""
    return TS.windows(S.grid(spark, d)).select("node", "step", F.element_at("hist", 12).alias("p"), F.posexplode("fut").alias("h", "y")).withColumn("horizon", F.col("h") + 1)


@query(f"""WITH {WIN}, s AS (SELECT node, step, step % 24 AS phase, CAST(sum(CAST(round(hist[12] * 10000) AS HUGEINT)) OVER o AS DOUBLE) / 10000 / count(*) OVER o AS m FROM win WINDOW o AS (PARTITION BY node, step % 24 ORDER BY step ROWS UNBOUNDED PRECEDING)),
 a AS (SELECT node, step, h, (step + h) % 24 AS phase, hist[12] AS last FROM win, (SELECT unnest(range(1, 13)) AS h)), f AS (SELECT a.node, a.step, a.h, arg_max(s.m, s.step) AS m, any_value(last) AS last FROM a LEFT JOIN s ON s.node = a.node AND s.phase = a.phase AND s.step <= a.step GROUP BY 1, 2, 3)
 SELECT node, step, round(sum(coalesce(m, last)), 6) AS total, round(max(CASE WHEN h = 1 THEN coalesce(m, last) END), 6) AS first FROM f GROUP BY 1, 2""")
def seasonal_forecast(spark, d):
    f = forecasts.forecast_table(TS.windows(S.grid(spark, d)), "seasonal_24")
    return f.select("node", "step", F.round(A.total(F.col("base")), 6).alias("total"), F.round(F.element_at("base", 1), 6).alias("first"))


@query(f"""WITH {WIN}, {INC}, it AS (SELECT loc.*, w.hist, w.fut FROM loc JOIN win w USING (node, step)) SELECT incident_id, node, CASE WHEN list_sum([abs(x) for x in hist]) = 0 THEN 'missing_all_zero' ELSE 'observed' END AS status, list_sum([abs(x) for x in hist]) > 0 AS counts, CASE WHEN list_sum([abs(x) for x in hist]) = 0 THEN 0.0 ELSE round(hist[12], 4) END AS prediction, kind FROM it""")
def context_records(spark, d):
    """Evidence rows of the local incidents and the records of a run that predicts the last value; sensors that are down count in no metric."""
    w = TS.windows(S.grid(spark, d))
    base = forecasts.last_value(w)
    made = context.rendered(context.assemble(w, _local(spark, d).select("incident_id", "node", "step", F.lit(0).alias("layer"), "kind", "area", "duration_minutes"), base))
    predictions = made.select("incident_id", "node", F.col("evidence.base").alias("prediction"))
    r = context.result_records(made, predictions).join(made.select("incident_id", "node", "body"), ["incident_id", "node"])
    return r.select("incident_id", "node", "status", F.element_at("metric_mask", 1).alias("counts"), F.round(F.element_at("prediction", 1), 4).alias("prediction"), F.get_json_object("body", "$.incident.kind").alias("kind"))


@query(f"""WITH {WIN}, {LONG}, u AS (SELECT node, horizon, count(*) AS count, sum(abs(e)) AS a, sum(e * e) AS s, sum(e) AS b, sum(CAST(round(abs(p - y) / abs(y) * 100000000) AS HUGEINT)) AS r FROM (SELECT *, CAST(round((p - y) * 10000) AS HUGEINT) AS e FROM lg WHERE y <> 0) GROUP BY 1, 2)
 SELECT node, horizon, count, {ratio_('a', '(count * 10000)', 3)} AS mae, {ratio_('r', '(count * 100000000)', 3)} AS mape, {ratio_('(r * 100)', '(count * 100000000)', 2)} AS mape_percent, round(sqrt(CAST(s AS DOUBLE) / count) / 10000, 3) AS rmse, {ratio_('b', '(count * 10000)', 3)} AS bias FROM u""")
def masked_metrics_by_step(spark, d):
    return E.exact_metrics(_forecasts(spark, d), ["node", "horizon"])


@query(f"""WITH {WIN}, {LONG}, v AS (SELECT *, step AS w_id, (1 + step % 3)::HUGEINT AS weight, CAST(round((p - y) * 10000) AS HUGEINT) AS err, CASE WHEN horizon <= 3 THEN '1-3' WHEN horizon <= 6 THEN '4-6' ELSE '7-12' END AS band FROM lg WHERE y <> 0),
 g AS (SELECT node, w_id, CASE WHEN horizon IS NOT NULL THEN 'step ' || horizon WHEN band IS NOT NULL THEN 'band ' || band ELSE 'overall' END AS level, sum(weight) AS s, sum(weight * abs(err)) AS a, sum(weight * err) AS b, count(*) AS n FROM v GROUP BY GROUPING SETS ((node, w_id, horizon), (node, w_id, band), (node, w_id)))
 SELECT node, level, {ratio_('sum(a)', '(sum(s) * 10000)', 3)} AS mae, {ratio_('sum(b)', '(sum(s) * 10000)', 3)} AS bias, CAST(sum(n) AS BIGINT) AS valid_points, {ratio_('(sum(s) * sum(s))', 'sum(s * s)', 3)} AS effective_windows FROM g GROUP BY 1, 2""")
def horizon_profile_bands(spark, d):
    f = _forecasts(spark, d).withColumn("window", F.col("step")).withColumn("weight", (1 + F.col("step") % 3).cast("double"))
    return E.horizon_profile(f, ["node"], places=4)


@query(f"""WITH {WIN}, {NORMAL}, o AS (SELECT node, step, CAST(h AS INT) AS horizon, fut[h] AS y, hist[12] AS base, normal[h] AS normal, greatest(hist[12], normal[h]) AS prediction FROM wn, (SELECT unnest(range(1, 13)) AS h)),
 b AS (SELECT *, CASE WHEN horizon <= 3 THEN 1 WHEN horizon <= 6 THEN 4 ELSE 7 END AS start_step, CASE WHEN horizon <= 3 THEN 3 WHEN horizon <= 6 THEN 6 ELSE 12 END AS end_step FROM o WHERE y <> 0),
 g AS (SELECT node, step, start_step, end_step, count(*) AS valid_points, avg(abs(base - y)) AS base_mae, avg(base - y) AS base_bias, avg(abs(normal - y)) AS normal_mae, avg(normal - y) AS normal_bias, avg(abs(prediction - y)) AS prediction_mae, avg(prediction - y) AS prediction_bias FROM b GROUP BY 1, 2, 3, 4)
 SELECT node, step, CAST(start_step AS INT) AS start_step, CAST(end_step AS INT) AS end_step, valid_points, round(base_mae, 7) AS base_mae, round(base_bias, 7) + 0.0 AS base_bias, round(normal_mae, 7) AS normal_mae, round(normal_bias, 7) + 0.0 AS normal_bias, round(prediction_mae, 7) AS prediction_mae, round(prediction_bias, 7) + 0.0 AS prediction_bias, round(prediction_mae - base_mae, 7) + 0.0 AS delta,
  CASE WHEN prediction_mae - base_mae < -1e-6 THEN 'improved' WHEN prediction_mae - base_mae > 1e-6 THEN 'degraded' ELSE 'equal' END AS outcome FROM g""")
def local_outcomes(spark, d):
    """Errors per band of the last value, the hourly mean and the greater of both."""
    w = with_hourly_normal(spark, d, TS.windows(S.grid(spark, d))).select("node", "step", F.element_at("hist", 12).alias("base"), F.posexplode(F.arrays_zip(F.col("fut").alias("y"), "normal")).alias("h", "x"))
    w = w.select("node", "step", (F.col("h") + 1).alias("horizon"), "base", "x.y", "x.normal").withColumn("prediction", F.greatest("base", "normal"))
    return rounded(E.local_outcomes(w, ["node", "step"]), 7)


@query(f"""WITH {WIN}, k AS (SELECT node, step, hist[12] AS last, hist[12] - list_min(fut) AS dr FROM win), r AS (SELECT *, dr / greatest(last, 1.0) AS rel FROM k)
 SELECT node, step, round(last, 3) AS last, round(dr, 3) AS drop_, round(dr * rel, 4) AS score FROM r WHERE last >= 50 AND dr >= 20 AND rel >= 0.1 ORDER BY round(dr * rel, 4) DESC, node, step LIMIT 50""")
def impact_case_selection(spark, d):
    return E.impact_cases(TS.windows(S.grid(spark, d)), 50).select("node", "step", F.round("last", 3).alias("last"), F.round("drop_", 3).alias("drop_"), "score")


@query(f"SELECT count(*) AS incidents, {ratio_('sum(CAST(round(value * 10000) AS HUGEINT))', '10000', 2)} AS total_ms, round(avg(value), 4) AS average_ms FROM events WHERE event_type = 'error'")
def processing_time_summary(spark, d):
    """One row: the error events as runs that took their value in ms."""
    runs = S.read(spark, d, "events").where("event_type = 'error'").select(F.col("value").alias("processing_ms"))
    return E.processing_summary(runs).select("incidents", F.round("total_ms", 2).alias("total_ms"), F.round("average_ms", 4).alias("average_ms"))


@query("SELECT event_type AS module, count(*) AS calls, round(sum(value), 3) AS total, round(min(value), 4) AS least, round(max(value), 4) AS most, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def event_timing_summary(spark, d):
    return S.read(spark, d, "events").groupBy(F.col("event_type").alias("module")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 3).alias("total"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"), F.round(F.avg("value"), 4).alias("mean"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'gap' WHEN 2 THEN 'cover' WHEN 3 THEN 'length' WHEN 4 THEN 'value' ELSE 'no phases' END AS problem, event_id % 6 = 0 AS valid FROM events""")
def response_validation(spark, d):
    phase = lambda a, b, n, v: F.concat(F.lit(f'{{"start_step":{a},"end_step":{b},"evidence_references":[],"explanation":"","predicted_flow":['), F.array_join(F.array_repeat(F.lit(str(v)), n), ","), F.lit("]}"))
    bodies = [[phase(1, 6, 6, 5.0), phase(7, 12, 6, 4.0)], [phase(1, 6, 6, 5.0), phase(8, 12, 5, 4.0)], [phase(1, 11, 11, 5.0)], [phase(1, 12, 11, 5.0)], [phase(1, 12, 12, -1.0)]]
    k = F.col("event_id") % 6
    body = F.lit("{}")
    for i, b in enumerate(bodies):
        body = F.when(k == i, F.concat(F.lit('{"target_node_id":1,"forecast_explanation":"","phase_analysis":['), F.concat_ws(",", *b), F.lit("]}"))).otherwise(body)
    return records.validate_responses(S.read(spark, d, "events").select("event_id", body.alias("body"))).select("event_id", "problem", "valid")
