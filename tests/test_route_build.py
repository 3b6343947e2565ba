"""The route table is built once, whatever breaks off."""

import pytest
from pyspark.sql import functions as F

from wayglass.functions.keys import haversine_km
from wayglass.sources import route_build


@pytest.fixture(scope="module")
def places(spark):
    incidents = spark.range(23).selectExpr("cast(id as string) incident_id", "38 + id / 100.0D as lat", "-121 - id % 5 / 50.0D as lng")
    sensors = spark.range(11).selectExpr("cast(id as int) node_index", "38 + id / 70.0D as lat", "-121.05D as lng")
    return incidents, sensors


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_broken_build_is_resumed(spark, places, tmp_path):
    path, sizes, asked = str(tmp_path / "routes"), {"rows": 5, "destinations": 4, "blocks": 2}, []

    def router(pairs, breaks_at=None):
        asked.append(rows(pairs.select("incident_id", "node_index")))
        if len(asked) == breaks_at:
            raise OSError("no service")
        return route_build.straight()(pairs).where("node_index <> 3")

    with pytest.raises(OSError):
        route_build.build_routes(*places, lambda p: router(p, 4), path, **sizes)
    lost = asked.pop()  # this commit left no note
    assert rows(route_build.built_routes(spark, path).select("incident_id", "node_index")) == sorted(x for a in asked for x in a)
    assert route_build.build_routes(*places, router, path, **sizes, commits=2) == 3 and asked[3] == lost
    assert route_build.build_routes(*places, router, path, **sizes) == 0 and len(asked) == 8  # 5 x 3 blocks in twos
    assert route_build.build_routes(*places, router, path, **sizes) == 0 and len(asked) == 8
    pairs = sorted(x for a in asked for x in a)
    assert len(pairs) == len(set(pairs)) == 23 * 11  # no pair twice
    a, b = places
    whole = a.withColumnsRenamed({"lat": "a_lat", "lng": "a_lng"}).crossJoin(b.withColumnsRenamed({"lat": "b_lat", "lng": "b_lng"}))
    km = haversine_km(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    wanted = rows(whole.select("incident_id", "node_index", F.when(F.col("node_index") != 3, F.round(km * 1300, 4))))
    built = route_build.built_routes(spark, path)
    assert rows(built.select("incident_id", "node_index", F.round("distance_m", 4))) == wanted
    assert built.where("node_index = 3 and (bearing_deg is not null or duration_s is not null)").count() == 0


def test_another_plan_raises(spark, places, tmp_path):
    incidents, sensors = places
    path = str(tmp_path / "routes")
    assert route_build.build_routes(incidents, sensors, route_build.straight(), path, commits=0) == 1
    for a, b, sizes in ((incidents.where("incident_id <> '3'"), sensors, {}), (incidents, sensors.withColumn("lat", F.col("lat") + 1), {}), (incidents, sensors, {"rows": 7})):
        with pytest.raises(ValueError, match="other inputs or sizes"):
            route_build.build_routes(a, b, route_build.straight(), path, **sizes)
    with pytest.raises(FileNotFoundError):
        route_build.built_routes(spark, path)
    assert route_build.build_routes(incidents.limit(0), sensors, route_build.straight(), str(tmp_path / "none")) == 0
