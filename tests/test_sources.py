import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayglass.sources import tables


def test_incident_file(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("\t".join(tables.INCIDENT_COLUMNS) + "\n" + "\t".join(["7", "01/02/2024 03:04:05", "12.5", "38.1", "-121.2", "d", "t", "a", "l", "99.0", " n "]) + "\n")
    r = tables.read_incidents(spark, str(tmp_path / "i.tsv")).first()
    assert (r.incident_id, r.dt, r.duration_minutes, r.road, r.direction) == ("7", dt.datetime(2024, 1, 2, 3, 4, 5), 12.5, "99", "N")


def test_dense_arrays_round_trip(spark, tmp_path):
    np.save(tmp_path / "m1.npy", np.arange(2 * 4 * 3).reshape(2, 4, 3))
    months = spark.createDataFrame([(1, str(tmp_path / "m1.npy"), dt.datetime(2024, 1, 1))], "month int, path string, start timestamp_ntz")
    tables.write_traffic(tables.dense_to_rows(months, lambda p: np.load(p, mmap_mode="r")), str(tmp_path / "t"))
    got = tables.read_traffic(spark, str(tmp_path / "t"), [1])
    assert got.count() == 8 and got.where("node_index = 1 and step = 3").first().speed == 23.0
    sensors = spark.createDataFrame([(0, "A"), (1, "B")], "node_index int, county string")
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 1, 1.0)], "src int, dst int, weight double")
    own, rows, inner = tables.region_extract(sensors, ["B"], got, edges)
    assert (own.count(), rows.count(), inner.count()) == (1, 4, 1)


def test_upsert_and_retention(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, dt.datetime(2023, 1, 1)), ("b", 2, dt.datetime(2024, 1, 1))], "k string, seq long, t timestamp_ntz")
    tables.upsert_memory(spark, "", df, str(tmp_path / "v0"), ["k"], "seq", "t")
    assert [r.k for r in spark.read.parquet(str(tmp_path / "v0")).select(F.col("k")).collect()] == ["b"]


def test_routes_have_a_version(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([("a", 1, 5.0, float("nan"), -1.0), ("b", 2, None, 3.0, 4.0)], "incident_id string, node_index int, distance_m double, duration_s double, bearing_deg double")
    tables.write_routes(df, path)
    got = {r.incident_id: (r.distance_m, r.duration_s, r.bearing_deg) for r in tables.read_routes(spark, path).collect()}
    assert got == {"a": (5.0, None, None), "b": (None, 3.0, 4.0)}
    with pytest.raises(ValueError, match="version"):
        tables.read_routes(spark, path, 2)


def test_json_objects(spark, tmp_path):
    path = str(tmp_path / "x" / "m.json")
    for value in ({"a": 1}, {"b": ["é", None]}):
        tables.write_json(spark, path, value)
        assert tables.read_json(spark, path) == value
    assert [p.name for p in (tmp_path / "x").iterdir() if not p.name.startswith(".")] == ["m.json"]


def test_episodes_of_one_version(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"schema_version":"v3","memory_id":"a","descriptor":1}\n\n{"schema_version":"v2","memory_id":"b","descriptor":1}\n{"schema_version":"v3","memory_id":"c"}\n')
    schema = "schema_version string, memory_id string, descriptor int"
    read = lambda required=None: [r.memory_id for r in tables.read_episodes(spark, str(tmp_path / "e.jsonl"), schema, "v3", required).collect()]
    assert read() == ["a", "c"] and read(["descriptor"]) == ["a"]
    (tmp_path / "bad.jsonl").write_text("[1\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        tables.read_episodes(spark, str(tmp_path / "bad.jsonl"), schema, "v3").collect()
    spark.range(5).write.parquet(str(tmp_path / "m"))
    assert tables.clear_episodes(spark, str(tmp_path / "m")) == 5 and spark.read.parquet(str(tmp_path / "m")).count() == 0


def test_sensors_incidents_and_manifest(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("\t".join(f.name for f in tables.SENSORS) + "\n" + "".join(f"\t{n}\t{c}\t99\tN\t38\t-121\tx\tML\tI-99\n" for n, c in ((10, "A"), (30, "A"), (20, "B"), (5, "A"))))
    sensors = tables.read_sensors(spark, str(tmp_path / "s.tsv"))
    order = spark.createDataFrame([(i, n) for i, n in enumerate((5, 20, 30, 10))], "position int, node_id long")
    own = tables.ordered_sensors(sensors, order, ["A"])
    assert [(r.node_index, r.node_id) for r in own.collect()] == [(0, 5), (1, 30), (2, 10)]
    with pytest.raises(ValueError, match="places"):
        tables.ordered_sensors(sensors, order.where("node_id <> 5"), ["A"])
    assert {(r.node_id, r.position) for r in tables.positions(own, order).collect()} == {(5, 0), (30, 2), (10, 3)}
    with pytest.raises(ValueError, match="30"):
        tables.positions(own, order.where("node_id <> 30"))
    edges = spark.createDataFrame([(0, 0, 7.0), (0, 2, 1500.0), (2, 0, -1.0), (3, 0, float("nan")), (1, 0, 5.0)], "src int, dst int, distance_m double")
    got = {(r.src, r.dst): r.distance_km for r in tables.network_distance(edges, tables.positions(own, order)).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 1.5, (1, 0): None, (2, 0): None}
    raw = spark.createDataFrame([("1", " X "), ("2", None), ("3", "Y"), ("4", "X")], "incident_id string, AREA string")
    found, per = tables.region_incidents(raw, ["X"])
    assert {r.incident_id for r in found.collect()} == {"1", "4"} and [(r.AREA, r.n) for r in per.collect()] == [("X", 2)]
    traffic = spark.createDataFrame([(0, m, s) for m in (1, 2) for s in (0, 1)], "node_index int, month int, step int")
    w = spark.createDataFrame([(0, 1, 0.0), (1, 0, 2.0)], "src int, dst int, weight double")
    m = tables.manifest("d", "r", traffic, w, found, own)
    assert (m["status"], m["adjacency"], m["node_count"], m["months"][1]) == ("complete", {"edges": 1}, 3, {"month": 2, "rows": 2, "nodes": 1, "last_step": 1})
    assert tables.manifest("d", "r", None, None, found, own)["status"] == "metadata_only"
    with pytest.raises(ValueError, match="missing"):
        tables.whole_year(traffic)
    with pytest.raises(FileNotFoundError):
        tables.validate_sources(spark, [str(tmp_path / "s.tsv")] * 12, [str(tmp_path / "none")])
    tables.validate_sources(spark, [str(tmp_path / "s.tsv")] * 12, [])
    tables.write_tsv(found, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).count() == 2
    assert tables.result_path("/x/", "r", "m", "base", "left_out") == "/x/runs/r/m/base/left-out.tsv"


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(i, f"x{i}" if i else None) for i in range(20)], "a int, b string")
    assert tables.fingerprint(df, ["a", "b"]) == tables.fingerprint(df.repartition(5).orderBy("b"), ["b", "a"]) != tables.fingerprint(df.where("a > 0"), ["a", "b"])


def test_written_tables_can_be_dropped(spark):
    from pathlib import Path

    from wayglass.sources import scratch

    n = scratch.n_written()
    a, b = scratch.written(spark.range(3), "a"), scratch.written(spark.range(4), "b")
    paths = [Path(p) for p in scratch._made[n:]]
    scratch.drop_written(spark, n, keep=b)
    assert [p.exists() for p in paths] == [False, True] and b.count() == 4
    scratch.drop_written(spark, n)
    assert not paths[1].exists()
