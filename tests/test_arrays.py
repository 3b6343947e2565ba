"""Dense monthly arrays as a data source: what is read, and only that."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan

from wayglass.sources import arrays, tables

NODES, STEPS = 10, 50


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at, rnd = tmp_path_factory.mktemp("arrays"), np.random.default_rng(0)
    out = []
    for month in (1, 2, 3):
        np.save(at / f"{month}.npy", rnd.random((NODES, STEPS, 3)).astype(np.float32))
        out.append((month, str(at / f"{month}.npy"), f"2023-{month:02}-01T00:00:00"))
    return out


def brute(files, keep):
    out = []
    for month, path, start in files:
        data = np.load(path)
        for n in range(NODES):
            for s in range(STEPS):
                if keep(month, n, s):
                    ts = np.datetime64(start) + np.timedelta64(5 * s, "m")
                    out.append((n, month, s, ts.astype("datetime64[us]").item(), *map(float, data[n, s])))
    return sorted(out)


@pytest.mark.parametrize(("where", "keep"), [
    ("true", lambda m, n, s: True), ("month = 2 and node_index in (1, 2, 7)", lambda m, n, s: m == 2 and n in (1, 2, 7)),
    ("month >= 2 and node_index < 3 and step between 5 and 8", lambda m, n, s: m >= 2 and n < 3 and 5 <= s <= 8),
    ("month = 9", lambda m, n, s: False), ("node_index = 4 and flow > 0.5 and (step = 1 or month = 3)", None),
])
def test_rows_are_those_of_the_arrays(spark, files, where, keep):
    found = sorted(map(tuple, arrays.read_arrays(spark, files, nodes=4).where(where).collect()))
    if keep is None:
        wanted = [r for r in brute(files, lambda m, n, s: n == 4 and (s == 1 or m == 3)) if r[4] > 0.5]
        assert len(wanted) > 5
    else:
        wanted = brute(files, keep)
    assert found == wanted


def test_filters_are_pushed_and_show_in_the_plan(spark, files):
    df = arrays.read_arrays(spark, files).where("month = 2 and node_index in (1, 3) and flow > 0.5")
    assert df.count() > 0
    scan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(x for x in scan.splitlines() if x.startswith("PushedFilters"))
    assert "EqualTo(month,2)" in pushed and "In(node_index" in pushed and "flow" not in pushed.replace("IsNotNull(flow)", "")
    plan = df._jdf.queryExecution().executedPlan().toString()
    kept = plan[plan.index("Filter") : plan.index("BatchScan")]
    assert "flow" in kept and "month" not in kept and "node_index" not in kept  # what is left to Spark


def reader(files, filters):
    r = arrays.ArrayReader({"files": __import__("json").dumps(files), "nodes": 4})
    return r, list(r.pushFilters(filters))


def test_only_the_bytes_asked_for_are_read(files, monkeypatch):
    read = []

    class Counted:
        def __init__(self, path):
            self.f, self.path = real(path), path

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read(self, *n):
            return self.f.read(*n)

        def tell(self):
            return self.f.tell()

        def read_at(self, n, at):
            read.append((self.path, n))
            return self.f.read_at(n, at)

    real = arrays._open
    monkeypatch.setattr(arrays, "_open", Counted)
    r, left = reader(files, [EqualTo(("month",), 2), In(("node_index",), (1, 2, 7)), GreaterThanOrEqual(("step",), 5), LessThan(("step",), 9), IsNotNull(("flow",)), GreaterThan(("flow",), 0.5)])
    assert left == [GreaterThan(("flow",), 0.5)]
    rows = sum(b.num_rows for p in r.partitions() for b in r.read(p))
    assert rows == 3 * 4 and sum(n for _, n in read) == rows * 12 and {p for p, _ in read} == {files[1][1]}
    read.clear()
    r, _ = reader(files, [])
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 3 * NODES * STEPS and sum(n for _, n in read) == 3 * NODES * STEPS * 12


def test_region_extract_round_trip(spark, files, tmp_path):
    sensors = spark.createDataFrame([(1, "x"), (3, "x"), (5, "y")], "node_index int, county string")
    edges = spark.createDataFrame([(1, 3, 1.0), (1, 5, 1.0)], "src int, dst int, weight double")
    _, traffic, inner = tables.region_extract(sensors, ["x"], arrays.read_arrays(spark, files), edges)
    tables.write_traffic(traffic, str(tmp_path / "t"))
    columns = ["node_index", "month", "step", "ts", "flow", "occupancy", "speed"]
    again = sorted(map(tuple, tables.read_traffic(spark, str(tmp_path / "t"), [1, 3]).select(*columns).collect()))
    assert again == brute(files, lambda m, n, s: n in (1, 3) and m != 2) and inner.count() == 1


def test_other_arrays_raise(tmp_path):
    np.save(tmp_path / "flat.npy", np.zeros((3, 4)))
    with pytest.raises(ValueError, match="isn't an array"):
        arrays.ArrayFile(str(tmp_path / "flat.npy"))
