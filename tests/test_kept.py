"""Tables kept between runs, and references brought up to date."""

import random

import pytest
from pyspark.sql import functions as F

from wayglass import schema as S
from wayglass.operators import counterfactual as N
from wayglass.operators import timeseries as TS
from wayglass.plans import catalog
from wayglass.sources.registry import Registry
from wayglass.sources.scratch import written
from wayglass.sources.tables import exists

DATA = "/root/testdata/sf0.001"


def test_a_second_run_builds_nothing(spark, tmp_path):
    root = str(tmp_path / "kept")
    first, second = Registry(spark, root), Registry(spark, root)
    wanted = sorted(map(tuple, catalog.kept_references(spark, DATA, first).collect()))
    found = sorted(map(tuple, catalog.kept_references(spark, DATA, second).collect()))
    assert wanted and found == wanted and first.built == ["features", "selections", "references"] and first.reused == []
    assert second.built == [] and second.reused == ["features", "selections", "references"]


def test_keys_follow_contents_alone(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "kept"))
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id long, t string")
    made = lambda x, n=1, **p: registry.table("t", {"x": x}, lambda: x.withColumn("n", F.lit(n)), p)[1]
    key = made(df)
    assert made(df.repartition(7).orderBy(F.desc("id"))) == key and registry.built == ["t"]
    assert len({key, made(df, k=2), made(df.where("id > 0")), made(df.withColumn("t", F.when(F.col("id") == 3, "else").otherwise(F.col("t")))), made(df.unionByName(df.limit(1))), registry.table("t", {"x": key}, lambda: df)[1]}) == 6


def test_broken_builds_leave_no_table(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "kept"))
    df = spark.range(5)

    def broken():
        raise OSError("lost")

    with pytest.raises(OSError):
        registry.table("t", {"x": df}, broken)
    assert registry.table("t", {"x": df}, lambda: df)[0].count() == 5 and registry.built == ["t"]


def test_tables_are_dropped_when_nobody_holds_them(spark, tmp_path):
    root = str(tmp_path / "kept")
    one, two, df = Registry(spark, root, "one"), Registry(spark, root, "two"), spark.range(3)
    _, shared = one.table("t", {"x": df}, lambda: df)
    two.table("t", {"x": df}, lambda: df)
    _, own = one.table("t", {"x": df}, lambda: df, {"k": 1})
    one.release()
    assert one.drop_unheld() == [f"t/{own}"] and exists(spark, f"{root}/t/{shared}/note.json")
    two.release()
    assert two.drop_unheld() == [f"t/{shared}"] and two.drop_unheld() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_append_then_update_equals_rebuild(spark, seed):
    rnd = random.Random(seed)
    grid = S.grid(spark, DATA).where("node in ('click', 'view')")
    windows = written(TS.with_features(TS.windows(grid)), "features")
    rows = [(i, rnd.randint(150, 700), rnd.choice([None, 30, 90, 600])) for i in range(24)]
    incidents = spark.createDataFrame(rows, "incident_id long, step long, duration_minutes long").withColumn("dt", TS.step_time(F.col("step")))
    routes = spark.createDataFrame([(i, node, rnd.uniform(0, 8)) for i in range(24) for node in ("click", "view")], "incident_id long, node string, km double")
    old, new = incidents.where("incident_id < 18"), incidents.where("incident_id >= 18")
    columns = ["incident_id", "node", "query_step", "step", "score", "rank"]
    rebuilt = sorted(map(tuple, N.normal_counterfactual(windows, incidents, routes, k=4, least=0.0).select(*columns).collect()))
    before = N.normal_counterfactual(windows, old, routes, k=4, least=0.0)
    updated = sorted(map(tuple, N.update_counterfactual(before, windows, old, new, routes, k=4, least=0.0).select(*columns).collect()))
    assert updated == rebuilt and len({r[0] for r in rebuilt}) > 12
