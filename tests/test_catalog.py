"""Every catalogue query against its oracle in DuckDB."""

import glob
import os

import duckdb
import pytest

from wayglass.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert rows
    if name not in catalog.ORACLES:
        return
    result = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and len(rows) == 12 * len({(r.incident_id, r.node) for r in rows})  # whole references of 12 steps
