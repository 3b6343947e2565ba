"""The memory as a stream against the batch form and a model in Python."""

import datetime as dt
import random

import pytest

from wayglass.sources import tables
from wayglass.streaming import memory as M

SCHEMA = "memory_id string, seq long, t timestamp_ntz, state array<double>, facts struct<road:string,hour:int>"
BY = (["memory_id"], "seq", "t")
DAY0 = dt.datetime(2024, 1, 1)


def row(key, seq, day, value=None):
    return (key, seq, None if day is None else DAY0 + dt.timedelta(days=day), [float(seq or 0), 0.5], (f"road {value}", None))


def feed(spark, tmp_path, batches, **options):
    """Run the stream once a batch (each run starts anew from its checkpoint); what lives after each."""
    src, root, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        M.start_memory_stream(stream, root, str(tmp_path / "cp"), *BY, **options).awaitTermination()
        seen.append({(r.memory_id, r.seq): r for r in M.live_rows(spark, root, ["memory_id"]).collect()})
    return root, seen


def model(batches, days):
    """Keys and numbers that live after each batch."""
    live, clock, out = {}, None, []
    for rows in batches:
        rank = lambda s: (s is not None, s or 0)
        for key in {r[0] for r in rows}:
            new = max((r for r in rows if r[0] == key), key=lambda r: rank(r[1]))
            if key not in live or rank(new[1]) > rank(live[key][1]):
                live[key] = new
        clock = max([clock] * (clock is not None) + [r[2] for r in rows if r[2] is not None])
        live = {k: r for k, r in live.items() if r[2] is not None and clock - r[2] <= dt.timedelta(days=days)}
        out.append({(k, r[1]) for k, r in live.items()})
    return out


def test_stream_equals_model_over_restarts(spark, tmp_path):
    rng = random.Random(7)
    batches, seq = [], 0
    for n in range(5):
        rows = []
        for _ in range(25):
            seq += 1
            late = rng.random() < 0.2
            # a third of all rows has one key; some arrive late, some are older than what their key has
            rows.append(row("hot" if rng.random() < 0.33 else f"k{rng.randrange(12)}", seq - 30 if rng.random() < 0.1 else seq, n * 4 + rng.random() * 4 - (12 if late else 0)))
        batches.append(rows)
    root, seen = feed(spark, tmp_path, batches, days=10, every=3)
    assert [set(s) for s in seen] == model(batches, 10)
    assert M._complete(spark, f"{root}/snapshot", "upto") and len(M._complete(spark, f"{root}/changes", "batch")) < 10  # old changes are gone
    values = {r[:2]: r for b in batches for r in b}
    for k, r in seen[-1].items():  # whole rows, nested values and nulls too
        assert (r.t, r.state, r.facts.road, r.facts.hour) == (values[k][2], values[k][3], "road None", None)


def test_stream_equals_the_batch_form(spark, tmp_path):
    batches = [[row("a", 1, 0), row("b", 2, 5)], [row("a", 3, 50), row("c", 4, 95)], [row("b", 5, 96), row("c", 6, 100)]]
    root, _ = feed(spark, tmp_path, batches)
    path = ""
    for n, rows in enumerate(batches):
        out = str(tmp_path / f"v{n}")
        tables.upsert_memory(spark, path, spark.createDataFrame(rows, SCHEMA), out, *BY)
        path = out
    want = {(r.memory_id, r.seq) for r in spark.read.parquet(path).collect()}
    got = M.read_memory(spark, root, *BY)
    assert {(r.memory_id, r.seq) for r in got.collect()} == want == {("a", 3), ("b", 5), ("c", 6)}
    assert {(r.memory_id, r.seq) for r in M.read_memory(spark, root, *BY, keep=1).collect()} == {("c", 6)}


def test_late_rows_missing_times_and_the_edge_of_retention(spark, tmp_path):
    batches = [
        [row("a", 1, 0), row("b", 2, 90), row("n", 3, None), row(None, 4, 80), row("z", None, 85)],
        [row("b", 5, -5), row("z", 6, 86)],  # b's new version is too old: the key goes
        [row("c", 7, 90 + 1 / 86_400)],  # a second later: a goes
    ]
    _, seen = feed(spark, tmp_path, batches)
    assert [set(s) for s in seen] == model(batches, 90)
    assert ("a", 1) in seen[0] and ("b", 2) in seen[0] and not {k for k in seen[1] if k[0] == "b"} and ("a", 1) not in seen[2]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    root, seen = feed(spark, tmp_path, [[row("a", 1, 0), row("b", 2, 1)]])
    written = f"{root}/changes/batch=0"
    rows = spark.read.parquet(written).collect()
    # The source's log of what batch 0 read is kept, its commit is lost: the batch runs again.
    for f in (tmp_path / "cp" / "commits").iterdir():
        f.unlink()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    M.start_memory_stream(stream, root, str(tmp_path / "cp"), *BY).awaitTermination()
    assert sorted(map(repr, spark.read.parquet(written).collect())) == sorted(map(repr, rows))
    assert {(r.memory_id, r.seq) for r in M.live_rows(spark, root, ["memory_id"]).collect()} == set(seen[0])


def test_no_batch_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        M.read_memory(spark, str(tmp_path / "none"), *BY)
