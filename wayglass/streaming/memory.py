"""Experience memory as a stream: keyed state holds each key's last version until a timer ends its retention; only changes are written.

A batch writes the changes that it makes (root/changes/batch=n: one row of a key at most, put or gone), so its cost follows the batch and not the memory. Every so many batches the live rows
are written as a snapshot (root/snapshot/upto=n), from which a reader goes on. State is the sequence number and time of a key; the rows themselves are only in the tables.

The clock is the newest time seen so far. A row older than it by more than the retention goes when the clock has passed it; if it arrives that late, it takes its key's earlier version with it,
as an upsert followed by a prune does. A row without a time never lives; one without a sequence number is older than all that have one. Of equal numbers the first to arrive stays.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from wayglass.operators.memory import KEEP, RETENTION_DAYS, prune

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Batches between two snapshots.
SNAPSHOT_EVERY = 20


class LastVersions(StatefulProcessor):
    """The last version of each key. Rows have __seq and __until (milliseconds, the first at which the row is too old; null: at once); gives rows with __put."""

    def __init__(self, columns: list[str], key: list[str]):
        self.columns, self.key = columns, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, until long")

    def _change(self, put: bool, key: tuple, row: Row | None) -> Row:
        own = dict(zip(self.key, key, strict=True))
        return Row(*self.columns, "__put")(*[row[c] if row is not None else own.get(c) for c in self.columns], put)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        rank = lambda seq: (seq is not None, seq or 0)
        old = self.last.get() if self.last.exists() else None
        held = old is not None
        if held and old[1] <= now:  # its timer is due
            old = None
        new = None
        for row in rows:
            if new is None or rank(row["__seq"]) > rank(new["__seq"]):
                new = row
        if new is None or (old is not None and rank(old[0]) >= rank(new["__seq"])):
            return
        if held:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        until = new["__until"]
        if until is None or until <= now:
            self.last.clear()
            if held:
                yield self._change(False, key, None)
            return
        self.last.update((new["__seq"], until))
        self.handle.registerTimer(until)
        yield self._change(True, key, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield self._change(False, key, None)

    def close(self) -> None:
        pass


def memory_changes(appends: DataFrame, key: list[str], seq: str, time: str, days: int = RETENTION_DAYS) -> DataFrame:
    """appends' columns and __put: the version that a key now has, or (with nulls but for the key) that it has none any more.

    The delay of the watermark is the retention: it stands at the oldest time that may live, and timers are set to the rows' own times. The watermark's column is
    dropped before the state, so late rows reach it and are judged there.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    timed = appends.withColumn("__clock", F.col(time).cast("timestamp")).withWatermark("__clock", f"{days} days").drop("__clock")
    timed = timed.withColumn("__seq", F.col(seq).cast("long")).withColumn("__until", F.ceil(micros / 1000) + 1)
    out = StructType([*appends.schema.fields, StructField("__put", BooleanType())])
    return timed.groupBy(*key).transformWithState(LastVersions(appends.columns, key), out, "Update", "EventTime")


def _complete(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the tables folder/name=n that are written to the end, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(folder)):
        return []
    found = [s.getPath() for s in fs.listStatus(path(folder))]
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith(f"{name}=") and fs.exists(path(p, "_SUCCESS")))


def live_rows(spark: SparkSession, root: str, key: list[str], upto: int | None = None) -> DataFrame | None:
    """The rows that live after batch `upto` (the last one): the last snapshot, and the changes since. None before the first batch."""
    snapshots = [n for n in _complete(spark, f"{root}/snapshot", "upto") if upto is None or n <= upto]
    base = snapshots[-1] if snapshots else -1
    batches = [n for n in _complete(spark, f"{root}/changes", "batch") if n > base and (upto is None or n <= upto)]
    parts = []
    if snapshots:
        parts.append(spark.read.parquet(f"{root}/snapshot/upto={base}").withColumn("__put", F.lit(True)).withColumn("__batch", F.lit(base)))
    for n in batches:  # at most SNAPSHOT_EVERY
        parts.append(spark.read.parquet(f"{root}/changes/batch={n}").withColumn("__batch", F.lit(n)))
    if not parts:
        return None
    log = parts[0]
    for p in parts[1:]:
        log = log.unionByName(p)
    last = log.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]).agg(F.max_by(F.struct(*log.columns), "__batch").alias("__last"))
    return last.select("__last.*").where("__put").drop("__put", "__batch")


def read_memory(spark: SparkSession, root: str, key: list[str], seq: str, time: str, days: int = RETENTION_DAYS, keep: int = KEEP) -> DataFrame:
    """The memory: its live rows within the retention, the newest `keep` of them (a top-k report)."""
    rows = live_rows(spark, root, key)
    if rows is None:
        raise FileNotFoundError(f"no batch has been written under {root}")
    return prune(rows, time, seq, days, keep)


def start_memory_stream(appends: DataFrame, root: str, checkpoint: str, key: list[str], seq: str, time: str, days: int = RETENTION_DAYS, every: int = SNAPSHOT_EVERY, trigger: dict | None = None) -> StreamingQuery:
    """Run the memory over a stream of appends. A repeated batch overwrites its own changes and nothing else."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch={n}")
        done = _complete(spark, f"{root}/snapshot", "upto")
        if n - (done[-1] if done else -1) < every:
            return
        live_rows(spark, root, key, n).write.mode("overwrite").parquet(f"{root}/snapshot/upto={n}")
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        # What the snapshot before the last one stands for; a reader that began with the last one still finds its changes.
        old = [f"{root}/snapshot/upto={k}" for k in done[:-1]] + [f"{root}/changes/batch={k}" for k in _complete(spark, f"{root}/changes", "batch") if done and k <= done[-1]]
        for p in old:
            fs.delete(path(p), True)

    spark = appends.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # timers need it; the query keeps the setting that it started with
    try:
        changes = memory_changes(appends, key, seq, time, days)
        return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(PROVIDER, before)
