"""A data source for dense monthly arrays [node, step, channel] in NumPy's file format: partitions of nodes, with filters on month, node and step pushed to the source, so only the bytes of what is asked for are read.

Files are opened through pyarrow's file systems (local, HDFS, S3, GCS), read by ranges, and never loaded whole; a path without a scheme is local. Each node's series is contiguous in a file, so a partition is
one range a run of nodes, or a range a node where steps are restricted.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from wayglass.schema import TRAFFIC

#: Nodes of a partition, and bytes that a task reads at a time.
NODES, READ_BYTES = 64, 8 << 20
PUSHED = ("month", "node_index", "step")


def _open(path: str) -> pa.NativeFile:
    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return where.open_input_file(name)


class ArrayFile:
    """Shape, type and place of the values of a file; ranges of nodes and steps of it."""

    def __init__(self, path: str):
        self.path = path
        with _open(path) as f:
            version = np.lib.format.read_magic(f)
            self.shape, by_column, self.dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            self.first = f.tell()
        if len(self.shape) != 3 or self.shape[2] != 3 or by_column:
            raise ValueError(f"{path} isn't an array [node, step, 3] in row order: {self.shape}")

    def read(self, nodes: range, steps: range) -> Iterator[tuple[int, np.ndarray]]:
        """(first node, values [nodes, steps, 3]) of consecutive nodes, a few at a time."""
        a_step = 3 * self.dtype.itemsize
        a_node = self.shape[1] * a_step
        whole = len(steps) == self.shape[1]
        at_once = max(1, READ_BYTES // a_node) if whole else 1
        with _open(self.path) as f:
            for node in range(nodes.start, nodes.stop, at_once):
                n = min(at_once, nodes.stop - node)
                raw = f.read_at(n * a_node if whole else len(steps) * a_step, self.first + node * a_node + steps.start * a_step)
                yield node, np.frombuffer(raw, self.dtype).reshape(n, len(steps), 3)


@dataclass
class Block(InputPartition):
    path: str
    month: int
    start: str
    runs: list[tuple[int, int]]
    steps: tuple[int, int]

    def __init__(self, path: str, month: int, start: str, runs: list[tuple[int, int]], steps: tuple[int, int]):
        super().__init__((path, month, runs, steps))
        self.path, self.month, self.start, self.runs, self.steps = path, month, start, runs, steps


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])  # [month, path, start]
        self.minutes, self.nodes = int(options.get("minutes", 5)), int(options.get("nodes", NODES))
        self.tests: dict[str, list] = {c: [] for c in PUSHED}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of month, node_index and step with numbers are taken, and no value is ever null; all other filters go back to Spark."""
        for f in filters:
            if isinstance(f, IsNotNull):
                continue
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in PUSHED and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.tests[column].append(f)
            else:
                yield f

    def _fits(self, column: str, x: int) -> bool:
        def one(f: Filter) -> bool:
            if isinstance(f, EqualTo):
                return x == f.value
            if isinstance(f, In):
                return x in f.value
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                return x > f.value or (isinstance(f, GreaterThanOrEqual) and x == f.value)
            return x < f.value or (isinstance(f, LessThanOrEqual) and x == f.value)

        return all(map(one, self.tests[column]))

    def _runs(self, column: str, n: range) -> list[tuple[int, int]]:
        """Runs of consecutive numbers that fit."""
        out: list[tuple[int, int]] = []
        for x in n:
            if self._fits(column, x):
                if out and out[-1][1] == x:
                    out[-1] = (out[-1][0], x + 1)
                else:
                    out.append((x, x + 1))
        return out

    def partitions(self) -> list[Block]:
        out = []
        for month, path, start in self.files:
            if not self._fits("month", month):
                continue  # not even its head is read
            n_nodes, n_steps, _ = ArrayFile(path).shape
            for steps in self._runs("step", range(n_steps)):
                for first in range(0, n_nodes, self.nodes):
                    if runs := self._runs("node_index", range(first, min(first + self.nodes, n_nodes))):
                        out.append(Block(path, month, start, runs, steps))
        return out or [Block("", 0, "", [], (0, 0))]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if not block.runs:
            return
        source, steps = ArrayFile(block.path), range(*block.steps)
        start = np.datetime64(datetime.fromisoformat(block.start), "us")
        ts = start + np.arange(steps.start, steps.stop) * np.timedelta64(self.minutes * 60_000_000, "us")
        for run in block.runs:
            for first, values in source.read(range(*run), steps):
                n = len(values)
                columns = [np.repeat(np.arange(first, first + n, dtype=np.int32), len(steps)), np.full(n * len(steps), block.month, np.int32), np.tile(np.arange(steps.start, steps.stop, dtype=np.int32), n), np.tile(ts, n)]
                columns += [values[:, :, c].astype(float).ravel() for c in range(3)]
                kinds = [pa.int32()] * 3 + [pa.timestamp("us")] + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["node_index", "month", "step", "ts", "flow", "occupancy", "speed"])


class DenseArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dense_arrays"

    def schema(self) -> str:
        return TRAFFIC

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(dict(self.options))


def read_arrays(spark: SparkSession, files: list[tuple[int, str, str]], minutes: int = 5, nodes: int = NODES) -> DataFrame:
    """The traffic table of (month, path, start of the month as ISO text) files. Filters reach Python sources only where the session allows it, so this turns it on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DenseArrays)
    return spark.read.format("dense_arrays").options(files=json.dumps([list(f) for f in files]), minutes=minutes, nodes=nodes).load()
