"""Intermediate tables in the folder that the driver and all executors share: they cut lineage, and lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables that this process has written and not dropped.
_made: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session. On a cluster it has to be set; in local mode, where one machine is all, a temporary folder will do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="wayglass-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, tag: str, by: list[str] | None = None) -> DataFrame:
    """Write a frame as a table of the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/wayglass/{tag}-{uuid.uuid4().hex}"
    out = df.write
    if by:
        out = out.partitionBy(*by)
    out.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def n_written() -> int:
    return len(_made)


def drop_written(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables written since there were so many (see `n_written`), but for those that `keep` reads. Frames that read the others end with them."""
    held = keep.inputFiles() if keep is not None else []
    path = spark._jvm.org.apache.hadoop.fs.Path
    for p in _made[since:]:
        if not any(f"/{p.rsplit('/', 1)[1]}/" in f for f in held):
            at = path(p)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _made.remove(p)
