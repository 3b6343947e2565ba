"""Helpers that the corpus operators share: scratch tables in the cluster's shared folder and text keys."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayglass.sources.scratch import drop_written, n_written, scratch_root, written  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java regular expression of the white space that separates words.
BLANK = "[\\x20\\x09-\\x0D]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fitting(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has no more than so many rows, else df as it is. It should be a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship(spark: SparkSession) -> None:
    """Send the library to the executors, once a context, so that their Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_wayglass_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp(prefix="wayglass-")) / "wayglass.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    context.addPyFile(str(name))
    context._wayglass_shipped = True
