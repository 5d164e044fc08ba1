"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_work_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rows per Arrow batch: texts can be long, so a batch holds few of them.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, as Spark reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a Python worker holds few long texts; the
    package goes to the executors the way Spark ships Python files."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        # only the driver reads this folder; Spark serves the file to executors
        to = Path(tempfile.mkdtemp(prefix="alertflow-py-")) / package.name
        spark.sparkContext.addPyFile(shutil.make_archive(str(to), "zip", package.parent, package.name))
        _SHIPPED.add(app)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back.

    Cuts the lineage: a lost executor costs at most the stage that was
    running, and steps that use the table twice do not compute it twice.
    """
    path = new_work_dir(spark, f"llm-{name}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column | str) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: Column | str) -> Column:
    """Identity of a text: 128-bit digest, '' for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.md5(c.cast("binary")), F.lit(""))


def bounded_sample(rows: DataFrame, key: str, wanted: int, total: int, seed: int) -> DataFrame:
    """About ``0.95 * wanted`` of ``total`` rows (all, if they are no more than
    ``wanted``), by a seeded hash of ``key``: no sort, the same rows each time,
    and ``wanted`` lies many standard deviations away for samples of thousands."""
    if total <= wanted:
        return rows
    span = 1 << 30
    return rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(span)) < int(span * 0.95 * wanted / total))


def batches(it: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each Arrow batch as Python lists."""
    for b in it:
        yield tuple(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns)
