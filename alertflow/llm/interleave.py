"""Shards that all match the mixture of sources: stratified interleaving.

Rows are put in a seeded random order within their source.  Row r (from 0) of
a source with n rows has the fraction (2r + 1) / 2n; all rows sorted by
fraction are an even interleaving of the sources, and cutting that order into
equal parts gives every shard its share of every source.  Row counts of
shards differ by one at most (the ``rows`` law).

Ranks never need one source (or everything) in one task.  Order keys are
uniform, so rows fall into buckets of a bounded size by the top bits of their
key; a rank is the number of rows in the buckets before (a running sum over
the small table of bucket counts) plus the row number inside the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 24
SEED = 42
BUCKET_ROWS = 4_096  # rows ranked together in one window partition
KEY_BITS = 30
FILE_ROWS = 50_000   # rows of a shard that one task writes as one file


def _bucket(key_fraction: Column, buckets: int) -> Column:
    return F.least(F.floor(key_fraction * buckets), F.lit(buckets - 1)).cast("int")


def _before(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Running count of the earlier buckets, per value of ``keys``; one row a bucket."""
    w = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def interleave(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, seed: int = SEED,
               bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus 8 (null text: 8), ``slot`` runs
    without gaps from 0 in each shard.  A null source is a source of its own;
    null ids and repeated rows are placed like any other row (repeated rows
    rank by their place in the scan; it also spreads rows without an id).  An
    empty table gives an empty result; extra columns are ignored.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    narrow = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source"),
        (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    # tells only equal rows apart, and rows without an id
    place = F.monotonically_increasing_id()
    key = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), place)).otherwise(key)
    rows = stored(spark, narrow.withColumns({"key": spread.bitwiseAND(F.lit(2**63 - 1)), "place": place}),
                  "shard-rows")

    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    top = F.shiftright("key", 63 - KEY_BITS) / F.lit(float(1 << KEY_BITS))
    rows = rows.withColumn("bucket", _bucket(top, buckets))
    counts = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = Window.partitionBy("source")
    starts = stored(spark, _before(counts, ["source"]).withColumn(
        "source_rows", F.sum("n").over(sizes)).drop("n"), "shard-source-starts")
    inside = F.row_number().over(Window.partitionBy("bucket", "source").orderBy("key", "doc_id", "place"))
    ranked = (rows.withColumn("inside", inside).join(starts, ["source", "bucket"])
              .withColumn("fraction", (2 * (F.col("before") + F.col("inside")) - 1) / (2.0 * F.col("source_rows")))
              .select("doc_id", "source", "size", "text_crc32", "key", "place", "fraction"))
    ranked = stored(spark, ranked.withColumn("bucket", _bucket(F.col("fraction"), buckets)), "shard-ranked")

    counts = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = _before(counts, []).drop("n")
    inside = F.row_number().over(
        Window.partitionBy("bucket").orderBy("fraction", "source", "key", "doc_id", "place"))
    total = max(total, 1)
    # the first position of a shard is the smallest p with p * shards div total = shard
    return (ranked.withColumn("inside", inside).join(starts, "bucket")
            .withColumn("position", F.col("before") + F.col("inside") - 1)
            .withColumn("shard", F.expr(f"position * {shards} div {total}").cast("int"))
            .withColumn("slot", F.col("position") - F.expr(
                f"(cast(shard as long) * {total} + {shards - 1}) div {shards}").cast("long"))
            .select("doc_id", F.when(F.col("source") != "", F.expr("substring(source, 2)")).alias("source"),
                    "size", "text_crc32", "shard", "slot"))


def _numbered(rows: DataFrame, unique: list[str], buckets: int) -> DataFrame:
    """``rows`` with ``nth``, from 1 on among rows with the same ``same``; a
    value that many rows share is numbered bucket by bucket."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*unique), F.lit(buckets)))
    starts = _before(rows.groupBy("same", "bucket").agg(F.count(F.lit(1)).alias("n")), ["same"]).drop("n")
    inside = F.row_number().over(Window.partitionBy("same", "bucket").orderBy(*unique))
    return (rows.withColumn("inside", inside).join(starts, ["same", "bucket"])
            .withColumn("nth", F.col("before") + F.col("inside")).drop("bucket", "before", "inside"))


def write_shards(placed: DataFrame, docs: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write the rows of ``docs`` once each, as one folder per shard.

    ``placed`` is what ``interleave`` made of ``docs``.  The n-th row of an id,
    source, size and checksum takes the n-th place of the same, so null ids and
    repeated rows are written like any other.  A shard is files of
    ``file_rows`` rows; in order of their names they hold the slots in order.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    same = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                    (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = stored(spark, docs.select(F.struct("*").alias("row"), same.alias("same"),
                                     F.monotonically_increasing_id().alias("place")), "shard-texts")
    spots = stored(spark, placed.select(F.struct("doc_id", "source", "size", "text_crc32").alias("same"),
                                        "shard", "slot"), "shard-places")
    total, last_shard, last_slot = spots.agg(F.count(F.lit(1)), F.max("shard"), F.max("slot")).first()
    buckets = max(1, -(-total // BUCKET_ROWS))
    files = (last_slot or 0) // file_rows + 1
    matched = (_numbered(rows, ["place"], buckets).join(_numbered(spots, ["shard", "slot"], buckets), ["same", "nth"])
               .select("row.*", "shard", "slot"))
    file = F.col("shard") * files + F.floor(F.col("slot") / file_rows).cast("int")
    (matched.repartitionById(((last_shard or 0) + 1) * files, file.cast("int"))
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
