"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored


def _minima(links: DataFrame) -> DataFrame:
    """Smallest neighbour of each node (itself included)."""
    return (links.groupBy("u").agg(F.min("v").alias("low"))
            .select("u", F.least("u", "low").alias("low")))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``links(u, v)`` -> ``(node, root)``: root is the smallest node reachable.

    Large-star: every larger neighbour of a node links to the node's smallest
    neighbour.  Small-star: the node and its smaller neighbours link to the
    smallest of them.  Both keep the components and turn each into one star;
    the number of rounds is logarithmic in practice.  Every round is written
    to the shared work folder.  Only minima per node are aggregated (combined
    before the shuffle), so a node with very many links is no hot task.
    """
    links = stored(spark, links.where("u <> v").distinct(), "links")
    state = None
    while True:
        both = _both_ways(links)
        large = (both.join(_minima(both), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .where("u <> v").distinct())
        large = stored(spark, large, "large-star")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = _minima(down)
        small = (down.join(low, "u")
                 .select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .unionByName(low.select("u", F.col("low").alias("v")))
                 .where("u <> v").distinct())
        links = stored(spark, small, "small-star")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return (links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")))
            .distinct())
