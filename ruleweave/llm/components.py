"""Connected components of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, cut


def _large(edges: DataFrame, few: bool) -> DataFrame:
    """Links every neighbour above a node to the least node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).toDF("u", "v")
    least = _sent(few, both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, few: bool) -> DataFrame:
    """Links a node and its neighbours below to the least of them."""
    least = _sent(few, edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m"))
    joined = edges.join(least, F.col("u") == F.col("w"))
    return joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v")


def _sent(few: bool, least: DataFrame) -> DataFrame:
    return F.broadcast(least) if few else least


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for every node that a link (x, y) names.

    Each round is two aggregations and joins on the links, written to the shared
    folder; the rounds end when the links have become stars.  Nothing but a count
    and a checksum comes to the driver.  The least neighbours are broadcast while the
    counted links show that they are few; else AQE splits the join at a hot root.
    """
    edges = cut(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "stars")
    before = (edges.count(), None)
    while True:
        few = before[0] <= BROADCAST_ROWS
        edges = cut(_small(_large(edges, few), few).distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        before = now
