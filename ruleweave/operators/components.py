"""Connected components of equality links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import write


def components(links: DataFrame, rank: Callable[[Column], Column] | None = None) -> DataFrame | None:
    """node, root for each node of links (x, y) that is not its component's least by `rank`; None without links.

    Large-star and small-star rounds on written tables, until the links are stars.
    """
    spark = links.sparkSession
    key = rank or (lambda c: F.struct(c.alias("term")))
    edges = links.where("x <> y").select(key(F.col("x")).alias("a"), key(F.col("y")).alias("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        star = large.join(low, F.col("u") == F.col("w"))
        small = star.select("u", F.col("m").alias("v")).union(star.select("v", "m")).toDF("u", "v").where("u > v").distinct()
        edges = spark.read.schema(edges.schema).parquet(write(small, "stars"))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not now[0]:
            return None
        if now == before:
            return edges.select(F.col("u.term").alias("node"), F.col("v.term").alias("root"))
        before = now
