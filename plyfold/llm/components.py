"""Connected components by alternating large-star and small-star rounds, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge (u, v longs); the component is its smallest node.

    Self-loops and repeated edges are harmless; no edges give no rows. Each round is a table in the shared folder; rounds grow
    with the logarithm of the longest chain. A node with very many edges is one pre-aggregated row on one side of the join,
    whose other side is split by adaptive execution.
    """
    now, seen = materialize(edges.filter("u <> v"), "edges"), None
    while True:
        star = materialize(_small_star(_large_star(now)), "star")
        size = star.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        mark = (size.n, size.s)
        discard(now)
        now = star
        if mark == seen or size.n == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
