"""Connected components by alternating star contractions; nothing leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _settled(edges: DataFrame) -> bool:
    """True when every upper end has one lower end, and no lower end is an upper one: the edges are roots' stars."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
    return ends.where("up > 1 OR (up > 0 AND low > 0)").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` of every node with a link: root is the smallest node reachable.

    Each round lets every node send its neighbours to the smallest of them (large star, then
    small star), until the edges are stars.  Minima are pre-aggregated and written, so that a node with very
    many links is a skewed join side that adaptive execution can split.  NULL and self links are ignored.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = written(ends.where("u <> v").distinct(), "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
