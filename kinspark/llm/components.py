"""Connected components by alternating large and small stars, each round a few joins over the links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, stored


def written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and their count and order-free hash sum, taken as they are written: two numbers tell whether a round changed anything."""
    seen = Observation()
    told = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    out = stored(told, "links")
    return out, (seen.get["n"], seen.get["sum"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node reachable. Nodes that are their own root are left out.

    ``min`` is pre-aggregated before each shuffle, so a node with very many links is
    no hot spot there, and the joins have one row a key on one side, so a skewed
    one can be split. Every round is written to the shared folder, and the round before it removed.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, seen = written(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = edges
        edges, now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
