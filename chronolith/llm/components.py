"""Connected components of an edge table, without collecting any of it.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step is a minimum for each vertex and a
join back, so a vertex with many neighbours is pre-aggregated and its join can be split; no group is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("u"), F.lit(0).alias("v")).union(edges.select(F.col("v").alias("id"), F.lit(0).alias("u"), F.lit(1).alias("v")))
    return ends.groupBy("id").agg(F.sum("u").alias("u"), F.max("v").alias("v")).where("u > 1 or (u = 1 and v = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) for every id of edges (columns a, b, not null); a materialised table."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(now):
        # large star: every larger neighbour gets the least of the neighbourhood
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the vertex itself get the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        discard(now)
        now = new
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
