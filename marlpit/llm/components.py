"""Connected components by alternating large-star and small-star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlpit.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").where("v > m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of these."""
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(low, "b")
    turned = joined.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return turned.union(low.select(F.col("m").alias("a"), F.col("b"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a long, b long) -> (id long, component long): every node of an edge with the smallest node it reaches.

    Self loops, nulls and repeated or reversed edges are harmless; no edges give no rows. Each round reads and writes
    tables of at most as many rows as there are edges, aggregated before they are shuffled; no neighbourhood is ever
    gathered. The number of rounds grows with the logarithm of the longest chain."""
    now = scratch.save(
        edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct(), "edges"
    )
    mark = None
    while True:
        new = scratch.save(_small_star(_large_star(now)), "star")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select("a", "a").distinct())
