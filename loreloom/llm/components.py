"""Connected components of an edge table with joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _minimum(edges: DataFrame) -> DataFrame:
    """a and the least of its neighbours b; partial aggregation keeps hot vertices small."""
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """vertex, component (its least vertex) for the vertices of undirected edges (a, b).

    Alternating large-star and small-star steps: each links a vertex's neighbours to the
    least of them. A hot vertex's edges may be split over tasks, since no step gathers
    them. Lineage is cut with checkpoint() after each round.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _minimum(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = _minimum(large)
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
        if (now := _state(edges)) == state:
            break
        state = now
    stars = edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
