"""Connected components on DataFrames by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtune.llm.frames import saved


def _print(edges: DataFrame) -> tuple:
    """Number of edges and the sum of their whole hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Stars (hi, lo) with lo the smallest node reachable from hi; edges are
    pairs of numbers in columns hi and lo.  Roots and single nodes have no
    row.  A node with many neighbours is pre-aggregated to its minimum, and
    that one row is joined back to its edges."""
    edges = edges.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"),
                                           F.least("hi", "lo").alias("lo")).distinct()
    edges = saved(edges, "edges")
    before = _print(edges)
    while True:
        both = edges.unionAll(edges.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = saved(large.distinct(), "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()
        edges = saved(small, "small-star")
        after = _print(edges)
        if after == before:
            return edges
        before = after
