"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewatch.llm.common import cut, drop


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges ``(a, b)``, a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    large = edges_of(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a")
    return edges_of(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))


def edges_of(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: each ``a`` has one ``b``, which has none itself."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 or up + down > 1").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; root is the smallest node that it can reach.

    Each round is a few joins and aggregates on nodes and its result is written, so that lineage stays short.
    """
    edges = cut(edges_of(edges), "edges")
    for _ in range(most_rounds):
        if _settled(edges):
            break
        last, edges = edges, cut(_stars(edges), "stars")
        drop(last)
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
