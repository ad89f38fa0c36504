"""Connected components of an edge table by alternating large and small stars.

Every round replaces edges by edges to the smallest neighbour, so the graph becomes a forest of stars in a logarithmic
number of rounds in practice. A round uses grouped minima and joins only; no neighbourhood is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import join_back, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: integers); the component is its smallest node.

    Loops, repeated and reversed edges and null ends do not matter; nodes only met in them are not returned. The edges of a node with
    very many neighbours meet its minimum by a broadcast of the few such nodes (``join_back``).
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    pairs = materialize(pairs.distinct(), "edges")
    while not _are_stars(pairs):
        total = pairs.count()
        larger = materialize(_large_star(pairs, 2 * total), "edges")
        pairs = materialize(_small_star(larger, total).distinct(), "edges")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every larger end has one edge and no smaller end is a larger one: then smaller ends are their components' smallest nodes."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("larger"), F.lit(0).alias("smaller")).union(pairs.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("larger").alias("l"), F.max("smaller").alias("s")).where("l > 1 OR l > 0 AND s > 0").isEmpty()


def _large_star(pairs: DataFrame, total: int) -> DataFrame:
    """Larger neighbours of every node, joined to its smallest one (or itself)."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0")
    return join_back(pairs.select(F.col("v").alias("u"), F.col("u").alias("w")), least, "u", total=total).select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame, total: int) -> DataFrame:
    """Smaller neighbours of every node, and itself, joined to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_back(pairs, least, "u", total=total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m"))
