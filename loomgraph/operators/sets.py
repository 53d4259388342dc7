"""Set algebra on ids (one column) and on pairs (src, dst); parallels merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_anti")


def complement(a: DataFrame, universe: DataFrame) -> DataFrame:
    """What the visible universe has beyond a."""
    return difference(universe.select(*a.columns), a)


def neighborhood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): the seeds and what one edge in either direction reaches from them."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    near = both.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return seeds.select("id").union(near).distinct()


def induced_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the members."""
    return edges.join(members.select(F.col("id").alias("src")), "src", "left_semi").join(members.select(F.col("id").alias("dst")), "dst", "left_semi")
