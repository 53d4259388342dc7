"""Structural edits as new versions of a graph's tables, and the comparison of two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import Graph
from loomgraph.session import materialize


def add_edges(graph: Graph, new: DataFrame) -> Graph:
    """The graph with more edges (src, dst, weight); both ends have to be nodes, others are left out."""
    ids = graph.nodes.select("id")
    known = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph.from_edges(graph.edges.select("src", "dst", "weight").unionByName(known.select("src", "dst", "weight")), graph.nodes)


def remove_nodes(graph: Graph, gone: DataFrame) -> Graph:
    """The graph without some nodes (id) and the edges at them; what they held moves up to their own container."""
    nodes = graph.nodes.join(gone.select("id"), "id", "left_anti")
    if "parent" in nodes.columns:
        up = materialize(graph.nodes.join(gone.select("id"), "id", "left_semi").select(F.col("id").alias("parent"), F.col("parent").alias("above")), "gone-nodes")
        while not up.join(up.select(F.col("parent").alias("above")), "above", "left_semi").isEmpty():  # containers that go together
            next_ = up.select(F.col("parent").alias("above"), F.col("above").alias("beyond"))
            up = materialize(up.join(next_.withColumn("hit", F.lit(True)), "above", "left").select("parent", F.when(F.col("hit"), F.col("beyond")).otherwise(F.col("above")).alias("above")), "gone-nodes")
        nodes = nodes.join(up.withColumn("hit", F.lit(True)), "parent", "left").withColumn("parent", F.when(F.col("hit"), F.col("above")).otherwise(F.col("parent"))).select(*graph.nodes.columns)
    ends = gone.select(F.col("id").alias("src"))
    edges = graph.edges.join(ends, "src", "left_anti").join(ends.withColumnRenamed("src", "dst"), "dst", "left_anti")
    return Graph(nodes, edges.select(*graph.edges.columns))


def remove_edges(graph: Graph, gone: DataFrame) -> Graph:
    """The graph without some edges (edge_id)."""
    return Graph(graph.nodes, graph.edges.join(gone.select("edge_id"), "edge_id", "left_anti").select(*graph.edges.columns))


def reconnect(graph: Graph, moves: DataFrame) -> Graph:
    """The graph with new ends for some edges (edge_id, src, dst; a null end stays); ids and weights stay."""
    new = moves.select("edge_id", F.col("src").alias("to_src"), F.col("dst").alias("to_dst"))
    rows = graph.edges.join(new, "edge_id", "left").withColumn("src", F.coalesce("to_src", "src")).withColumn("dst", F.coalesce("to_dst", "dst"))
    return Graph(graph.nodes, rows.select(*graph.edges.columns))


def sync_report(old: Graph, new: Graph) -> DataFrame:
    """(kind, change, n): nodes and edges, as multisets of (id) and (src, dst, weight), that are added, removed or kept."""

    def compared(a: DataFrame, b: DataFrame, kind: str, *keys: str) -> DataFrame:
        x, y = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("x")), b.groupBy(*keys).agg(F.count(F.lit(1)).alias("y"))
        condition = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
        both = x.alias("x").join(y.alias("y"), condition, "full_outer").select(F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
        sums = both.agg(F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))).alias("removed"), F.sum(F.least("x", "y")).alias("kept"))
        return sums.select(F.lit(kind).alias("kind"), F.explode(F.map_from_arrays(F.array(*map(F.lit, sums.columns)), F.array(*(F.coalesce(c, F.lit(0)) for c in sums.columns)))).alias("change", "n"))

    return compared(old.nodes, new.nodes, "node", "id").union(compared(old.edges, new.edges, "edge", "src", "dst", "weight"))
