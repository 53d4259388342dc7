"""A directed multigraph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import dealt

#: Equal parallel edges that are numbered at a time.
BLOCK = 4096


@dataclass(frozen=True)
class Graph:
    """nodes: id LONG, and optionally label, parent, collapsed, classes, attrs, x, y. edges: edge_id, src, dst LONG, weight DOUBLE.

    Parallel edges and loops are allowed; ids may have holes. Handles are immutable: every change gives a new one, so an
    older handle is an undo state. tasks: over how many tasks links are dealt where they are grouped (0: left to Spark).
    """

    nodes: DataFrame
    edges: DataFrame
    tasks: int = 0

    @staticmethod
    def from_edges(edges: DataFrame, nodes: DataFrame | None = None) -> Graph:
        """Edges (src, dst, weight); nodes default to the endpoints.

        An edge's id is a hash of its columns, and for the second and further ones of equal parallel edges of their
        ordinal too, so each has an id of its own that does not depend on the order of rows.
        """
        rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
        if nodes is None:
            nodes = rows.select(F.col("src").alias("id")).union(rows.select("dst")).distinct()
        counted = rows.groupBy("src", "dst", "weight").agg(F.count(F.lit(1)).alias("_n"))
        # Ordinals in blocks, so that no array grows with the number of equal edges.
        last = F.floor((F.col("_n") - 1) / BLOCK)
        in_blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        ends = F.least(F.col("_n") - F.col("_block") * BLOCK, F.lit(BLOCK))
        each = in_blocks.select("src", "dst", "weight", "_block", F.explode(F.sequence(F.lit(0).cast("long"), ends - 1)).alias("_k"))
        ordinal = F.col("_block") * BLOCK + F.col("_k")
        edge_id = F.when(ordinal == 0, F.xxhash64("src", "dst", "weight")).otherwise(F.xxhash64("src", "dst", "weight", ordinal))
        return Graph(nodes, each.select("src", "dst", "weight", edge_id.alias("edge_id")))

    def undirected(self) -> DataFrame:
        """Distinct (src, dst) in both directions, without loops."""
        pairs = self.edges.select("src", "dst")
        return dealt(pairs.union(pairs.select("dst", "src")).where("src <> dst"), 2 * self.tasks, "src", "dst").distinct()

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return replace(self, nodes=nodes)

    def first_edges(self) -> DataFrame:
        """The first physical edge of each directed pair: the one that weight reads and edge predicates see."""
        first = Window.partitionBy("src", "dst").orderBy("edge_id")
        return self.edges.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
