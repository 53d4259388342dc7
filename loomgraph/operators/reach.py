"""Fixpoints over edges: levels, closures, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import counted, materialize


class NegativeCycle(ValueError):
    """A cycle of negative weight; `node_id` is on it or reached through it."""

    def __init__(self, node_id: int):
        super().__init__(f"negative cycle at node {node_id}")
        self.node_id = node_id


def hop_levels(edges: DataFrame, sources: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(source, id, level): hops along edges from every source (id); a source has level 0 with itself.

    Each round joins the frontier alone with the edges and drops what is known; rounds are the longest distance.
    """
    links = materialize(edges.select("src", "dst").distinct(), "hop-links")
    frontier = materialize(sources.select(F.col("id").alias("source"), F.col("id").alias("id"), F.lit(0).alias("level")).distinct(), "hop-frontier")
    seen = frontier
    for level in range(1, max_rounds + 1):
        reached = frontier.join(links, frontier.id == links.src).select("source", F.col("dst").alias("id")).distinct()
        fresh, n = counted(reached.join(seen, ["source", "id"], "left_anti").withColumn("level", F.lit(level)), "hop-frontier")
        if not n:
            return seen
        frontier, seen = fresh, seen.unionByName(fresh)
        if level % 8 == 0:
            seen = materialize(seen, "hop-levels")
    raise RuntimeError(f"levels did not end in {max_rounds} rounds")


def successors_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): what is reached from the seeds by one edge or more; a seed only if it is reached again."""
    first = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return hop_levels(edges, first).select("id").distinct()


def predecessors_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return successors_closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds)


def reach_pairs(edges: DataFrame) -> DataFrame:
    """(src, dst) with a path of one edge or more, for all pairs, by doubling: rounds are the logarithm of the longest path."""
    pairs = materialize(edges.select("src", "dst").distinct(), "reach")
    count = pairs.count()
    while True:
        a, b = pairs.alias("a"), pairs.alias("b")
        longer = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        pairs = materialize(pairs.union(longer).distinct(), "reach")
        grown = pairs.count()
        if grown == count:
            return pairs
        count = grown


def distances(edges: DataFrame, sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, id, dist): least weight of a path from each source; unreachable nodes have no row.

    Weights may be negative. A negative cycle that a source reaches raises NegativeCycle. Only rows that changed are
    joined in the next round.
    """
    links = materialize(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "path-links")
    state = materialize(sources.select(F.col("id").alias("source"), F.col("id").alias("id"), F.lit(0.0).alias("dist"), F.lit(True).alias("new")), "distances")
    limit = nodes.count() + 1
    for _ in range(limit):
        moved = state.where("new").join(links, F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("weight")).alias("via"))
        merged = state.drop("new").join(moved, ["source", "id"], "full_outer")
        better = F.col("via").isNotNull() & (F.col("dist").isNull() | (F.col("via") < F.col("dist")))
        state = materialize(merged.select("source", "id", F.when(better, F.col("via")).otherwise(F.col("dist")).alias("dist"), better.alias("new")), "distances")
        if not state.where("new").limit(1).count():
            return state.select("source", "id", "dist")
    raise NegativeCycle(state.where("new").agg(F.min("id")).first()[0])


def kth_walk_costs(edges: DataFrame, start: int, k: int, nodes: DataFrame) -> DataFrame:
    """(id, dist): the weight of the k-th cheapest walk from start to each node; fewer than k walks: no row."""
    from pyspark.sql import Window

    spark = edges.sparkSession
    order = Window.partitionBy("id").orderBy("dist")
    seed = spark.createDataFrame([(start, 0.0)], "id long, dist double").join(nodes.select("id"), "id", "left_semi")
    links = materialize(edges.select("src", "dst", "weight"), "walk-links")
    state, before = materialize(seed.withColumn("place", F.lit(1)), "walks"), None
    for _ in range(100_000):
        walks = seed.union(state.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("dist") + F.col("weight")).alias("dist")))
        state = materialize(walks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k), "walks")
        if before is not None and state.count() == before.count() and state.exceptAll(before).isEmpty():
            return state.where(F.col("place") == k).select("id", "dist")
        before = state
    raise RuntimeError("walks did not settle")


def shortest_path_tree(edges: DataFrame, sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, id, dist, parent): least weights, and the node before each on one cheapest path; a source has none.

    Of several such nodes the smallest id counts. Where edges of weight 0 close a circle, nodes on it may name each other.
    """
    dist = materialize(distances(edges, sources, nodes), "tree-distances")
    before = dist.select("source", F.col("id").alias("src"), F.col("dist").alias("d"))
    steps = before.join(edges.select("src", "dst", "weight"), "src").select("source", F.col("dst").alias("id"), (F.col("d") + F.col("weight")).alias("dist"), "src")
    parents = steps.join(dist, ["source", "id", "dist"]).where("id <> source").groupBy("source", "id").agg(F.min("src").alias("parent"))
    return dist.join(parents, ["source", "id"], "left")


def tree_paths(tree: DataFrame) -> DataFrame:
    """(source, id, path): the nodes from the source to each node of a tree, by joining each round's paths with their next nodes."""
    links = materialize(tree.where("parent IS NOT NULL").select("source", F.col("parent").alias("at"), F.col("id").alias("next")), "tree-links")
    front = materialize(tree.where("id = source").select("source", F.col("id").alias("at"), F.array("id").alias("path")), "tree-paths")
    out = front
    while True:
        front = materialize(front.join(links, ["source", "at"]).where(~F.array_contains("path", F.col("next"))).select("source", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path")), "tree-paths")
        if front.isEmpty():
            return out.select("source", F.col("at").alias("id"), "path")
        out = out.union(front)


def negative_cycle(edges: DataFrame, source: int, nodes: DataFrame) -> list[int]:
    """The nodes of one cycle of negative weight that the source reaches, its first node not repeated; none: empty.

    Walks of one edge more each round keep their least weights with the nodes they passed. A walk that comes back to a
    node with less than it had there has gone around such a cycle; without one, walks end after as many rounds as nodes.
    """
    links = materialize(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "cycle-links")
    state = materialize(nodes.where(F.col("id") == source).select("id", F.lit(0.0).alias("dist"), F.array("id").alias("path"), F.lit(True).alias("new")), "cycle-walks")
    for _ in range(nodes.count() + 1):
        longer = F.struct((F.col("dist") + F.col("weight")).alias("via"), "path")
        moved = state.where("new").join(links, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min(longer).alias("m"))
        better = F.col("m").isNotNull() & (F.col("dist").isNull() | (F.col("m.via") < F.col("dist")))
        rows = state.drop("new").join(moved, "id", "full_outer")
        state = materialize(rows.select("id", F.when(better, F.col("m.via")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.concat("m.path", F.array("id"))).otherwise(F.col("path")).alias("path"), better.alias("new")), "cycle-walks")
        if state.where("new").isEmpty():
            return []
        back = state.where("new").where(F.array_position("path", F.col("id")) < F.size("path")).orderBy("id").first()
        if back:
            return back.path[back.path.index(back.id) : -1]
    return []
