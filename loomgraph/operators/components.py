"""Connected components of an undirected reading of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import Rounds, dealt


def _ends(pointers: DataFrame) -> DataFrame:
    """(id, to): where following the pointers (id, to) ends; every pointer leads to a smaller id."""
    rounds, moved = Rounds("component-pointers"), 1
    state = rounds.put(pointers)
    while moved:
        jump = state.select(F.col("id").alias("to"), F.col("to").alias("beyond"))
        after = state.join(jump, "to", "left").select("id", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved"))
        table, moved = rounds.counted(after, "moved")
        state = table.select("id", "to")
    return state


def component_labels(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200, tasks: int = 0) -> DataFrame:
    """(id, component): each endpoint of an edge and the smallest id that it is connected with.

    Every round each node points at its smallest neighbour, if that is smaller, the pointers are followed to their ends by
    doubling, and the links are rewritten between those ends; what lies within one is dropped. So a round reads the links
    that are left only, and a chain of any length is one round. Each round is written to the shared folder, so that a lost
    executor costs that round at most. `tasks`: over how many the edges are dealt (0: left to Spark).
    """
    kept, named = Rounds("component-links"), Rounds("components")
    pairs = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    links, n = kept.counted(dealt(pairs, tasks, "a", "b").distinct(), "true")
    state = named.put(links.select(F.col("a").alias("id")).union(links.select("b")).distinct().select("id", F.col("id").alias("component")))
    for _ in range(max_rounds):
        if not n:
            return state
        to = _ends(links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")))
        state = named.put(state.join(to.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        x, y = to.select(F.col("id").alias("a"), F.col("to").alias("x")), to.select(F.col("id").alias("b"), F.col("to").alias("y"))
        moved = links.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b")
        links, n = kept.counted(dealt(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), tasks, "a", "b").distinct(), "true")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
