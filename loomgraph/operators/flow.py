"""Maximum flow and minimum cuts as rounds over tables.

Flow is pushed as in preflow algorithms, with exact distances: every round measures, backwards from the goal, how many
arcs with room lead there, and then empties the nodes that hold more than they pass on, farthest ones first, into nodes
that are one arc nearer. What a node's arcs take is told by sums over ranges of its arcs, so a node with any share of all
arcs is spread over tasks. What can no longer reach the goal flows back to the source in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ordinals import with_sum_before
from loomgraph.model import Graph
from loomgraph.operators.reach import hop_levels
from loomgraph.session import Rounds, materialize


@dataclass(frozen=True)
class Flow:
    """value, edges (edge_id, src, dst, capacity, flow) that can carry flow, and side (id): the nodes on the source's side of a least cut."""

    value: float
    edges: DataFrame
    side: DataFrame


def _room(arcs: DataFrame) -> DataFrame:
    """(edge_id, sign, src, dst, room): what can still be sent along an edge, and back against what it carries."""
    there = arcs.select("edge_id", F.lit(1).alias("sign"), "src", "dst", (F.col("capacity") - F.col("flow")).alias("room"))
    back = arcs.select("edge_id", F.lit(-1).alias("sign"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("flow").alias("room"))
    return there.union(back).where("room > 0")


def _levels(room: DataFrame, goal: int, never: int) -> DataFrame:
    """(id, level): arcs with room from each node to the goal, on ways that do not pass `never`."""
    links = room.where((F.col("src") != never) & (F.col("dst") != never)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    spark = room.sparkSession
    return hop_levels(links, spark.createDataFrame([(goal,)], "id long")).select("id", "level")


def _drained(arcs: Rounds, state: DataFrame, excess: DataFrame, goal: int, never: int) -> tuple[DataFrame, DataFrame]:
    """Sends what nodes hold to the goal until nothing more gets there; the arcs and what nodes hold then."""
    held = Rounds("flow-excess")
    while True:
        room = materialize(_room(state), "flow-room")
        levels = materialize(_levels(room, goal, never), "flow-levels")
        here = excess.join(levels, "id").where(F.col("id") != goal)
        far = here.agg(F.max("level")).first()[0]
        if far is None:
            return state, excess
        lower = levels.select(F.col("id").alias("dst"), F.col("level").alias("to"))
        sent = None
        for level in range(far, 0, -1):
            full = excess.join(levels.where(F.col("level") == level), "id").select(F.col("id").alias("src"), "excess", "level")
            arcs_down = room.join(full, "src").join(lower, "dst").where("to = level - 1").select("edge_id", "sign", "src", "dst", "room", "excess")
            shares = with_sum_before(arcs_down, ["src"], ["edge_id", "sign"], "room")
            amount = F.least(F.col("room"), F.col("excess") - F.col("before"))
            moved = materialize(shares.withColumn("amount", amount).where("amount > 0").select("edge_id", "sign", "src", "dst", "amount"), "flow-moved")
            sent = moved if sent is None else sent.union(moved)
            change = excess.select("id", "excess").union(moved.select("src", -F.col("amount"))).union(moved.select("dst", "amount"))
            excess = held.put(change.groupBy("id").agg(F.sum("excess").alias("excess")).where("excess > 0"))
        change = sent.groupBy("edge_id").agg(F.sum(F.col("sign") * F.col("amount")).alias("more"))
        state = arcs.put(state.join(change, "edge_id", "left").withColumn("flow", F.col("flow") + F.coalesce("more", F.lit(0.0))).drop("more"))


def maximum_flow(graph: Graph, source: int, goal: int) -> Flow:
    """The largest flow from one node to another; capacities are weights, negative ones 0, and loops carry nothing.

    Parallel edges carry flow each for itself. Nodes that are not there or are the same give a flow of 0. The nodes that
    can still reach the goal at the end are the goal's side of a least cut, so value equals what leaves `side`.
    """
    spark = graph.edges.sparkSession
    edges = graph.edges.where("src <> dst AND weight > 0").select("edge_id", "src", "dst", F.col("weight").alias("capacity"))
    ends = graph.nodes.where(F.col("id").isin(source, goal)).select("id").distinct().count()
    arcs = Rounds("flow-arcs")
    start = F.when(F.col("src") == source, F.col("capacity")).otherwise(0.0)
    state = arcs.put(edges.withColumn("flow", (start if source != goal and ends == 2 else F.lit(0.0)).cast("double")))
    if source == goal or ends < 2:
        return Flow(0.0, state, spark.createDataFrame([(source,)], "id long"))
    excess = materialize(state.where("flow > 0").groupBy(F.col("dst").alias("id")).agg(F.sum("flow").alias("excess")), "flow-excess")
    state, excess = _drained(arcs, state, excess.where(F.col("id") != source), goal, source)
    value = excess.where(F.col("id") == goal).agg(F.sum("excess")).first()[0] or 0.0
    ahead = materialize(_levels(materialize(_room(state), "flow-room"), goal, source), "flow-levels")
    side = materialize(graph.nodes.select("id").join(ahead.select("id"), "id", "left_anti"), "flow-side")
    state, _ = _drained(arcs, state, excess.where(F.col("id") != goal), source, goal)
    return Flow(float(value), state, side)


def cut_edges(flow: Flow) -> DataFrame:
    """(edge_id, src, dst, capacity): the edges that lead out of the source's side; together they have the flow's value."""
    a, b = flow.side.select(F.col("id").alias("src")), flow.side.select(F.col("id").alias("dst"))
    return flow.edges.join(a, "src", "left_semi").join(b, "dst", "left_anti").select("edge_id", "src", "dst", "capacity")


def with_terminals(graph: Graph, supplies: DataFrame, demands: DataFrame, source: int, goal: int) -> Graph:
    """The graph with a source that feeds nodes (id, amount) and a goal that takes from nodes (id, amount)."""
    spark = graph.edges.sparkSession
    more = supplies.select(F.lit(source).cast("long").alias("src"), F.col("id").alias("dst"), F.col("amount").alias("weight"))
    more = more.union(demands.select(F.col("id").alias("src"), F.lit(goal).cast("long").alias("dst"), F.col("amount").alias("weight")))
    return Graph.from_edges(graph.edges.select("src", "dst", "weight").union(more), graph.nodes.select("id").union(spark.createDataFrame([(source,), (goal,)], "id long")))
