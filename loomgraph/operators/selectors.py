"""Selections of nodes and edges by type, label, classes, attributes and state, as Columns and joins.

A selection is a list of groups, of which one has to match; all conditions of a group have to. Attributes and classes are
Columns; a state that depends on other rows (a loop, no neighbour, content, a collapsed container above) is joined as a
flag, and only those that some group asks for.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import predicates as p
from loomgraph.model import Graph
from loomgraph.operators.compound import visibility
from loomgraph.session import materialize

NODE_STATES = ("loop", "orphan", "child", "parent", "collapsed", "visible", "hidden")
#: States that an edge can have; it never is in one of the others.
EDGE_STATES = ("loop", "visible", "hidden")


@dataclass(frozen=True)
class Condition:
    """An attribute exists (no operator) or compares with a value: text, number or flag."""

    key: str
    op: str | None = None
    value: str | float | bool | None = None


@dataclass(frozen=True)
class Group:
    """target: node, edge or any; label: a node's label; classes, conditions and states: all of them hold."""

    target: str = "any"
    label: str | None = None
    classes: tuple[str, ...] = ()
    conditions: tuple[Condition, ...] = ()
    states: tuple[str, ...] = ()

    def __post_init__(self):
        if self.target not in ("node", "edge", "any"):
            raise ValueError(f"unknown target {self.target}")
        for state in self.states:
            if state not in NODE_STATES:
                raise ValueError(f"unknown state {state}")


def _own(column: Column, kind: str, key: str) -> Column:
    """A map that holds one attribute from a column, or none where that is null."""
    return F.when(column.isNotNull(), F.create_map(F.lit(key), p.value(column, kind)))


def _holds(group: Group, columns: list[str], own: dict[str, Column], flags: dict[str, Column]) -> Column:
    conditions = []
    if group.classes:
        conditions.append(p.has_classes(F.col("classes"), *group.classes) if "classes" in columns else F.lit(False))
    for c in group.conditions:
        attrs = own.get(c.key, F.col("attrs") if "attrs" in columns else None)
        conditions.append(F.lit(False) if attrs is None else p.attribute(attrs, c.key, c.op, c.value))
    return p.all_of(*conditions, *(flags[s] for s in group.states))


def _flagged_nodes(graph: Graph, states: set[str]) -> DataFrame:
    nodes = graph.nodes
    plain = lambda c: F.coalesce(F.col(c), F.lit(False))
    if "loop" in states:
        loops = graph.edges.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("_loop", F.lit(True))
        nodes = nodes.join(loops, "id", "left").withColumn("_loop", plain("_loop"))
    if "orphan" in states:
        pairs = graph.edges.where("src <> dst").select("src", "dst")
        linked = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct().withColumn("_linked", F.lit(True))
        nodes = nodes.join(linked, "id", "left").withColumn("_orphan", ~plain("_linked")).drop("_linked")
    if "parent" in states:
        full = graph.nodes.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct().withColumn("_parent", F.lit(True))
        nodes = nodes.join(full, "id", "left").withColumn("_parent", plain("_parent"))
    if states & {"visible", "hidden"}:
        nodes = nodes.join(visibility(graph.nodes).select("id", F.col("visible").alias("_visible")), "id", "left").withColumn("_visible", plain("_visible"))
    return nodes


def matching_nodes(graph: Graph, groups: Iterable[Group], states: Iterable[str] = ()) -> DataFrame:
    """The nodes, visible or not, that a group for nodes matches; the columns of nodes, and a flag _state for further states."""
    chosen = [g for g in groups if g.target != "edge"]
    wanted = {s for g in chosen for s in g.states} | set(states)
    rows = _flagged_nodes(graph, wanted)
    has = lambda name: name in graph.nodes.columns
    flags = {
        "loop": F.col("_loop"), "orphan": F.col("_orphan"), "parent": F.col("_parent"), "visible": F.col("_visible"),
        "child": F.col("parent").isNotNull() if has("parent") else F.lit(False),
        "collapsed": F.coalesce(F.col("collapsed"), F.lit(False)) if has("collapsed") else F.lit(False),
        "hidden": ~F.col("_visible"),
    }
    own = {key: _own(F.col("label"), "text", key) for key in ("id", "label")} if has("label") else {}
    labelled = lambda g: F.lit(True) if g.label is None else F.coalesce(F.col("label") == g.label, F.lit(False)) if has("label") else F.lit(False)
    kept = [f"_{s}" for s in states]
    return rows.where(p.any_of(F.lit(False), *(labelled(g) & _holds(g, graph.nodes.columns, own, flags) for g in chosen))).select(*graph.nodes.columns, *kept)


def select_nodes(graph: Graph, groups: Iterable[Group]) -> DataFrame:
    """(id): the visible nodes that a group matches."""
    return matching_nodes(graph, groups, states=("visible",)).where("_visible").select("id")


def matching_edges(graph: Graph, groups: Iterable[Group]) -> DataFrame:
    """(edge_id, src, dst): the first physical edge of each pair, visible or not, that a group for edges matches.

    Groups with a label match no edge, and neither do states that only nodes have. An edge is visible if both ends are.
    """
    chosen = [g for g in groups if g.target != "node" and g.label is None and set(g.states) <= set(EDGE_STATES)]
    rows = graph.first_edges()
    if any(set(g.states) & {"visible", "hidden"} for g in chosen):
        rows = _with_visible_ends(graph, rows)
    flags = {"loop": F.col("src") == F.col("dst"), "visible": F.col("_visible"), "hidden": ~F.col("_visible")}
    own = {"weight": _own(F.col("weight"), "num", "weight")}
    return rows.where(p.any_of(F.lit(False), *(_holds(g, graph.edges.columns, own, flags) for g in chosen))).select("edge_id", "src", "dst")


def select_edges(graph: Graph, groups: Iterable[Group]) -> DataFrame:
    """(src, dst): the pairs, with both ends visible, whose first physical edge a group matches."""
    found = matching_edges(graph, groups)
    return _with_visible_ends(graph, found).where("_visible").select("src", "dst")


def _with_visible_ends(graph: Graph, edges: DataFrame) -> DataFrame:
    seen = materialize(visibility(graph.nodes).where("visible").select("id"), "selector-visible")
    a, b = seen.select(F.col("id").alias("src"), F.lit(True).alias("_a")), seen.select(F.col("id").alias("dst"), F.lit(True).alias("_b"))
    return edges.join(a, "src", "left").join(b, "dst", "left").withColumn("_visible", F.coalesce(F.col("_a") & F.col("_b"), F.lit(False))).drop("_a", "_b")
