"""Topological rounds, strong components, condensation, reduction, cycle and colour tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import Graph
from loomgraph.operators.components import component_labels
from loomgraph.operators.reach import reach_pairs
from loomgraph.session import Rounds, materialize, written


#: Rounds of a topological order after which nodes within long ways are taken out.
SHALLOW = 6


def _within_ways(left: DataFrame, links: DataFrame, seed: int) -> DataFrame:
    """(id, least, up, behind, to, ahead): nodes with one link in and one out, no two of them linked, so that all can be taken out at once."""
    one = lambda key, other, name, w: links.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min(other).alias(name), F.min("w").alias(w)).where("n = 1").drop("n")
    inner = materialize(one("dst", "src", "up", "behind").join(one("src", "dst", "to", "ahead"), "id"), "order-ways")
    order = lambda c: F.xxhash64(F.col(c), F.lit(seed))
    for side in ("up", "to"):
        beside = inner.select(F.col("id").alias(side), F.lit(True).alias(f"{side}_within"))
        inner = inner.join(beside, side, "left").where(F.col(f"{side}_within").isNull() | (order("id") < order(side))).drop(f"{side}_within")
    return materialize(left.join(inner, "id").select("id", "least", "up", "behind", "to", "ahead"), "order-taken")


def topological_rounds(graph: Graph) -> DataFrame:
    """(id, round): the round in which a node has no predecessor left; nodes on or behind a cycle have no row.

    That is the length of the longest way to it. In a deep graph nodes with one link in and one out are taken out, a third
    of those left in each round, and a link of the length of both takes their place; they are put back at the end, the last
    first. So a way without branches takes a number of rounds that is logarithmic.
    """
    spark = graph.edges.sparkSession
    links = materialize(graph.edges.select("src", "dst").distinct().withColumn("w", F.lit(1)), "order-links")
    left = materialize(graph.nodes.select("id", F.lit(0).alias("least")), "order-nodes")
    schema = left.select("id", F.col("least").alias("round")).schema
    done, taken = [], []
    later = lambda rows, more: rows.join(more, "id", "left").select("id", F.greatest("least", F.coalesce("more", F.lit(0))).alias("least"))
    while True:
        done.append(written(left.join(links.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.col("least").alias("round")), "order-round"))
        free = spark.read.schema(schema).parquet(done[-1])
        if free.isEmpty():
            break
        after = links.join(free.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.col("round") + F.col("w")).alias("more"))
        left = materialize(later(left.join(free, "id", "left_anti"), after), "order-nodes")
        links = materialize(links.join(free.select(F.col("id").alias("src")), "src", "left_anti"), "order-links")
        if len(done) < SHALLOW:
            continue
        gone = _within_ways(left, links, len(done))
        if gone.isEmpty():
            continue
        taken.append(gone)
        rest = links.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
        longer = gone.select(F.col("up").alias("src"), F.col("to").alias("dst"), (F.col("behind") + F.col("ahead")).alias("w"))
        links = materialize(rest.unionByName(longer).groupBy("src", "dst").agg(F.max("w").alias("w")), "order-links")
        after = gone.groupBy(F.col("to").alias("id")).agg(F.max(F.col("least") + F.col("ahead")).alias("more"))
        left = materialize(later(left.join(gone, "id", "left_anti"), after), "order-nodes")
    for gone in reversed(taken):
        known = spark.read.schema(schema).parquet(*done).select(F.col("id").alias("up"), "round")
        done.append(written(gone.join(known, "up").select("id", F.greatest("least", F.col("round") + F.col("behind")).alias("round")), "order-round"))
    return spark.read.schema(schema).parquet(*done)


def is_cyclic_directed(graph: Graph) -> bool:
    """Whether a directed cycle exists; a loop is one."""
    return topological_rounds(graph).count() < graph.nodes.count()


def is_cyclic_undirected(graph: Graph) -> bool:
    """Whether edges, read without direction, close a cycle; a loop and any repeated pair do."""
    nodes = component_ids(graph)
    return graph.edges.count() > nodes.count() - nodes.select("component").distinct().count()


def component_ids(graph: Graph) -> DataFrame:
    """(id, component) for every node; an isolated node is its own component."""
    labels = component_labels(graph.edges, tasks=graph.tasks)
    return graph.nodes.select("id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def is_bipartite(graph: Graph) -> bool:
    """Whether two colours suffice: no component of the double cover holds both copies of a node."""
    both = graph.edges.select("src", "dst")
    cover = both.select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst")).union(both.select((F.col("src") * 2 + 1).alias("src"), (F.col("dst") * 2).alias("dst")))
    labels = component_labels(cover, tasks=2 * graph.tasks)
    pairs = labels.groupBy((F.floor(F.col("id") / 2)).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("component").alias("c"))
    return not pairs.where("n = 2 AND c = 1").limit(1).count()


def _spread(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label): the smallest id that reaches each node along links.

    Only labels that changed in a round are handed on, to followers and to those that bear the changed node as their
    label: what reaches it reaches them. So a way of any length takes a number of rounds that is logarithmic in practice.
    """
    rounds, moved = Rounds("spread"), 1
    state = rounds.put(nodes.select("id", F.col("id").alias("label"), F.lit(True).alias("moved")))
    while moved:
        fresh = state.where("moved").select(F.col("id").alias("src"), "label")
        near = fresh.join(links, "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("near"))
        beyond = fresh.where("src <> label").select(F.col("src").alias("label"), F.col("label").alias("beyond"))
        rows = state.select("id", "label").join(near, "id", "left").join(beyond, "label", "left")
        least = F.least("label", F.coalesce("near", "label"), F.coalesce("beyond", "label"))
        state, moved = rounds.counted(rows.select("id", least.alias("label"), (least < F.col("label")).alias("moved")), "moved")
    return state.select("id", "label")


def _trimmed(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and links on circles or between two of them, and the other nodes: those not behind a circle, then those not before one."""
    alone = nodes.limit(0)
    for a, b in (("src", "dst"), ("dst", "src")):
        off = materialize(topological_rounds(Graph(nodes, links.select(F.col(a).alias("src"), F.col(b).alias("dst")))).select("id"), "strong-alone")
        alone = alone.union(off)
        nodes = materialize(nodes.join(off, "id", "left_anti"), "strong-nodes")
        rest = links.join(off.select(F.col("id").alias("src")), "src", "left_anti").join(off.select(F.col("id").alias("dst")), "dst", "left_anti")
        links = materialize(rest.select("src", "dst"), "strong-links")
    return nodes, links, alone


def strong_components(graph: Graph) -> DataFrame:
    """(id, component): the smallest member of a node's strongly connected component.

    Nodes without links in or out are components of their own. Rounds of forward colouring for the rest: a node's colour
    is the smallest id that reaches it; those of a colour that reach that id in turn are a component, and the others go
    into the next round.
    """
    nodes = materialize(graph.nodes.select("id"), "strong-nodes")
    links = materialize(graph.edges.select("src", "dst").where("src <> dst").distinct(), "strong-links")
    done = nodes.limit(0).select("id", F.col("id").alias("component"))
    while nodes.limit(1).count():
        nodes, links, alone = _trimmed(nodes, links)
        done = done.union(alone.select("id", F.col("id").alias("component")))
        colour = materialize(_spread(links, nodes), "strong-colour")
        a, b = colour.select(F.col("id").alias("src"), F.col("label").alias("a")), colour.select(F.col("id").alias("dst"), F.col("label").alias("b"))
        inner = links.join(a, "src").join(b, "dst").where("a = b")
        back = materialize(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "strong-back")
        found = materialize(_spread(back, nodes).join(colour.select("id", F.col("label").alias("component")), "id").where("label = component").select("id", "component"), "strong-found")
        done = done.union(found)
        nodes = materialize(nodes.join(found, "id", "left_anti"), "strong-nodes")
        links = materialize(links.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"), "strong-links")
    return done


def condensation(graph: Graph) -> DataFrame:
    """(src, dst): distinct links between strong components, each named by its smallest member."""
    c = materialize(strong_components(graph), "strong")
    a, b = c.select(F.col("id").alias("src"), F.col("component").alias("a")), c.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    return graph.edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def transitive_reduction(graph: Graph) -> DataFrame:
    """(src, dst): edges of an acyclic graph whose target is not reached by another way; parallel edges drop each other."""
    if is_cyclic_directed(graph):
        raise ValueError("transitive reduction needs an acyclic graph")
    single = graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("src", "dst")
    reach = reach_pairs(graph.edges)
    a, b = graph.edges.select("src", F.col("dst").alias("mid")).distinct(), reach.select(F.col("src").alias("mid"), "dst")
    return single.join(a.join(b, "mid").select("src", "dst"), ["src", "dst"], "left_anti")


def _roots(pointers: DataFrame) -> DataFrame:
    """(a, to): where following the pointers (a, to) ends; each way ends in two that point at each other, the smaller one counts."""
    back = pointers.select(F.col("a").alias("to"), F.col("to").alias("back"))
    rounds, moved = Rounds("roots"), 1
    state = rounds.put(pointers.join(back, "to").select("a", F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("to")), F.col("a")).otherwise(F.col("to")).alias("to")))
    while moved:
        jump = state.select(F.col("a").alias("to"), F.col("to").alias("beyond"))
        table, moved = rounds.counted(state.join(jump, "to").select("a", F.col("beyond").alias("to"), (F.col("beyond") != F.col("to")).alias("moved")), "moved")
        state = table.select("a", "to")
    return state


def spanning_forest(graph: Graph) -> DataFrame:
    """(src, dst, weight, edge_id): a minimum spanning forest of the undirected reading, by rounds of cheapest edges.

    Ties go to the smaller edge_id, so that the chosen edges of a round close no cycle. Links carry the components of
    their ends, which follow each other's choices to one root; what lies within a component is dropped. Rounds are
    logarithmic in nodes.
    """
    rounds = Rounds("forest-links")
    plain = graph.edges.where("src <> dst").select("src", "dst", "weight", "edge_id")
    links, n = rounds.counted(plain.withColumns({"a": F.col("src"), "b": F.col("dst")}), "true")
    chosen = None
    while n:
        edge = lambda to: F.struct("weight", "edge_id", "src", "dst", F.col(to).alias("to")).alias("e")
        sides = links.select("a", edge("b")).union(links.select("b", edge("a")))
        best = materialize(sides.groupBy("a").agg(F.min("e").alias("e")).select("a", "e.*"), "forest-chosen")
        took = best.select("src", "dst", "weight", "edge_id")
        chosen = took if chosen is None else chosen.union(took)
        root = _roots(best.select("a", "to"))
        x, y = root.select("a", F.col("to").alias("x")), root.select(F.col("a").alias("b"), F.col("to").alias("y"))
        moved = links.join(x, "a").join(y, "b").where("x <> y").select("src", "dst", "weight", "edge_id", F.col("x").alias("a"), F.col("y").alias("b"))
        links, n = rounds.counted(moved, "true")
    return (chosen if chosen is not None else plain.limit(0)).distinct()
