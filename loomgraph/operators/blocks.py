"""Blocks (biconnected components) and cut vertices without a local kernel.

A spanning forest is rooted by a tour along both sides of its edges, which is a ranked list, so nothing takes as many
rounds as the forest is deep. Each forest edge is named by its lower node. Two forest edges lie on a common circle if
another edge joins their lower nodes, of which neither is above the other, or if the subtree of the lower one reaches out
of the subtree of the node between them. Components of these relations are the blocks. A subtree is a stretch of the
tour; what it reaches is put together from stretches of powers of two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ordinals import with_ordinal
from loomgraph.model import Graph
from loomgraph.operators.components import component_labels
from loomgraph.operators.lists import list_ranks
from loomgraph.operators.order import spanning_forest
from loomgraph.session import materialize


def rooted_forest(pairs: DataFrame) -> DataFrame:
    """(tree, id, parent, first, last) of a spanning forest over unordered pairs (a, b); tree is each component's smallest node, its root.

    first and last are the steps of a tour around the tree that lead down to a node and up from it. What lies below a node
    has a first between the two. Roots have no parent and lie around all steps.
    """
    labels = materialize(component_labels(pairs, "a", "b"), "tour-trees")
    forest = materialize(spanning_forest(Graph.from_edges(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight")))).select("src", "dst"), "tour-links")
    steps = materialize(with_ordinal(forest.union(forest.select("dst", "src")), "src", "dst", name="e").select("e", "src", "dst"), "tour-steps")
    n = steps.count()
    # A step to a node is followed by the node's next step after the one back, round and round; at a root the round ends.
    turns = steps.groupBy(F.col("src").alias("dst")).agg(F.min("e").alias("low"), F.max("e").alias("high"))
    back = steps.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("e").alias("back"))
    rows = steps.join(back, ["src", "dst"]).join(turns, "dst").join(labels.select(F.col("id").alias("dst"), F.col("component").alias("tree")), "dst")
    follower = F.when(F.col("back") < F.col("high"), F.col("back") + 1).when(F.col("dst") != F.col("tree"), F.col("low"))
    tour = materialize(rows.select("e", "src", "dst", "back", "tree", follower.alias("next"), F.lit(1).alias("behind")), "tour")
    place = materialize(list_ranks(tour.select("e", "next", "behind"), "behind").select("e", (F.lit(n - 1) - F.col("behind")).alias("first")), "tour-places")
    down = tour.join(place, "e").join(place.select(F.col("e").alias("back"), F.col("first").alias("last")), "back").where("first < last")
    roots = labels.where("id = component").select(F.col("component").alias("tree"), "id", F.lit(None).cast("long").alias("parent"), F.lit(-1).cast("long").alias("first"), F.lit(n).cast("long").alias("last"))
    return materialize(roots.union(down.select("tree", F.col("dst").alias("id"), F.col("src").alias("parent"), "first", "last")), "tour-forest")


def over_subtrees(forest: DataFrame, values: DataFrame, **how: Callable[[str], Column]) -> DataFrame:
    """(id, columns of `how`) for all nodes but roots: each column of values (id, columns) put together over the node and all below it.

    `how` gives a function for each column that may take parts in any order, such as min or bit_xor. Nodes are added up in
    stretches of 1, 2, 4, ... steps, and each subtree takes the few that it is made of.
    """
    inner = forest.where("parent IS NOT NULL")
    top = max(1, int(inner.agg(F.max("last")).first()[0] or 0).bit_length())
    levels = F.sequence(F.lit(0), F.lit(top))
    low, high = (lambda k: F.floor((F.col("first") + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1) / F.call_function("shiftleft", F.lit(1).cast("long"), k)), lambda k: F.call_function("shiftright", F.col("last"), k))
    each = inner.join(values, "id").select("tree", "first", *how, F.explode(levels).alias("level"))
    sums = each.groupBy("tree", "level", F.call_function("shiftright", F.col("first"), F.col("level")).alias("part")).agg(*(f(c).alias(c) for c, f in how.items()))
    sums = materialize(sums, "subtree-parts")
    left = F.transform(F.filter(levels, lambda k: (low(k) < high(k)) & (low(k) % 2 == 1)), lambda k: F.struct(k.alias("level"), low(k).alias("part")))
    right = F.transform(F.filter(levels, lambda k: (low(k) < high(k)) & (high(k) % 2 == 1)), lambda k: F.struct(k.alias("level"), (high(k) - 1).alias("part")))
    pieces = inner.select("tree", "id", F.explode(F.concat(left, right)).alias("p")).select("tree", "id", "p.level", "p.part")
    return pieces.join(sums, ["tree", "level", "part"]).groupBy("id").agg(*(f(c).alias(c) for c, f in how.items()))


def block_edges(graph: Graph) -> DataFrame:
    """(block, id, parent): forest edges by their block; a block is named by its smallest lower node."""
    pairs = materialize(graph.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "block-pairs")
    nodes = rooted_forest(pairs)
    lower = nodes.where("parent IS NOT NULL").select("id", "parent", "first", "last")
    forest = lower.select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
    of = lambda k: nodes.select(F.col("id").alias(k), F.col("first").alias(f"{k}0"), F.col("last").alias(f"{k}1"))
    other = materialize(pairs.join(forest, ["a", "b"], "left_anti").join(of("a"), "a").join(of("b"), "b"), "block-others")
    reached = lower.select("id", F.col("first").alias("low"), F.col("first").alias("high"))
    reached = reached.union(other.select("a", "b0", "b0")).union(other.select("b", "a0", "a0"))
    reach = over_subtrees(nodes, reached.groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high")), low=F.min, high=F.max)
    above = lower.select(F.col("id").alias("parent"), F.col("first").alias("p0"), F.col("last").alias("p1"))
    out = reach.join(lower.select("id", "parent"), "id").join(above, "parent").where("low < p0 OR high > p1").select(F.col("id").alias("a"), F.col("parent").alias("b"))
    beside = other.where("a1 < b0 OR b1 < a0").select("a", "b")
    labels = component_labels(out.union(beside), "a", "b")
    return lower.join(labels, "id", "left").select(F.coalesce("component", "id").alias("block"), "id", "parent")


def blocks(graph: Graph) -> DataFrame:
    """(group_id, block, id): nodes of each block, group_id its smallest member; cut vertices repeat, isolated nodes are alone (block null)."""
    edges = materialize(block_edges(graph), "block-edges")
    members = edges.select("block", "id").union(edges.select("block", "parent")).distinct()
    named = members.join(members.groupBy("block").agg(F.min("id").alias("group_id")), "block").select("group_id", "block", "id")
    alone = graph.nodes.select("id").join(members.select("id").distinct(), "id", "left_anti")
    return named.union(alone.select(F.col("id").alias("group_id"), F.lit(None).cast("long").alias("block"), "id"))


def articulation_points(graph: Graph) -> DataFrame:
    """(id): nodes that lie in more than one block."""
    return blocks(graph).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
