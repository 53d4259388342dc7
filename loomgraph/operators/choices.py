"""Matchings, colourings, bridges, dominators and simple paths, as rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import Graph
from loomgraph.operators.blocks import over_subtrees, rooted_forest
from loomgraph.operators.components import component_labels
from loomgraph.operators.order import strong_components
from loomgraph.operators.reach import hop_levels
from loomgraph.session import materialize


def maximal_matching(graph: Graph, seed: int = 1) -> DataFrame:
    """(src, dst) with src < dst: pairs without a common end, to which no edge can be added; direction and loops are ignored.

    Each round takes the edges that come first, by a hash, among all edges at both of their ends, and drops what touches
    them. A constant share of the edges goes in every round, so rounds are logarithmic in edges.
    """
    left = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    left = materialize(left.withColumn("rank", F.xxhash64("src", "dst", F.lit(seed))), "match-left")
    chosen = None
    while left.limit(1).count():
        order = F.struct("rank", "src", "dst")
        ends = left.select(F.col("src").alias("id"), order.alias("e")).union(left.select("dst", order))
        first = ends.groupBy("id").agg(F.min("e").alias("e"))
        both = first.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        took = materialize(both.select("e.src", "e.dst"), "match-chosen")
        chosen = took if chosen is None else chosen.union(took)
        used = took.select(F.col("src").alias("id")).union(took.select("dst"))
        left = left.join(used.withColumnRenamed("id", "src"), "src", "left_anti").join(used.withColumnRenamed("id", "dst"), "dst", "left_anti")
        left = materialize(left.select("src", "dst", "rank"), "match-left")
    return chosen if chosen is not None else left.select("src", "dst")


def colouring(graph: Graph, seed: int = 1) -> DataFrame:
    """(id, colour): neighbours have different colours from 0; each round colours the nodes whose hash leads among uncoloured neighbours.

    A node takes the lowest colour that its neighbours do not have, so no more than the largest degree and one are used.
    """
    links = materialize(graph.undirected(), "colour-links")
    state = materialize(graph.nodes.select("id", F.xxhash64("id", F.lit(seed)).alias("rank"), F.lit(None).cast("int").alias("colour")), "colours")
    while state.where("colour IS NULL").limit(1).count():
        near = links.join(state.select(F.col("id").alias("dst"), F.col("rank").alias("r"), F.col("colour").alias("c")), "dst")
        open_rank = F.max(F.when(F.col("c").isNull(), F.struct(F.col("r"), F.col("dst").alias("id"))))
        sums = near.groupBy(F.col("src").alias("id")).agg(open_rank.alias("top"), F.collect_set("c").alias("taken"))
        rows = state.join(sums, "id", "left")
        leads = F.col("top").isNull() | (F.struct(F.col("rank").alias("r"), F.col("id").alias("id")) > F.col("top"))
        taken = F.coalesce("taken", F.array().cast("array<int>"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(taken)), taken))
        state = materialize(rows.select("id", "rank", F.when(F.col("colour").isNull() & leads, free).otherwise(F.col("colour")).alias("colour")), "colours")
    return state.select("id", "colour")


def bridges(graph: Graph, seed: int = 1) -> DataFrame:
    """(src, dst) with src < dst: edges whose loss parts a component; parallel edges protect each other, loops are none.

    A spanning forest is rooted at the smallest node of each component. Every edge outside it gets a random label,
    and a forest edge the XOR of the labels of those that close a circle over it: it is a bridge if that is 0. Two
    labels of 64 bits keep the chance of an error below 2**-100 for any graph that can be stored.
    """
    pairs = graph.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    pairs = materialize(pairs, "bridge-pairs")
    nodes = rooted_forest(pairs)
    lower = nodes.where("parent IS NOT NULL").select("id", "parent")
    tree = lower.select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
    single = pairs.where("n = 1").join(tree, ["a", "b"], "left_anti").select("a", "b")
    extra = pairs.where("n > 1").select("a", "b")
    closing = single.union(extra).select("a", "b", F.xxhash64("a", "b", F.lit(seed)).alias("x"), F.xxhash64("b", "a", F.lit(seed + 1)).alias("y"))
    none = lower.select("id", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    own = none.union(closing.select("a", "x", "y")).union(closing.select("b", "x", "y")).groupBy("id").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    sums = over_subtrees(nodes, own, x=F.bit_xor, y=F.bit_xor)
    return sums.where("x = 0 AND y = 0").join(lower, "id").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))


def dominators(graph: Graph, root: int) -> DataFrame:
    """(id, dominator): every node that all ways from the root to a node pass, itself included; nodes not reached have no rows.

    Rounds keep, for each node, what the sets of all its reached predecessors share; sets only shrink once they are whole.
    """
    links = materialize(graph.edges.select("src", "dst").where(f"src <> dst AND dst <> {root}").distinct(), "dominator-links")
    start = graph.nodes.where(F.col("id") == root).select("id", F.array("id").alias("d"))
    state, before = materialize(start, "dominators"), None
    while True:
        via = links.join(state.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "d")
        counts = via.select("id", F.explode("d").alias("x")).groupBy("id", "x").agg(F.count(F.lit(1)).alias("k"))
        ways = via.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        kept = counts.join(ways, "id").where("k = n").groupBy("id").agg(F.collect_set("x").alias("d"))
        after = kept.select("id", F.array_sort(F.array_union("d", F.array("id"))).alias("d")).union(start)
        state = materialize(after, "dominators")
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.size("d")), F.bit_xor(F.xxhash64("id", "d"))).first())
        if now == before:
            return state.select("id", F.explode("d").alias("dominator"))
        before = now


def immediate_dominators(graph: Graph, root: int) -> DataFrame:
    """(id, idom): the dominator nearest to a node other than itself; the root has none."""
    d = materialize(dominators(graph, root), "dominator-rows")
    sizes = d.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    proper = d.where("id <> dominator").join(sizes.select(F.col("id").alias("dominator"), "n"), "dominator")
    return proper.groupBy("id").agg(F.max_by("dominator", "n").alias("idom"))


def simple_paths(graph: Graph, start: int, goal: int, limit: int) -> DataFrame:
    """(path): up to `limit` paths without a repeated node, the shortest first, then by their nodes.

    A path that has begun is at least as long as its links and the hops from its end to the goal, and lies waiting until
    paths of that length are asked for. So only nodes that reach the goal are entered, and no path grows beyond the
    length at which `limit` paths have ended.
    """
    back = graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    hops = materialize(hop_levels(back, graph.nodes.where(F.col("id") == goal).select("id")).select("id", F.col("level").alias("hops")), "path-hops")
    links = materialize(graph.edges.select("src", "dst").distinct().join(hops.withColumnRenamed("id", "dst"), "dst"), "path-links")
    path = lambda links: (F.size("path") - 1 + F.col(links)).alias("least")
    waiting = materialize(hops.where(F.col("id") == start).select(F.array("id").alias("path")).join(hops, F.get("path", 0) == F.col("id")).select("path", path("hops")), "paths")
    done = waiting.limit(0)
    while (length := waiting.agg(F.min("least")).first()[0]) is not None:
        ready, later = waiting.where(F.col("least") == length), waiting.where(F.col("least") > length)
        while not ready.isEmpty():
            ends = F.element_at("path", -1)
            done = done.union(ready.where(ends == goal))
            going = ready.where(ends != goal).withColumn("src", ends).join(links, "src").where(~F.array_contains("path", F.col("dst")))
            longer = materialize(going.select(F.concat("path", F.array("dst")).alias("path"), "hops").select("path", path("hops")), "paths")
            ready, later = longer.where(F.col("least") == length), later.union(longer.where(F.col("least") > length))
        if done.limit(limit).count() >= limit:
            break
        waiting = materialize(later, "paths-waiting")
    return done.select("path").orderBy(F.size("path"), "path").limit(limit)


def euler_check(graph: Graph, directed: bool = True) -> bool:
    """Whether one trail covers every edge: edges lie in one component, and degrees differ at its two ends at most."""
    edges = graph.edges.select("src", "dst")
    if not edges.limit(1).count():
        return True
    sides = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    d = sides.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    joined = component_labels(edges)
    loops = d.select("id").join(joined, "id", "left").select(F.coalesce("component", "id").alias("c")).distinct().limit(2).count()
    if directed:
        odd = d.agg(F.sum((F.col("o") - F.col("i") == 1).cast("int")), F.sum((F.col("i") - F.col("o") == 1).cast("int")), F.sum((F.abs(F.col("o") - F.col("i")) > 1).cast("int"))).first()
        return loops == 1 and odd[2] == 0 and odd[0] <= 1 and odd[1] <= 1
    return loops == 1 and d.where("(o + i) % 2 = 1").count() in (0, 2)


def maximal_cliques(graph: Graph) -> DataFrame:
    """(clique): every largest set of nodes that are all linked, as a sorted array; a node without links is one alone.

    A row is a clique with the later nodes that extend it and the earlier ones that would have; each round adds one node
    to each row. What has neither is maximal. Rows are as many as there are cliques of a size, which suits sparse graphs.
    """
    links = materialize(graph.undirected(), "clique-links")
    near = materialize(links.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("near")), "clique-near")
    alone = graph.nodes.select("id").join(near.select(F.col("src").alias("id")), "id", "left_anti").select(F.array("id").alias("clique"))
    rows = near.select(F.array("src").alias("clique"), F.filter("near", lambda x: x > F.col("src")).alias("later"), F.filter("near", lambda x: x < F.col("src")).alias("earlier"))
    out = alone
    while True:
        rows = materialize(rows, "cliques")
        if rows.isEmpty():
            return out
        out = out.union(rows.where("size(later) = 0 AND size(earlier) = 0").select("clique"))
        grown = rows.withColumn("src", F.explode("later")).join(near, "src")
        rows = grown.select(
            F.concat("clique", F.array("src")).alias("clique"),
            F.filter(F.array_intersect("later", "near"), lambda x: x > F.col("src")).alias("later"),
            F.array_union(F.array_intersect("earlier", "near"), F.filter(F.array_intersect("later", "near"), lambda x: x < F.col("src"))).alias("earlier"),
        )


def feedback_arcs(graph: Graph) -> DataFrame:
    """(edge_id, src, dst): edges without which no cycle is left; loops are among them.

    Within each strong component nodes are ordered by what leaves less what enters, largest first and then by id; the
    edges that go backwards are taken.
    """
    strong = materialize(strong_components(graph), "feedback-strong")
    a, b = strong.select(F.col("id").alias("src"), F.col("component").alias("a")), strong.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    inner = materialize(graph.edges.join(a, "src").join(b, "dst").where("a = b").select("edge_id", "src", "dst"), "feedback-inner")
    sides = inner.where("src <> dst").select(F.col("src").alias("id"), F.lit(1).alias("k")).union(inner.where("src <> dst").select("dst", F.lit(-1)))
    lead = sides.groupBy("id").agg(F.sum("k").alias("lead"))
    x, y = lead.select(F.col("id").alias("src"), F.col("lead").alias("x")), lead.select(F.col("id").alias("dst"), F.col("lead").alias("y"))
    backwards = (F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("src") > F.col("dst")))
    arcs = inner.where("src <> dst").join(x, "src").join(y, "dst").where(backwards).select("edge_id", "src", "dst")
    return arcs.union(inner.where("src = dst"))
