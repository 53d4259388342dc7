"""Euler trails and depth-first orders as sequences, without walking: links between edges, merged cycles, ranked lists.

A trail over all edges starts as a permutation: at each node every edge that enters is followed by one that leaves. Its
cycles are merged along a spanning forest of the graph of cycles and the nodes that they pass, by rotating at each node
the followers of one edge of every cycle that the forest joins there; since a forest has no circle, each rotation makes
one cycle of several. The one cycle is cut and ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ordinals import with_ordinal
from loomgraph.model import Graph
from loomgraph.operators.components import component_labels
from loomgraph.operators.lists import cycle_labels, list_ranks
from loomgraph.operators.order import spanning_forest
from loomgraph.session import materialize


class NoTrail(ValueError):
    """No trail uses each edge once; `node_id` is a node that stands in its way."""

    def __init__(self, node_id: int, why: str):
        super().__init__(f"no trail over all edges: {why} at node {node_id}")
        self.node_id = node_id


def _ends(edges: DataFrame, directed: bool) -> tuple[int, int] | None:
    """The first and the last node of an open trail (null: it is closed); raises where there is no trail."""
    sides = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    degrees = sides.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    lead = (F.col("o") - F.col("i")) if directed else (F.col("o") + F.col("i")) % 2
    odd = materialize(degrees.select("id", lead.alias("lead")).where("lead <> 0"), "trail-odd")
    wrong = odd.where("abs(lead) > 1").agg(F.min("id")).first()[0]
    if wrong is not None:
        raise NoTrail(wrong, "too many edges enter or leave")
    rows = odd.orderBy("id").limit(3).collect()
    if len(rows) > 2:
        raise NoTrail(rows[0].id, "more than two odd nodes, one of them")
    labels = component_labels(edges)
    alone = degrees.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    parts = alone.groupBy("component").agg(F.min("id").alias("id")).orderBy("id").limit(2).collect()
    if len(parts) > 1:
        raise NoTrail(parts[1].id, "another component with edges, first")
    if not rows:
        return None
    return tuple(r.id for r in sorted(rows, key=lambda r: (-r.lead, r.id)))


def _followers(edges: DataFrame) -> DataFrame:
    """(e, next, edge_id, src, dst): edges numbered by their first node, each followed by one that leaves where it ends.

    Where as many edges enter as leave, the edge at place k by last nodes is followed by the edge at place k by first nodes.
    """
    out = materialize(with_ordinal(edges, "src", "edge_id", name="e").select("e", "edge_id", "src", "dst"), "trail-edges")
    return materialize(with_ordinal(out, "dst", "e", name="next").select("e", "next", "edge_id", "src", "dst"), "trail-next")


def _one_cycle(links: DataFrame) -> DataFrame:
    """The same edges with followers that make one cycle of each component."""
    labels = cycle_labels(links.select("e", "next"))
    passed = materialize(links.select("e", F.col("dst").alias("node")).join(labels, "e").groupBy("label", "node").agg(F.min("e").alias("e")), "trail-passed")
    shared = passed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    # Cycles and nodes as the nodes of one graph: cycles have even ids, nodes odd ones. Node ids are numbered to stay in range.
    numbered = with_ordinal(shared, "node", name="k")
    meet = materialize(passed.join(numbered, "node").select("label", "node", "e", (F.col("label") * 2).alias("src"), (F.col("k") * 2 + 1).alias("dst")), "trail-meet")
    if not meet.limit(1).count():
        return links
    forest = spanning_forest(Graph.from_edges(meet.select("src", "dst", F.lit(1.0).alias("weight"))))
    joined = meet.join(forest.select("src", "dst"), ["src", "dst"], "left_semi").select("node", "label", "e").join(links.select("e", "next"), "e")
    placed = materialize(with_ordinal(joined, "node", "label", name="k"), "trail-joined")
    first = placed.groupBy("node").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    wanted = placed.join(first, "node").select("e", F.when(F.col("k") < F.col("last"), F.col("k") + 1).otherwise(F.col("first")).alias("k"))
    turned = wanted.join(placed.select("k", F.col("next").alias("turned")), "k").select("e", "turned")
    return materialize(links.join(turned, "e", "left").withColumn("next", F.coalesce("turned", "next")).drop("turned"), "trail-cycle")


def euler_trail(graph: Graph) -> DataFrame:
    """(step, edge_id, src, dst): a walk that uses every edge once, steps from 0; raises NoTrail where there is none.

    A closed trail starts at an edge of the smallest node. Parallel edges and loops are edges of their own. A graph
    without edges gives no rows.
    """
    edges = materialize(graph.edges.select("edge_id", "src", "dst"), "trail-graph")
    if not edges.limit(1).count():
        return edges.select(F.lit(0).cast("long").alias("step"), "edge_id", "src", "dst").limit(0)
    return _ranked(edges, _ends(edges, True))


def _ranked(edges: DataFrame, ends: tuple[int, int] | None) -> DataFrame:
    spark = edges.sparkSession
    if ends:  # one more edge closes the trail; the list is cut there
        edges = edges.union(spark.createDataFrame([(None, ends[1], ends[0])], edges.schema))
    links = _one_cycle(_followers(edges))
    cut = links.where("edge_id IS NULL") if ends else links.where("e = 0")
    cut = cut.select("e", "next").first()
    # A closed trail starts with edge 0 and ends with the one before it; an open one has the added edge in between.
    n = links.count()
    stop = cut.e
    listed = links.where(F.col("e") != stop) if ends else links
    after = list_ranks(listed.select("e", F.when(F.col("next") != stop, F.col("next")).alias("next"), F.lit(1).alias("after")), "after")
    last = n - (2 if ends else 1)
    return listed.join(after, "e").select((F.lit(last) - F.col("after")).cast("long").alias("step"), "edge_id", "src", "dst")


def euler_trail_undirected(graph: Graph) -> DataFrame:
    """(step, edge_id, src, dst): a walk that uses every edge once in either direction; src and dst are as walked.

    The ends of edges at a node are paired, which leads from each of an edge's two directions to one of another edge. A
    cycle of directions and its reverse are different cycles; the one with the smaller label directs its edges.
    """
    edges = materialize(graph.edges.select("edge_id", "src", "dst"), "trail-graph")
    if not edges.limit(1).count():
        return edges.select(F.lit(0).cast("long").alias("step"), "edge_id", "src", "dst").limit(0)
    ends = _ends(edges, False)
    closed = edges.union(edges.sparkSession.createDataFrame([(None, ends[1], ends[0])], edges.schema)) if ends else edges
    numbered = materialize(with_ordinal(closed, "src", "dst", "edge_id", name="x"), "trail-numbered")
    sides = numbered.select(F.col("src").alias("node"), "x", F.lit(0).alias("side")).union(numbered.select("dst", "x", F.lit(1)))
    paired = materialize(with_ordinal(sides, "node", "x", "side", name="k").withColumn("pair", F.floor(F.col("k") / 2)), "trail-pairs")
    other = paired.select("pair", F.col("k").alias("j"), F.col("x").alias("y"), F.col("side").alias("z"))
    steps = paired.join(other, "pair").where("k <> j").select((F.col("x") * 2 + 1 - F.col("side")).alias("e"), (F.col("y") * 2 + F.col("z")).alias("next"))
    labels = cycle_labels(materialize(steps, "trail-steps"))
    chosen = labels.groupBy(F.floor(F.col("e") / 2).alias("x")).agg(F.min_by(F.col("e") % 2, "label").alias("back"))
    turn = numbered.join(chosen, "x").select("edge_id", F.when(F.col("back") == 1, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("back") == 1, F.col("src")).otherwise(F.col("dst")).alias("dst"))
    directed = materialize(turn, "trail-directed")
    if not ends:
        return _ranked(directed, None)
    added = directed.where("edge_id IS NULL").first()
    return _ranked(directed.where("edge_id IS NOT NULL"), (added.dst, added.src))


def depth_first(graph: Graph) -> DataFrame:
    """(id, root, pre, post): places in a depth-first walk of a forest (edges from parent to child), children by id, roots by id.

    The walk down and up every edge is a list of steps; pre counts the steps down before a node, post the steps up. A
    node with two parents or on a circle raises ValueError: on general graphs the order is a walk that nothing can split.
    """
    links = materialize(graph.edges.select("src", "dst").distinct(), "forest-edges")
    twice = links.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.min("dst")).first()[0]
    if twice is not None:
        raise ValueError(f"not a forest: node {twice} has two parents")
    labels = materialize(graph.nodes.select("id").distinct().join(component_labels(links), "id", "left").withColumn("component", F.coalesce("component", "id")), "forest-labels")
    roots = materialize(labels.join(links.select(F.col("dst").alias("id")), "id", "left_anti").select("component", F.col("id").alias("root")), "forest-roots")
    circle = labels.join(roots, "component", "left_anti").agg(F.min("id")).first()[0]
    if circle is not None or links.where("src = dst").limit(1).count():
        raise ValueError(f"not a forest: a circle in the component of node {circle}" if circle is not None else "not a forest: a loop")
    # A node above all roots makes one list of all trees. Ids are replaced by ordinals from 1, the node above is 0.
    ids = materialize(with_ordinal(graph.nodes.select("id").distinct(), "id", name="k").select("id", (F.col("k") + 1).alias("k")), "forest-ids")
    child = ids.select(F.col("id").alias("dst"), F.col("k").alias("c"))
    parent = ids.select(F.col("id").alias("src"), F.col("k").alias("p"))
    tree = child.join(links, "dst", "left").join(parent, "src", "left").select(F.coalesce("p", F.lit(0)).cast("long").alias("p"), "c")
    placed = materialize(with_ordinal(tree, "p", "c", name="k"), "forest-placed")
    ends = placed.groupBy("p").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    first = placed.join(ends, "p").where("k = first").select("p", F.col("c").alias("eldest"))
    after = placed.select((F.col("k") - 1).alias("k"), F.col("p").alias("q"), F.col("c").alias("sibling"))
    # Step down to c is 2 c, step up from c is 2 c + 1.
    down = placed.join(first.select(F.col("p").alias("c"), "eldest"), "c", "left").select((F.col("c") * 2).alias("e"), F.coalesce(F.col("eldest") * 2, F.col("c") * 2 + 1).alias("next"), F.lit(1).alias("downs"), F.lit(0).alias("ups"))
    beside = placed.join(after, "k", "left").withColumn("sibling", F.when(F.col("p") == F.col("q"), F.col("sibling")))
    up = beside.select((F.col("c") * 2 + 1).alias("e"), F.coalesce(F.col("sibling") * 2, F.when(F.col("p") > 0, F.col("p") * 2 + 1)).alias("next"), F.lit(0).alias("downs"), F.lit(1).alias("ups"))
    steps = materialize(down.union(up), "forest-steps")
    ranks = list_ranks(steps, "downs", "ups")
    n = placed.count()
    pre = ranks.where("e % 2 = 0").select(F.floor(F.col("e") / 2).alias("c"), (F.lit(n - 1) - F.col("downs")).cast("long").alias("pre"))
    post = ranks.where("e % 2 = 1").select(F.floor(F.col("e") / 2).alias("c"), (F.lit(n - 1) - F.col("ups")).cast("long").alias("post"))
    named = ids.join(pre, ids.k == pre.c).drop("c").join(post, F.col("k") == post.c).drop("c")
    return named.join(labels, "id").join(roots, "component").select("id", "root", "pre", "post")
