"""Graph operators on fixed small graphs and on their edge cases."""

import math
import random

import numpy as np
import pytest

from loomgraph.model import Graph
from loomgraph.operators import centrality, choices, cluster, compound, edits, layout, order, reach, spatial
from loomgraph.sources import documents


def graph(spark, edges, nodes=None):
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    ids = None if nodes is None else spark.createDataFrame([(n,) for n in nodes], "id long")
    return Graph.from_edges(e, ids)


DIAMOND = [(0, 1, 1.0), (1, 3, 2.0), (0, 2, 4.0), (2, 3, 1.0)]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_diamond_distances(spark):
    g = graph(spark, DIAMOND)
    start = g.nodes.where("id = 0")
    found = reach.distances(g.edges, start, g.nodes)
    assert rows(found, "id", "dist") == [(0, 0.0), (1, 1.0), (2, 4.0), (3, 3.0)]
    tree = reach.shortest_path_tree(g.edges, start, g.nodes)
    assert rows(reach.tree_paths(tree).where("id = 3"), "path") == [([0, 1, 3],)]
    assert rows(reach.kth_walk_costs(g.edges, 0, 2, g.nodes), "id", "dist") == [(3, 5.0)]


def test_negative_cycle_is_named(spark):
    g = graph(spark, [(0, 1, 1.0), (1, 0, -3.0)])
    with pytest.raises(reach.NegativeCycle) as error:
        reach.distances(g.edges, g.nodes.where("id = 0"), g.nodes)
    assert error.value.node_id in (0, 1)


def test_order_of_cycle_with_tail(spark):
    g = graph(spark, [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0)])
    assert rows(order.strong_components(g), "id", "component") == [(0, 0), (1, 0), (2, 2)]
    assert rows(order.condensation(g), "src", "dst") == [(0, 2)]
    assert order.is_cyclic_directed(g)
    assert rows(order.topological_rounds(graph(spark, DIAMOND)), "id", "round") == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_reduction_drops_the_shortcut(spark):
    g = graph(spark, [*DIAMOND, (0, 3, 10.0)])
    assert rows(order.transitive_reduction(g), "src", "dst") == [(0, 1), (0, 2), (1, 3), (2, 3)]


def test_components_and_forest(spark):
    g = graph(spark, [(0, 1, 2.0), (1, 2, 1.0), (0, 2, 5.0), (5, 6, 1.0)], range(8))
    assert rows(order.component_ids(g), "id", "component") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7)]
    assert rows(order.spanning_forest(g), "src", "dst") == [(0, 1), (1, 2), (5, 6)]
    assert not order.is_bipartite(g)
    assert order.is_bipartite(graph(spark, DIAMOND))


def test_star_and_chain_scores(spark):
    star = graph(spark, [(0, k, 1.0) for k in range(1, 5)])
    assert dict(rows(centrality.betweenness(star), "id", "score")) == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}
    close = dict(rows(centrality.closeness(star), "id", "score"))
    assert close[0] == 1.0 and abs(close[1] - 4 / 7) < 1e-9
    chain = dict(rows(centrality.closeness(graph(spark, [(k, k + 1, 1.0) for k in range(4)])), "id", "score"))
    assert abs(chain[2] - 0.666667) < 1e-6 and abs(chain[0] - 0.4) < 1e-9
    ranks = dict(rows(centrality.pagerank(star, teleport="textbook"), "id", "score"))
    assert abs(sum(ranks.values()) - 1) < 1e-9


def test_loops_and_parallels_in_degrees(spark):
    g = graph(spark, [(0, 0, 1.0), (0, 1, 1.0), (0, 1, 2.0)], [0, 1, 2])
    assert rows(centrality.degree_centrality(g), "id", "score") == [(0, 0.5), (1, 0.5), (2, 0.0)]


NESTED = "id long, label string, parent long, collapsed boolean"


def test_folding(spark):
    nodes = spark.createDataFrame([(0, "a", None, False), (1, "b", None, True), (2, "c", 1, False)], NESTED)
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src long, dst long, weight double")
    assert rows(compound.visibility(nodes), "id", "visible", "proxy") == [(0, True, 0), (1, True, 1), (2, False, 1)]
    assert rows(compound.visible_edges(nodes, edges), "src", "dst") == [(0, 1), (1, 1)]
    with pytest.raises(compound.CompoundError):
        compound.mount(nodes, 1, 2)


def test_two_clouds(spark):
    at = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0), (3, 100.0, 100.0), (4, 101.0, 100.0), (5, 100.0, 101.0)]
    p = spark.createDataFrame(at, "id long, x double, y double")
    clouds = [(0, 0), (0, 1), (0, 2), (3, 3), (3, 4), (3, 5)]
    assert rows(cluster.metric_clusters(p, 2.0), "group_id", "id") == clouds
    assert rows(cluster.kmeans(p, 2, 20), "group_id", "id") == clouds
    assert rows(cluster.kmedoids(p, 2, 20), "group_id", "id") == clouds
    assert rows(cluster.fuzzy_cmeans(p, 2, 30), "group_id", "id") == clouds
    assert spatial.pairs_within(p, 1.0).count() == 4
    with pytest.raises(ValueError):
        cluster.kmeans(p, 7, 5)


def test_two_cliques_flow_apart(spark):
    links = [(a, b, 5.0) for t in ((0, 1, 2), (3, 4, 5)) for a in t for b in t if a != b] + [(2, 3, 0.2), (3, 2, 0.2)]
    groups = rows(cluster.markov_clusters(graph(spark, links), 2.0, 20), "group_id", "id")
    assert groups == [(0, 0), (0, 1), (0, 2), (3, 3), (3, 4), (3, 5)]


def test_empty_graph(spark):
    g = graph(spark, [], [])
    assert order.component_ids(g).count() == 0
    assert order.topological_rounds(g).count() == 0
    assert centrality.degree_centrality(g).count() == 0
    assert layout.circle(g.nodes).count() == 0


def test_documents(spark):
    nodes = spark.createDataFrame([(0, 'say "hi"', None, False), (0, "b", 9, False)], NESTED)
    edges = spark.createDataFrame([(0, 7, math.nan)], "src long, dst long, weight double")
    assert rows(documents.violations(nodes, edges), "check", "id") == [(1, 0), (2, 7), (3, 0), (5, 0)]
    back, _ = documents.from_json_lines(documents.to_json_lines(nodes, edges))
    assert rows(back.fillna(-1), "id", "label", "parent") == [(0, "b", 9), (0, 'say "hi"', -1)]


def test_registry_runs_without_the_corpus_operators(spark):
    from loomgraph.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_path_tree_and_negative_cycle(spark):
    g = graph(spark, DIAMOND)
    tree = reach.shortest_path_tree(g.edges, g.nodes.where("id = 0"), g.nodes)
    assert rows(tree, "id", "dist", "parent") == [(0, 0.0, None), (1, 1.0, 0), (2, 4.0, 0), (3, 3.0, 1)]
    assert {r.id: r.path for r in reach.tree_paths(tree).collect()} == {0: [0], 1: [0, 1], 2: [0, 2], 3: [0, 1, 3]}
    assert reach.negative_cycle(g.edges, 0, g.nodes) == []
    bad = graph(spark, [(9, 0, 1.0), (0, 1, 1.0), (1, 2, -3.0), (2, 0, 1.0), (2, 3, 5.0)])
    assert sorted(reach.negative_cycle(bad.edges, 9, bad.nodes)) == [0, 1, 2]


def test_cliques_and_feedback(spark):
    g = graph(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (2, 3, 1.0), (3, 3, 1.0)], range(5))
    assert sorted(r.clique for r in choices.maximal_cliques(g).collect()) == [[0, 1, 2], [2, 3], [4]]
    gone = choices.feedback_arcs(g)
    assert (3, 3) in rows(gone, "src", "dst") and not order.is_cyclic_directed(edits.remove_edges(g, gone))


def test_edits(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4)], "id long, parent long")
    g = graph(spark, [(1, 2, 1.0), (2, 3, 1.0), (4, 5, 2.0)])
    held = edits.remove_nodes(type(g)(nodes, g.edges), spark.createDataFrame([(2,), (3,)], "id long"))
    assert rows(held.nodes.fillna(-1), "id", "parent") == [(1, -1), (4, 1), (5, 4)] and rows(held.edges, "src", "dst") == [(4, 5)]
    moved = edits.reconnect(g, g.edges.where("src = 4").selectExpr("edge_id", "CAST(NULL AS LONG) AS src", "1L AS dst"))
    assert rows(moved.edges, "src", "dst") == [(1, 2), (2, 3), (4, 1)]
    more = edits.add_edges(g, spark.createDataFrame([(1, 3, 1.0), (1, 99, 1.0)], "src long, dst long, weight double"))
    assert rows(edits.sync_report(g, more), "kind", "change", "n") == [("edge", "added", 1), ("edge", "kept", 3), ("edge", "removed", 0), ("node", "added", 0), ("node", "kept", 5), ("node", "removed", 0)]


def test_dot_text(spark):
    text = ['strict digraph "g" {', "node [shape=box];", "  rank = same", "a -> b -> c [weight=2.5, label=x];", 'd [label="say \\"hi\\" -> there"]', '"odd name" -> a;', "// nothing", "# nothing", "}"]
    nodes, edges = documents.from_dot_lines(spark.createDataFrame([(t,) for t in text], "line string"))
    assert rows(edges, "src", "dst", "weight") == [("a", "b", 2.5), ("b", "c", 2.5), ("odd name", "a", 1.0)]
    assert rows(nodes, "name", "label") == [("a", "a"), ("b", "b"), ("c", "c"), ("d", 'say "hi" -> there'), ("odd name", "odd name")]


def test_linkage_and_affinity(spark):
    points = spark.createDataFrame([(k, float(k), 0.0) for k in range(5)] + [(k, 100.0 + k, 0.0) for k in range(5, 10)], "id long, x double, y double")
    groups = rows(cluster.complete_linkage(points, 1.5), "group_id", "id")
    assert groups == [(0, 0), (0, 1), (2, 2), (2, 3), (4, 4), (5, 5), (5, 6), (7, 7), (7, 8), (9, 9)]
    near = {r.id: r.group_id for r in cluster.affinity_clusters(points, 0.5, 20).collect()}
    assert len(near) == 10 and all((near[a] == near[b]) <= ((a < 5) == (b < 5)) for a in near for b in near)
    with pytest.raises(ValueError):
        cluster.affinity_clusters(points, 0.2)


def test_depth_of_containers(spark):
    def faults(n):
        nodes = spark.createDataFrame([(k, "c", k - 1 if k else None, False) for k in range(n)], "id long, label string, parent long, collapsed boolean")
        return rows(documents.violations(nodes, spark.createDataFrame([], "src long, dst long, weight double")), "check", "id")

    assert faults(9) == [] and faults(10) == [(4, 9)]


def affinities(points, damping, rounds):
    """Affinity propagation with all messages at once."""
    at = np.array(points)
    s = -((at[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
    own = np.eye(len(s), dtype=bool)
    s[own] = np.median(s[~own])
    r, a, lines = np.zeros_like(s), np.zeros_like(s), np.arange(len(s))
    for _ in range(rounds):
        v = a + s
        first = v.argmax(axis=1)
        top = v[lines, first]
        v[lines, first] = -np.inf
        best = np.repeat(top[:, None], len(s), axis=1)
        best[lines, first] = v.max(axis=1)
        r = damping * r + (1 - damping) * (s - best)
        up = np.where(own, 0, np.maximum(r, 0))
        asked = np.where(own, up.sum(axis=0), np.minimum(0, r.diagonal() + up.sum(axis=0) - up))
        a = damping * a + (1 - damping) * asked
    exemplars = np.flatnonzero((r + a).diagonal() > 0)
    return exemplars[s[:, exemplars].argmax(axis=1)]


def test_affinity_in_tiles_equals_that_of_all_messages(spark, monkeypatch):
    n = 45
    monkeypatch.setattr(cluster, "TILE", 20)
    rng = random.Random(n)
    points = [(rng.gauss(9 * (k % 4), 1), rng.gauss(0, 1)) for k in range(n)]
    slots = affinities(points, 0.5, 4)
    least = {int(s): min(k for k in range(n) if slots[k] == s) for s in slots}
    got = cluster.affinity_clusters(spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "id long, x double, y double"), 0.5, 4)
    assert rows(got, "id", "group_id") == [(k, least[int(slots[k])]) for k in range(n)]
