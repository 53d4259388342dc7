"""Selections by type, label, class, attribute and state, and least cuts against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import predicates as p
from loomgraph.model import Graph
from loomgraph.operators import cuts, selectors
from loomgraph.operators.selectors import Condition, Group


@pytest.fixture(scope="module")
def small(spark):
    """A container that holds a hub with a loop beside it; a second, folded one; a leaf alone."""
    rows = [(0, "main", None, False, None, None), (1, "hub", 4, False, ["hub", "big"], 9.0), (2, "leaf", 4, False, [], None), (3, None, None, False, None, float("nan")), (4, "box", None, False, None, None), (5, "shut", None, True, None, None), (6, "inner", 5, False, ["hub"], 1.0)]
    nodes = spark.createDataFrame(rows, "id long, label string, parent long, collapsed boolean, classes array<string>, score double")
    attrs = F.when(F.col("score").isNotNull(), F.create_map(F.lit("score"), p.value(F.col("score"), "num"), F.lit("label"), p.value(F.lit("shadowed"), "text")))
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 2, 7.5), (2, 2, 1.0), (1, 6, 4.0), (1, 2, 7.5)], "src long, dst long, weight double")
    return Graph.from_edges(edges, nodes.withColumn("attrs", attrs).drop("score"))


@pytest.mark.parametrize(
    ("group", "ids"),
    [
        (Group(), [0, 1, 2, 3, 4, 5, 6]), (Group("edge"), []), (Group("node", label="hub"), [1]), (Group(classes=("hub",)), [1, 6]), (Group(classes=("hub", "big")), [1]),
        (Group(conditions=(Condition("score"),)), [1, 3, 6]), (Group(conditions=(Condition("score", ">", 5),)), [1]), (Group(conditions=(Condition("score", "!=", 9),)), [6]),
        (Group(conditions=(Condition("score", "!=", "text"),)), [1, 3, 6]), (Group(conditions=(Condition("score", ">", "text"),)), []), (Group(conditions=(Condition("missing", "!=", 1),)), []),
        (Group(conditions=(Condition("label", "=", "leaf"),)), [2]), (Group(conditions=(Condition("id", ">=", "main"),)), [0, 5]), (Group(conditions=(Condition("label"),)), [0, 1, 2, 4, 5, 6]),
        (Group(states=("loop",)), [2]), (Group(states=("orphan",)), [3, 4, 5]), (Group(states=("child",)), [1, 2, 6]), (Group(states=("parent",)), [4, 5]),
        (Group(states=("collapsed",)), [5]), (Group(states=("hidden",)), [6]), (Group(states=("visible", "child")), [1, 2]), (Group(label="main", states=("child",)), []),
    ],
)
def test_nodes(small, group, ids):
    assert sorted(r.id for r in selectors.matching_nodes(small, [group]).collect()) == ids


def test_visible_nodes_and_several_groups(small):
    found = selectors.select_nodes(small, [Group(classes=("hub",)), Group(label="leaf"), Group(label="leaf")])
    assert sorted(r.id for r in found.collect()) == [1, 2]
    assert selectors.select_nodes(small, []).count() == 0
    with pytest.raises(ValueError, match="unknown state"):
        Group(states=("selected",))


@pytest.mark.parametrize(
    ("group", "pairs"),
    [
        (Group(), [(0, 1), (1, 2), (1, 6), (2, 2)]), (Group("node"), []), (Group(label="hub"), []), (Group("edge", states=("loop",)), [(2, 2)]), (Group(states=("hidden",)), [(1, 6)]),
        (Group(states=("visible",)), [(0, 1), (1, 2), (2, 2)]), (Group(states=("orphan",)), []), (Group(conditions=(Condition("weight", ">", 3),)), [(1, 2), (1, 6)]), (Group(classes=("x",)), []), (Group(conditions=(Condition("kind"),)), []),
    ],
)
def test_edges(small, group, pairs):
    assert sorted((r.src, r.dst) for r in selectors.matching_edges(small, [group]).collect()) == pairs
    assert sorted((r.src, r.dst) for r in selectors.select_edges(small, [group]).collect()) == [x for x in pairs if x != (1, 6)]


def cliques(n, w):
    return [(a, b, w) for base in (0, n) for a in range(base, base + n) for b in range(base, a)]


CASES = [(10, [*cliques(5, 3), (0, 5, 1), (1, 6, 1), (1, 6, 1)]), (6, [(k, (k + 1) % 6, 2) for k in range(6)] + [(0, 3, 1), (2, 2, 9)])]


@pytest.mark.parametrize(("n", "edges"), CASES)
@pytest.mark.parametrize("by_chance", [True, False])
def test_least_cut(spark, n, edges, by_chance, monkeypatch):
    if by_chance:  # without the exact contractions

        def nothing(links, members):
            light = cuts._degrees(links).orderBy("w", "v").first()
            return links, members, light.w, members.where(F.col("to") == light.v).select("id")

        monkeypatch.setattr(cuts, "_contracted", nothing)
        monkeypatch.setattr(cuts, "ROWS", 2000)
    g = Graph.from_edges(spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double"))
    found = cuts.global_min_cut(g)
    least = min(sum(w for a, b, w in edges if (mask >> a & 1) != (mask >> b & 1)) for mask in range(1, (1 << n) - 1))
    side = {r.id for r in found.side.collect()}
    assert 0 < len(side) < n and found.weight == least == sum(w for a, b, w in edges if (a in side) != (b in side))
    assert sum(r.weight for r in cuts.crossing_edges(g, found).collect()) == least
    assert by_chance != found.proven or n == 6


def test_least_cut_of_parts_and_of_one_node(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    found = cuts.global_min_cut(Graph.from_edges(edges))
    assert found.weight == 0 and {r.id for r in found.side.collect()} == {0, 1} and found.proven
    assert cuts.global_min_cut(Graph.from_edges(edges.where("src = dst"), spark.createDataFrame([(7,)], "id long"))).weight == 0
    with pytest.raises(ValueError, match="positive"):
        cuts.global_min_cut(Graph.from_edges(edges.withColumn("weight", F.lit(-1.0))))


def test_forests_hold_the_ends_of_what_they_leave_over(spark):
    """Every link named by the forests has as much between its ends as the cut they were cut from."""
    rng = random.Random(8)
    links = {}
    for _ in range(40):
        a, b = sorted(rng.sample(range(9), 2))
        links[a, b] = links.get((a, b), 0) + rng.randrange(1, 4)
    rows = spark.createDataFrame([(a, b, float(w)) for (a, b), w in links.items()], "a long, b long, w double")
    held = cuts._held_by_forests(rows, 8.0, 4).collect()
    assert held
    for r in held:
        apart = min(sum(w for (x, y), w in links.items() if (mask >> x & 1) != (mask >> y & 1)) for mask in range(1 << 9) if (mask >> r.a & 1) != (mask >> r.b & 1))
        assert apart >= 8.0
