"""Force-directed and hierarchical places, and groups moved apart, against brute force on small graphs."""

import itertools
import math
import random

import pytest

from loomgraph.model import Graph
from loomgraph.operators import force, hierarchy, separation


def graph_of(spark, edges, nodes):
    rows = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double")
    return Graph.from_edges(rows, spark.createDataFrame([(x,) for x in nodes], "id long"))


def pushed(points, a, f):
    """What all other points do to one, pair by pair."""
    sx = sy = 0.0
    for b, (x, y) in points.items():
        if b == a:
            continue
        dx, dy = x - points[a][0], y - points[a][1]
        far, wide = math.hypot(dx, dy), max(abs(dx), abs(dy))
        if wide <= f.node_size:
            k = f.overlap * math.hypot(f.node_size - abs(dx), f.node_size - abs(dy))
        else:
            k = 2 * f.repulsion / max(1.0, far * (1 - f.node_size / wide)) ** 2
        sx, sy = sx - k * dx / max(far, 0.5), sy - k * dy / max(far, 0.5)
    return sx, sy


# Smaller cells put means where single nodes were, at distances of a few node sizes.
@pytest.mark.parametrize(("leaf", "bound"), [(16, 0.02), (2, 0.05)])
def test_repulsion_is_near_that_of_all_pairs(spark, monkeypatch, leaf, bound):
    monkeypatch.setattr(force, "LEAF", leaf)
    rng = random.Random(leaf)
    points = {k: (rng.gauss(0, 400), rng.gauss(0, 200)) for k in range(250)}
    points |= {1000 + k: (900 + rng.random(), 300 + rng.random()) for k in range(20)}
    f = force.Forces()
    got = {r.id: (r.fx, r.fy) for r in force.repulsion(spark.createDataFrame([(k, *p) for k, p in points.items()], "id long, x double, y double"), f).collect()}
    want = {a: pushed(points, a, f) for a in points}
    assert got.keys() == want.keys()
    error = sum(math.dist(got[a], want[a]) for a in points) / sum(math.hypot(*want[a]) for a in points)
    assert error < bound
    # What the nodes do to each other comes to nothing as a whole, but for the means of far cells.
    assert math.hypot(*(sum(v[k] for v in got.values()) for k in (0, 1))) < bound * sum(math.hypot(*v) for v in want.values())


def test_nodes_at_one_place_part(spark):
    rows = [(k, 5.0, 5.0) for k in range(2)] + [(9, 500.0, 5.0)]
    got = {r.id: (r.fx, r.fy) for r in force.repulsion(spark.createDataFrame(rows, "id long, x double, y double"), force.Forces()).collect()}
    assert math.hypot(*got[0]) > 50 and math.dist(got[0], (-got[1][0], -got[1][1])) < 1
    crowd = [(k, 5.0, 5.0) for k in range(40)] + [(99, 500.0, 5.0)]
    got = force.repulsion(spark.createDataFrame(crowd, "id long, x double, y double"), force.Forces()).collect()
    assert len(got) == 41 and all(math.isfinite(r.fx) and math.isfinite(r.fy) for r in got)


def stepped(points, edges, f, heat, fixed):
    """One round over all pairs."""
    mx, my = (sum(p[k] for p in points.values()) / len(points) for k in (0, 1))
    out = {}
    for a, (x, y) in points.items():
        fx, fy = pushed(points, a, f)
        for s, d in edges:
            if a in (s, d) and s != d and s in points and d in points:
                ox, oy = points[d if a == s else s]
                dx, dy = ox - x, oy - y
                shrink = 1 - f.node_size / max(abs(dx), abs(dy))
                far = math.hypot(dx, dy)
                pull = (f.ideal_length - far * abs(shrink)) ** 2 / f.elasticity * math.copysign(1, shrink) / far
                fx, fy = fx + pull * dx, fy + pull * dy
        away = math.hypot(mx - x, my - y)
        if away > 1:
            fx, fy = fx + f.gravity * (mx - x) / away, fy + f.gravity * (my - y) / away
        scale = 0.0 if a in fixed else min(1.0, heat / max(math.hypot(fx, fy), 1e-300))
        out[a] = (x + scale * fx, y + scale * fy)
    return out


def test_force_layout_equals_rounds_over_all_pairs(spark):
    # One node in a cell of the coarsest level, so that no mean stands for several.
    at = {3 * i + j: (i * 130.0 + 7 * j, j * 140.0 - 5 * i) for i in range(3) for j in range(3)}
    edges = [(k, (k + 1) % 9) for k in range(9)] + [(3, 3), (5, 77), (0, 1)]
    f = force.Forces(iterations=9, initial_temp=9.0, cooling=0.3, min_temp=1.0)
    g = graph_of(spark, edges, range(9))
    known = spark.createDataFrame([(k, *p) for k, p in at.items()], "id long, x double, y double")
    got = {r.id: (r.x, r.y) for r in force.force_layout(g, known, spark.createDataFrame([(0,)], "id long"), f).collect()}
    start, heat = at, f.initial_temp
    while heat >= f.min_temp:
        at, heat = stepped(at, edges, f, heat, {0}), heat * f.cooling
    assert got.keys() == at.keys() and got[0] == start[0]
    assert all(math.dist(got[k], at[k]) < 1e-6 < math.dist(at[k], start[k]) for k in at if k)


def test_seeds(spark):
    known = spark.createDataFrame([(0, 10.0, 20.0), (1, 400.0, None), (8, 1.0, 1.0)], "id long, x double, y double")
    f = force.Forces()
    at = {r.id: (r.x, r.y) for r in force.seeded(spark.range(4), known, f).collect()}
    assert at.keys() == {0, 1, 2, 3} and at[0] == (10.0, 20.0)
    assert all(abs(math.dist(at[k], at[0]) - 96) < 1e-6 for k in (1, 2, 3))
    assert force.force_layout(graph_of(spark, [], [])).count() == 0


def crossed(hops):
    return sum(1 for (k, a, b), (m, c, d) in itertools.combinations(hops, 2) if k == m and (a - c) * (b - d) < 0)


def test_crossings_equal_all_pairs(spark):
    rng = random.Random(4)
    hops = list({(rng.randrange(3), rng.randrange(12), rng.randrange(9)) for _ in range(150)})
    assert hierarchy.crossings(spark.createDataFrame(hops, "layer int, a long, b long")) == crossed(hops)
    assert hierarchy.crossings(spark.createDataFrame([], "layer int, a long, b long")) == 0


def test_layers_bends_and_circles(spark):
    # 0 -> 1 -> 2 <-> 3 -> 4, a long link 0 -> 4, a source 5 -> 4, a lone node 6, a loop at 1.
    g = graph_of(spark, [(0, 1), (1, 2), (2, 3), (3, 2), (3, 4), (0, 4), (5, 4), (1, 1)], range(7))
    found = hierarchy.layered_order(g)
    layer = {r.id: r.layer for r in found.places.collect()}
    assert layer == {0: 0, 1: 1, 2: 2, 3: 2, 4: 3, 5: 0, 6: 0}
    assert sorted((r.src, r.dst, r.layer) for r in found.bends.collect()) == [(0, 4, 1), (0, 4, 2), (5, 4, 1), (5, 4, 2)]
    nodes, bends = hierarchy.hierarchical(found)
    y = {r.id: r.y for r in nodes.collect()}
    assert y[0] < y[1] < y[2] == y[3] < y[4] and y[0] == y[5] == y[6]
    assert {r.y for r in bends.collect()} == {y[1], y[2]}
    up = {r.id: r.y for r in hierarchy.hierarchical(found, direction="up")[0].collect()}
    assert all(abs(up[k] + y[k]) < 1e-9 for k in y)
    with pytest.raises(ValueError):
        hierarchy.hierarchical(found, direction="round")
    assert hierarchy.layered_order(graph_of(spark, [], [])).places.count() == 0


def test_sweeps_take_crossings_away(spark):
    n = 8
    g = graph_of(spark, [(k, 100 + n - 1 - k) for k in range(n)] + [(100 + k, 200 + (k * 3) % n) for k in range(n)], [*range(n), *range(100, 100 + n), *range(200, 200 + n)])
    found = hierarchy.layered_order(g)
    at = {r.id: (r.layer, r.place) for r in found.places.collect()}
    hops = [(at[r.src][0], at[r.src][1], at[r.dst][1]) for r in g.edges.collect()]
    assert found.crossings_before > 20 and found.crossings_after == crossed(hops) == 0
    assert all(sorted(p for k, p in at.values() if k == layer) == list(range(n)) for layer in range(3))


def test_groups_part_and_containers_lie_over_their_contents(spark):
    nodes = [(1, None, False), (2, None, False), (3, 1, False), (4, 1, False), (5, 2, False), (6, 2, False), (7, None, False), (8, None, True), (9, 8, False)]
    places = [(k, float(k % 4) * 30, float(k)) for k in range(1, 10)]
    nodes = spark.createDataFrame(nodes, "id long, parent long, collapsed boolean")
    moved = separation.separated(nodes, spark.createDataFrame(places, "id long, x double, y double"), 12.0)
    at = {r.id: (r.x, r.y) for r in moved.collect()}
    groups = [(1, 3, 4), (2, 5, 6), (7,), (8,)]
    boxes = sorted((min(at[k][0] for k in g) - 12, max(at[k][0] for k in g) + 12) for g in groups)
    assert boxes[0][0] == 0 and all(abs(b[0] - a[1] - separation.GAP) < 1e-9 for a, b in itertools.pairwise(boxes))
    assert at[9] == (30.0, 9.0) and all(at[k][1] == k for k in at)
    assert at[4][0] - at[3][0] == -90.0
    over = {r.id: (r.x, r.y) for r in separation.over_contents(nodes, moved).collect()}
    assert over[1] == ((at[3][0] + at[4][0]) / 2, 3.5) and over[7] == at[7] and over[8] == at[8]
    one = nodes.where("id IN (1, 3)")
    still = separation.separated(one, spark.createDataFrame(places[:3], "id long, x double, y double"))
    assert sorted(tuple(r) for r in still.collect()) == sorted(places[:3])
