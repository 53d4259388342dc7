"""Parallel edges, trails, depth-first orders, flows and matchings on small random graphs, against brute force."""

import random
from functools import lru_cache

import pytest

from loomgraph.functions.ordinals import with_sum_before
from loomgraph.model import Graph
from loomgraph.operators import edits, flow, matching, trails


@pytest.fixture(scope="module")
def graph(spark):
    def make(edges, nodes=None):
        rows = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double")
        ids = sorted({x for a, b, _ in edges for x in (a, b)}) if nodes is None else nodes
        return Graph.from_edges(rows, spark.createDataFrame([(x,) for x in ids], "id long"))

    return make


def test_equal_parallel_edges_have_ids_of_their_own(graph, spark, monkeypatch):
    g = graph([(1, 2, 1.0), (1, 2, 1.0), (2, 3, 1.0)])
    ids = {r.edge_id: (r.src, r.dst) for r in g.edges.collect()}
    assert len(ids) == 3
    gone = next(e for e, ends in ids.items() if ends == (1, 2))
    left = edits.remove_edges(g, spark.createDataFrame([(gone,)], "edge_id long"))
    assert sorted((r.src, r.dst) for r in left.edges.collect()) == [(1, 2), (2, 3)]
    moved = edits.reconnect(g, spark.createDataFrame([(gone, None, 3)], "edge_id long, src long, dst long"))
    assert sorted((r.src, r.dst) for r in moved.edges.collect()) == [(1, 2), (1, 3), (2, 3)]
    monkeypatch.setattr("loomgraph.model.BLOCK", 3)
    many = graph([(1, 2, 1.0)] * 10 + [(2, 2, 2.0)])
    assert many.edges.select("edge_id").distinct().count() == many.edges.count() == 11


def test_sums_before_rows_of_one_key_that_lies_in_many_ranges(spark):
    rng = random.Random(2)
    rows = [(1, k, rng.randrange(9)) for k in range(300)] + [(k, 0, k) for k in range(2, 40)] + [(50, k, 1) for k in range(5)]
    got = {(r.key, r.k): r.before for r in with_sum_before(spark.createDataFrame(rows, "key long, k long, v long").repartition(3), ["key"], ["k"], "v").collect()}
    assert got == {(a, k): sum(w for b, j, w in rows if b == a and j < k) for a, k, _ in rows}


def check_trail(found, edges, directed):
    found = sorted((r.step, r.src, r.dst, r.edge_id) for r in found.collect())
    key = (lambda a, b: (a, b)) if directed else (lambda a, b: (min(a, b), max(a, b)))
    assert [r[0] for r in found] == list(range(len(edges)))
    assert all(x[2] == y[1] for x, y in zip(found, found[1:], strict=False))
    assert sorted(key(r[1], r[2]) for r in found) == sorted(key(a, b) for a, b, _ in edges) and len({r[3] for r in found}) == len(edges)
    return found[0][1], found[-1][2]


@pytest.mark.parametrize(("nodes", "steps", "closed"), [(7, 60, False), (3, 25, True)])
def test_trails(graph, nodes, steps, closed):
    rng = random.Random(steps)
    walk = [rng.randrange(nodes) for _ in range(steps)]
    walk[-1] = walk[0] if closed else (walk[0] + 1) % nodes
    edges = [(a, b, 1.0) for a, b in zip(walk, walk[1:], strict=False)]
    rng.shuffle(edges)
    ends = check_trail(trails.euler_trail(graph(edges)), edges, True)
    assert closed or ends == (walk[0], walk[-1])
    turned = [(b, a, w) if rng.random() < 0.5 else (a, b, w) for a, b, w in edges]
    assert closed or set(check_trail(trails.euler_trail_undirected(graph(turned)), turned, False)) == {walk[0], walk[-1]}


@pytest.mark.parametrize(("edges", "node"), [([(0, 1, 1), (2, 3, 1)], 0), ([(0, 1, 1), (0, 2, 1)], 0), ([(0, 1, 1), (1, 0, 1), (2, 2, 1)], 2)])
def test_no_trail(graph, edges, node):
    with pytest.raises(trails.NoTrail) as error:
        trails.euler_trail(graph(edges))
    assert error.value.node_id == node


def test_trails_of_loops_and_of_nothing(graph):
    check_trail(trails.euler_trail(graph([(1, 1, 1), (1, 1, 1), (1, 1, 2)])), [(1, 1, 1)] * 3, True)
    assert trails.euler_trail(graph([], [1, 2])).count() == 0 and trails.euler_trail_undirected(graph([], [1])).count() == 0


def test_depth_first(graph):
    rng = random.Random(4)
    parent = {c: rng.randrange(c) for c in range(1, 40) if rng.random() < 0.85}
    children = {}
    for c, p in parent.items():
        children.setdefault(p, []).append(c)
    expected, counts = {}, [0, 0]

    def walk(v, root):
        pre, counts[0] = counts[0], counts[0] + 1
        for c in sorted(children.get(v, [])):
            walk(c, root)
        expected[v], counts[1] = (root, pre, counts[1]), counts[1] + 1

    for v in range(40):
        if v not in parent:
            walk(v, v)
    got = trails.depth_first(graph([(p, c, 1.0) for c, p in parent.items()], range(40)))
    assert {r.id: (r.root, r.pre, r.post) for r in got.collect()} == expected
    for bad in ([(0, 1, 1), (1, 2, 1), (2, 0, 1)], [(0, 2, 1), (1, 2, 1)], [(0, 0, 1)]):
        with pytest.raises(ValueError, match="not a forest"):
            trails.depth_first(graph(bad))


@pytest.mark.parametrize("seed", [1, 2])
def test_flow_equals_the_least_cut(graph, seed):
    rng = random.Random(seed)
    n = 7
    edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(-1, 9)) for _ in range(24)]
    found = flow.maximum_flow(graph(edges, range(n)), 0, n - 1)
    cuts = [sum(max(w, 0) for a, b, w in edges if mask >> a & 1 and not mask >> b & 1) for mask in range(1 << n) if mask & 1 and not mask >> (n - 1)]
    rows = found.edges.collect()
    assert found.value == min(cuts) == sum(r.capacity for r in flow.cut_edges(found).collect())
    assert all(0 <= r.flow <= r.capacity for r in rows)
    for v in range(n):
        net = sum(r.flow for r in rows if r.src == v) - sum(r.flow for r in rows if r.dst == v)
        assert net == (found.value if v == 0 else -found.value if v == n - 1 else 0)


def test_flow_without_a_way(graph):
    g = graph([(0, 1, 5), (2, 1, 5)])
    assert flow.maximum_flow(g, 0, 2).value == 0 and flow.maximum_flow(g, 0, 0).value == 0 and flow.maximum_flow(g, 0, 9).value == 0
    assert all(r.flow == 0 for r in flow.maximum_flow(g, 0, 2).edges.collect())


def most_pairs(n, links):
    near = {v: [u for u in range(n) if u != v and ((u, v) in links or (v, u) in links)] for v in range(n)}

    @lru_cache(None)
    def best(used):
        v = next((i for i in range(n) if not used >> i & 1), None)
        return 0 if v is None else max([best(used | 1 << v), *(1 + best(used | 1 << v | 1 << u) for u in near[v] if not used >> u & 1)])

    return best(0)


FIVES = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 5), (2, 9)]


@pytest.mark.parametrize(("n", "links"), [(10, FIVES), (13, [(a, b) for a in range(13) for b in range(13) if (a * 7 + b * 5) % 19 == 0]), (7, [(6, k) for k in range(6)])])
def test_matching(graph, spark, n, links):
    g = graph([(a, b, 1.0) for a, b in links], range(n))
    nothing = spark.createDataFrame([], "src long, dst long")
    found = matching.maximum_matching(g, nothing)
    pairs = [(r.src, r.dst) for r in found.pairs.collect()]
    assert len({x for p in pairs for x in p}) == 2 * len(pairs) == 2 * most_pairs(n, frozenset(links))
    assert all(p in links or p[::-1] in links for p in pairs)
    barrier = {r.id for r in found.barrier.collect()}
    label = {v: v for v in range(n) if v not in barrier}
    for _ in range(n):
        for a, b in links:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    odd = sum(list(label.values()).count(c) % 2 for c in set(label.values()))
    assert odd - len(barrier) == n - 2 * len(pairs)


@pytest.mark.parametrize("seed", [3, 4])
def test_strong_components(graph, seed):
    from loomgraph.operators.order import strong_components

    rng = random.Random(seed)
    n = 30
    edges = [(k, (k + 1) % 9, 1) for k in range(9)] + [(k, k + 1, 1) for k in range(9, 29)] + [(rng.randrange(n), rng.randrange(n), 1) for _ in range(12)]
    reach = {v: {v} for v in range(n)}
    for _ in range(n):
        for a, b, _w in edges:
            for v in range(n):
                if a in reach[v]:
                    reach[v].add(b)
    got = {r.id: r.component for r in strong_components(graph(edges, range(n))).collect()}
    assert got == {v: min(u for u in reach[v] if v in reach[u]) for v in range(n)}


def test_parts_with_the_ids_of_suppliers_close_no_circle(spark, tmp_path):
    from loomgraph.plans import registry

    # Part 1000001 is supplied by 2, part 1000002 by 1: one circle where supplier k and part 1000000 + k are one node.
    tables = {"part": ("p_partkey long", [(7,), (1000001,), (1000002,)]), "supplier": ("s_suppkey long", [(1,), (2,)]), "lineitem": ("l_partkey long, l_suppkey long, l_quantity double", [(1000001, 2, 1.0), (1000002, 1, 1.0), (7, 1, 2.0)])}
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = sorted(map(tuple, registry.queries()["strong_components_supply"](spark, str(tmp_path)).collect()))
    assert found == [(x, x) for x in (7, 1000001, 1000001, 1000002, 1000002)]
