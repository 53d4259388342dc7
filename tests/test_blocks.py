"""Blocks, cut vertices and bridges of deep graphs against brute force, in a number of tables that does not grow with depth."""

import random

from loomgraph import session
from loomgraph.model import Graph
from loomgraph.operators import blocks, choices


def pieces(nodes, edges):
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return len(set(label.values()))


def test_cut_vertices_bridges_and_blocks(spark):
    rng = random.Random(2)
    ids = rng.sample(range(1000), 40)
    pairs = {tuple(sorted(p)) for p in zip(ids[:24], ids[1:25])} | {tuple(sorted(rng.sample(ids, 2))) for _ in range(16)}
    nodes = {x for p in pairs for x in p}
    g = Graph.from_edges(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double"))
    whole = pieces(nodes, pairs)
    cut = {v for v in nodes if pieces(nodes - {v}, [p for p in pairs if v not in p]) > whole - all(v not in p for p in pairs)}
    bridges = {p for p in pairs if pieces(nodes, pairs - {p}) > whole}
    assert {(r.src, r.dst) for r in choices.bridges(g).collect()} == bridges
    members = {}
    for r in blocks.blocks(g).collect():
        members.setdefault((r.block, r.group_id), set()).add(r.id)
    assert {v for v in nodes if sum(v in m for m in members.values()) > 1} == cut
    assert all(min(m) == group for (_, group), m in members.items())
    assert all(sum({a, b} <= m for m in members.values()) == 1 for a, b in pairs)
    # A block of three nodes or more has no cut vertex of its own.
    for m in members.values():
        inner = [p for p in pairs if set(p) <= m]
        assert all(pieces(m - {v}, [p for p in inner if v not in p]) == 1 for v in m)


def test_tables_do_not_grow_with_depth(spark, monkeypatch):
    written, plain = [], session.written
    monkeypatch.setattr(session, "written", lambda df, label, *by: written.append(label) or plain(df, label, *by))
    chain = blocks.rooted_forest(spark.createDataFrame([(k, k + 1) for k in range(120)], "a long, b long")).collect()
    assert {(r.id, r.parent, r.first) for r in chain} == {(k, k - 1 if k else None, k - 1) for k in range(121)}
    assert len(written) < 120
