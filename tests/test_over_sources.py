"""Closeness and betweenness by sources: many tasks and few pairs at once give what plain walks give, and no row for a pair is made."""

import random
from collections import deque

import pytest

from loomgraph import session
from loomgraph.model import Graph
from loomgraph.operators import centrality


def walked(nodes, links):
    """Betweenness and closeness by walks from every node."""
    near = {v: set() for v in nodes}
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    between, close, n = dict.fromkeys(nodes, 0.0), {}, len(nodes)
    for source in nodes:
        hops, paths, order, queue = {source: 0}, {source: 1}, [], deque([source])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in hops:
                    hops[w], paths[w] = hops[v] + 1, 0
                    queue.append(w)
                if hops[w] == hops[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if hops[v] == hops[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != source:
                between[w] += share[w]
        total, r = sum(hops.values()), len(hops) - 1
        close[source] = r / (n - 1) * r / total if total else 0.0
    return {v: x / ((n - 1) * (n - 2)) for v, x in between.items()}, close


def test_sums_over_sources_equal_walks_and_make_no_pairs(spark, monkeypatch):
    rng = random.Random(3)
    nodes = [7 * k - 50 for k in range(260)]
    # A long way, a crowd, and nodes without links.
    links = [(nodes[k], nodes[k + 1]) for k in range(120)] + [(rng.choice(nodes[100:250]), rng.choice(nodes[100:250])) for _ in range(260)]
    graph = Graph.from_edges(spark.createDataFrame([(a, b, 1.0) for a, b in links], "src long, dst long, weight double"), spark.createDataFrame([(v,) for v in nodes], "id long"))
    monkeypatch.setattr(centrality, "CHUNK", 50)
    monkeypatch.setattr(centrality, "LEAST", 20)
    made, plain = [], session.written
    monkeypatch.setattr(session, "written", lambda df, label, *keys: made.append(plain(df, label, *keys)) or made[-1])
    between, close = walked(nodes, links)
    assert {r.id: r.score for r in centrality.betweenness(graph).collect()} == pytest.approx(between)
    assert {r.id: r.score for r in centrality.closeness(graph).collect()} == pytest.approx(close)
    assert max(spark.read.parquet(path).count() for path in made) < 4 * len(nodes)


def test_blocks_of_sources_add_up(monkeypatch):
    import numpy as np

    rng = random.Random(4)
    n = 150
    pairs = sorted({p for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(300)) if a != b for p in ((a, b), (b, a))})
    starts, ends = np.concatenate([[0], np.cumsum(np.bincount([a for a, _ in pairs], minlength=n))]), np.array([b for _, b in pairs])
    between, close = walked(range(n), pairs)
    monkeypatch.setattr(centrality, "WORDS", 1)
    monkeypatch.setattr(centrality, "STEP", 7)
    monkeypatch.setattr(centrality, "HELD", 3 * n)
    (total,) = centrality._between(starts, ends, np.arange(n))
    assert total / ((n - 1) * (n - 2)) == pytest.approx(list(between.values()))
    reached, hops = centrality._come_to(starts, ends, np.arange(n))
    scores = [r / (n - 1) * r / h if h else 0.0 for r, h in zip(reached, hops, strict=True)]
    assert scores == pytest.approx(list(close.values()))
