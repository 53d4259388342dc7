"""Betweenness level by level: right on any graph, and no table of all pairs."""

import random
from collections import deque

from loomgraph import session
from loomgraph.model import Graph
from loomgraph.operators import centrality


def brandes(n, links):
    near = {v: sorted({b for a, b in links if a == v} | {a for a, b in links if b == v}) for v in range(n)}
    score = dict.fromkeys(range(n), 0.0)
    for s in range(n):
        level, paths, order, queue = {s: 0}, {s: 1}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in level:
                    level[w], paths[w] = level[v] + 1, 0
                    queue.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
        part = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if level[v] == level[w] - 1:
                    part[v] += paths[v] / paths[w] * (1 + part[w])
            if w != s:
                score[w] += part[w]
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_a_deep_graph_keeps_no_table_of_pairs(spark, monkeypatch):
    rng, n, sizes = random.Random(2), 16, []
    links = [(k, k + 1) for k in range(11)] + [(rng.randrange(11, 15), rng.randrange(11, 15)) for _ in range(6)] + [(3, 6)]
    own = session.written

    def written(df, *rest):
        path = own(df, *rest)
        sizes.append(df.sparkSession.read.parquet(path).count())
        return path

    monkeypatch.setattr(session, "written", written)
    monkeypatch.setattr(centrality, "written", written)
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in links], "src long, dst long, weight double")
    got = {r.id: r.score for r in centrality.betweenness(Graph.from_edges(edges, spark.range(n))).collect()}
    want = brandes(n, [x for x in links if x[0] != x[1]])
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)
    assert max(sizes) <= 4 * n
