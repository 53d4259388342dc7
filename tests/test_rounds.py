"""Topological rounds of deep graphs with branches and circles, in a number of tables that grows slower than their depth."""

import random

from loomgraph.model import Graph
from loomgraph.operators import order


def test_deep_graphs_take_few_rounds(spark, monkeypatch):
    rng = random.Random(3)
    at = rng.sample(range(1000), 130)
    pairs = {(at[k], at[k + 1]) for k in range(89)} | {(at[90 + k], at[rng.randrange(90)]) for k in range(20)}
    pairs |= {tuple(at[x] for x in sorted(rng.sample(range(90), 2))) for _ in range(4)}
    pairs |= {(at[110], at[111]), (at[111], at[112]), (at[112], at[110]), (at[112], at[113]), (at[114], at[114])}
    nodes = set(at[:115])
    found, left = {}, set(nodes)
    k = 0
    while free := {v for v in left if not any(b == v and a in left for a, b in pairs)}:
        found.update(dict.fromkeys(free, k))
        left, k = left - free, k + 1
    rounds, plain = [], order.written
    monkeypatch.setattr(order, "written", lambda df, label: rounds.append(label) or plain(df, label))
    g = Graph(spark.createDataFrame([(x,) for x in nodes], "id long"), spark.createDataFrame(list(pairs), "src long, dst long"))
    assert {r.id: r.round for r in order.topological_rounds(g).collect()} == found
    assert k > 80 and len(rounds) < 60
