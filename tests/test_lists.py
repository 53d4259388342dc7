"""Cycles and lists whose elements are taken out and put back."""

import random

from loomgraph import session
from loomgraph.operators import lists


def counting(monkeypatch, rows):
    """Adds up the rows of all tables that are written."""
    own = session.written

    def written(df, *rest):
        path = own(df, *rest)
        rows.append(df.sparkSession.read.parquet(path).count())
        return path

    monkeypatch.setattr(session, "written", written)
    monkeypatch.setattr(lists, "written", written, raising=False)


def test_cycle_labels_write_few_rows(spark, monkeypatch):
    rng, n = random.Random(3), 1000
    perm = list(range(n - 3))
    rng.shuffle(perm)
    perm += [n - 3, n - 1, n - 2]  # a cycle of one and one of two elements
    want = {}
    for i in range(n):
        ring, j = [], i
        while i not in want and (not ring or j != i):
            ring.append(j)
            j = perm[j]
        want.update((x, min(ring)) for x in ring)
    rows = []
    counting(monkeypatch, rows)
    got = lists.cycle_labels(spark.createDataFrame(list(enumerate(perm)), "e long, next long"), direct=100).collect()
    assert len(got) == n and {r.e: r.label for r in got} == want
    assert sum(rows) <= 6 * n


def test_list_ranks_of_two_lists(spark):
    rng, n = random.Random(5), 1000
    order = rng.sample(range(10 * n), n)
    w = {x: rng.randrange(5) for x in order}
    follow = {a: b for a, b in zip(order, order[1:], strict=False) if a != order[400]}
    want = {}
    for part in (order[:401], order[401:]):
        a = b = 0
        for x in reversed(part):
            want[x] = a, b
            a, b = a + w[x], b + 1
    rows = spark.createDataFrame([(x, follow.get(x), w[x], 1) for x in order], "e long, next long, p int, q int")
    got = lists.list_ranks(rows, "p", "q", direct=100).collect()
    assert len(got) == n and {r.e: (r.p, r.q) for r in got} == want
