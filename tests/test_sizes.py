"""Operators whose rows may not grow with the square of the input: results against brute force, and what they write."""

import math
import random
from collections import deque

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from loomgraph.model import Graph
from loomgraph.operators import centrality, cluster, trails
from loomgraph.plans.view_queries import geo
from loomgraph.session import shared_dir
from loomgraph.sources import tables


def rows_written(spark, label):
    folder = shared_dir(spark).removeprefix("file:")
    files = [f for f in ds.dataset(folder, format="parquet").files if label in f]
    return sum(ds.dataset(f, format="parquet").count_rows() for f in files)


def test_closeness_keeps_no_row_for_each_pair(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("loomgraph.session.shared_dir", lambda _: f"file:{tmp_path}")
    monkeypatch.setitem(globals(), "shared_dir", lambda _: f"file:{tmp_path}")
    # A tree of three children each, a circle across it, and nodes of another part and of none.
    n = 1100
    pairs = [((k - 1) // 3, k) for k in range(1, n - 20)] + [(5, 900), (900, 17)] + [(n - 3, n - 2)]
    graph = Graph.from_edges(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double"), spark.range(n))
    near = {k: set() for k in range(n)}
    for a, b in pairs:
        near[a].add(b), near[b].add(a)

    def score(start):
        hops, queue = {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            for v in near[at] - hops.keys():
                hops[v] = hops[at] + 1
                queue.append(v)
        r, s = len(hops) - 1, sum(hops.values())
        return r / (n - 1) * r / s if s else 0.0

    found = {r.id: r.score for r in centrality.closeness(graph).collect()}
    assert len(found) == n
    assert all(abs(found[k] - score(k)) < 1e-9 for k in range(n))
    assert 0 < rows_written(spark, "close-") < n * n / 10 and not rows_written(spark, "hop-")


def brute_groups(points, threshold, metric):
    far = {"euclidean": math.hypot, "manhattan": lambda x, y: abs(x) + abs(y), "chebyshev": lambda x, y: max(abs(x), abs(y))}[metric]
    low = {i: i for i, _, _ in points}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for k, (i, x, y) in enumerate(points):
        for j, v, w in points[:k]:
            if None not in (x, y, v, w) and far(x - v, y - w) <= threshold:
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {(i, root(i)) for i in low}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_metric_clusters_of_crowds_equal_brute_force(spark, tmp_path, monkeypatch, metric):
    monkeypatch.setattr("loomgraph.session.shared_dir", lambda _: f"file:{tmp_path}")
    monkeypatch.setitem(globals(), "shared_dir", lambda _: f"file:{tmp_path}")
    draw = random.Random(3)
    # Scattered points; crowds that almost or just touch, whose cells have to be split; and places that are none.
    places = [(draw.uniform(0, 30), draw.uniform(0, 30)) for _ in range(200)]
    places += [(100 * k + gap * side + draw.uniform(0, 0.3), draw.uniform(0, 0.3)) for k, gap in enumerate((1.28, 0.99, 1.31), 1) for side in (0, 1) for _ in range(90)]
    places += [(None, 1.0), (float("nan"), 1.0), (float("inf"), 2.0), (float("inf"), 2.0)]
    points = [(i, x, y) for i, (x, y) in enumerate(places)] + [(3, 101.0, 0.1)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    found = {(r.id, r.group_id) for r in cluster.metric_clusters(df, 1.0, metric).collect()}
    assert found == brute_groups(points, 1.0, metric)
    assert rows_written(spark, "component-links") < 5 * len(points)


def test_links_are_dealt_over_more_tasks_the_more_lines_there_are(spark, monkeypatch):
    monkeypatch.setattr("loomgraph.session.ROWS", 500)
    lines = tables.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    graph = tables.supply(spark, "/root/testdata/sf0.001")
    _, drawn = geo(spark, "/root/testdata/sf0.001")
    for links in (graph.edges, graph.undirected(), drawn):
        rows = links.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(rows) > 4 and max(r.n for r in rows) <= 1000 < lines


def test_depth_first_ranks_its_walk_once(spark, monkeypatch):
    calls, ranks = [], trails.list_ranks
    monkeypatch.setattr(trails, "list_ranks", lambda *args: calls.append(args) or ranks(*args))
    links = spark.createDataFrame([(1, 5, 1.0), (1, 2, 1.0), (2, 9, 1.0), (7, 3, 1.0)], "src long, dst long, weight double")
    found = {tuple(r) for r in trails.depth_first(Graph.from_edges(links)).select("id", "root", "pre", "post").collect()}
    assert found == {(1, 1, 0, 3), (2, 1, 1, 1), (9, 1, 2, 0), (5, 1, 3, 2), (7, 7, 4, 5), (3, 7, 5, 4)}
    assert len(calls) == 1
