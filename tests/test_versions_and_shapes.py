"""Batches that run again, simple paths by brute force, sides of polygons, a spiral's radius, containers that go together."""

import math
import random

from pyspark.sql import functions as F

from loomgraph.functions import geometry as g
from loomgraph.model import Graph
from loomgraph.operators import choices, edits, layout
from loomgraph.streaming import changes


def test_a_batch_that_runs_again_reads_what_it_read_before(spark, tmp_path):
    folder = f"file://{tmp_path}"
    batch = lambda *rows: spark.createDataFrame(rows, "seq long, kind string, element_id long, value double")
    state = lambda k: sorted((r.element_id, r.seq, r.n) for r in spark.read.parquet(f"{folder}/version-{k}").collect())
    first, second = batch((1, "updated", 7, 0.5), (2, "updated", 8, 0.5)), batch((3, "updated", 7, 1.5))
    changes.applied_batch(first, 0, folder, changes.merge_last)
    changes.applied_batch(second, 1, folder, changes.merge_last)
    want = [(7, 3, 2), (8, 2, 1)]
    assert state(1) == want
    changes.applied_batch(second, 1, folder, changes.merge_last)
    assert state(1) == want and state(0) == [(7, 1, 1), (8, 2, 1)]
    # A version without its mark was not written to its end, and is not read.
    (tmp_path / "version-2").mkdir()
    assert sorted(changes.versions(spark, folder)) == [0, 1]


def test_a_stream_goes_on_in_its_folder(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "seq long, kind string, element_id long, value double")
    source, folder = str(tmp_path / "log"), f"file://{tmp_path}/state"
    stream = lambda: spark.readStream.schema("seq long, kind string, element_id long, value double").parquet(source)
    rows((1, "updated", 7, 0.5)).write.parquet(source)
    assert changes.applied(changes.only(stream(), "updated"), changes.merge_last, folder).count() == 1
    rows((2, "updated", 7, 0.5), (3, "node_removed", 9, 0.0), (4, "updated", 8, 0.5)).write.mode("append").parquet(source)
    got = changes.applied(changes.only(stream(), "updated"), changes.merge_last, folder)
    assert sorted((r.element_id, r.seq, r.n) for r in got.collect()) == [(7, 2, 2), (8, 4, 1)]


def test_simple_paths_equal_a_search(spark):
    rng = random.Random(8)
    edges = sorted({(rng.randrange(7), rng.randrange(7)) for _ in range(20)} | {(6, 9)})
    rows = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double")
    graph = Graph.from_edges(rows)

    def search(path, goal):
        if path[-1] == goal:
            return [path]
        return [p for a, b in edges if a == path[-1] and b not in path for p in search([*path, b], goal)]

    for start, goal, limit in ((0, 5, 6), (0, 5, 1000), (9, 0, 5), (3, 3, 5)):
        want = sorted(search([start], goal), key=lambda p: (len(p), p))[:limit]
        assert [list(r.path) for r in choices.simple_paths(graph, start, goal, limit).collect()] == want


def test_points_on_a_side_are_inside(spark):
    corners = F.array(*(g.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))))
    places = {(0, 0): True, (2, 0): True, (4, 2): True, (0, 3): True, (2, 1): True, (3, 2.5): True, (2, 2): False, (1, 1): True, (5, 0): False, (-1, 4): False}
    rows = spark.createDataFrame([(float(x), float(y)) for x, y in places], "x double, y double")
    got = rows.select("x", "y", g.inside_polygon(g.point(F.col("x"), F.col("y")), corners).alias("inside")).collect()
    assert {(r.x, r.y): r.inside for r in got} == places


def test_a_spiral_within_a_radius(spark):
    got = {r.id: math.hypot(r.x, r.y) for r in layout.spiral(spark.range(4), radius=100.0).collect()}
    assert all(abs(got[k] - 100 * math.sqrt(k / 4)) < 1e-9 for k in range(4))


def test_containers_that_go_together_hand_their_contents_up(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4)], "id long, parent long")
    graph = Graph.from_edges(spark.createDataFrame([(5, 1, 1.0), (3, 5, 1.0)], "src long, dst long, weight double"), nodes)
    left = edits.remove_nodes(graph, spark.createDataFrame([(2,), (3,), (4,)], "id long"))
    assert sorted((r.id, r.parent) for r in left.nodes.collect() if r.id == 5) == [(5, 1)]
    assert [(r.src, r.dst) for r in left.edges.collect()] == [(5, 1)]
