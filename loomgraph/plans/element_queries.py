"""Queries of paths, cliques, edits, documents, geometry, layouts and linkage over the whole tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loomgraph.functions import geometry as g
from loomgraph.functions import predicates as p
from loomgraph.model import Graph
from loomgraph.operators import centrality, choices, cluster, edits, layout, order, reach, spatial
from loomgraph.plans import sql
from loomgraph.plans.graph_queries import DISTANCES, acyclic, rounded, sparse, split
from loomgraph.plans.registry import query
from loomgraph.sources import documents, tables

PATHS = f"WITH RECURSIVE {sql.ACYCLIC}, {DISTANCES.format('id = 0', 60)}, best AS (SELECT id, min(dist) AS dist FROM d GROUP BY 1)"


@query(f"{PATHS} SELECT best.id, best.dist, (SELECT min(e.src) FROM e JOIN best b ON b.id = e.src WHERE e.dst = best.id AND b.dist + e.weight = best.dist AND best.id <> 0) AS parent FROM best")
def shortest_path_tree(spark, sf_dir):
    graph = acyclic(spark, sf_dir)
    return reach.shortest_path_tree(graph.edges, graph.nodes.where("id = 0"), graph.nodes).select("id", "dist", "parent")


@query(f"{PATHS}, t AS (SELECT best.id, (SELECT min(e.src) FROM e JOIN best b ON b.id = e.src WHERE e.dst = best.id AND b.dist + e.weight = best.dist AND best.id <> 0) AS parent FROM best), r(id, route) AS (SELECT 0::BIGINT, [0::BIGINT] UNION ALL SELECT t.id, list_append(route, t.id) FROM r JOIN t ON t.parent = r.id) SELECT id, array_to_string(route, '-') AS path FROM r")
def shortest_path_nodes(spark, sf_dir):
    graph = acyclic(spark, sf_dir)
    tree = reach.shortest_path_tree(graph.edges, graph.nodes.where("id = 0"), graph.nodes)
    return reach.tree_paths(tree).select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


@query("SELECT 1::INTEGER AS closed, true AS negative")
def negative_cycle_found(spark, sf_dir):
    """Over the users' links with 4 taken from each weight: what is found is a closed walk of negative weight; no row where there is none."""
    graph = sparse(spark, sf_dir)
    edges = graph.edges.withColumn("weight", F.col("weight") - 4)
    path = reach.negative_cycle(edges, 0, graph.nodes)
    steps = spark.createDataFrame(list(zip(path, [*path[1:], *path[:1]], strict=True)), "src long, dst long")
    found = steps.join(edges, ["src", "dst"])
    return found.agg((F.count(F.lit(1)) == len(path)).cast("int").alias("closed"), (F.sum("weight") < 0).alias("negative")).where(F.lit(bool(path)))


CLIQUES = f"""WITH RECURSIVE {sql.SPARSE}, {sql.BOTH}, c(members) AS (
  SELECT [id] FROM n UNION ALL SELECT list_append(members, u.dst) FROM c JOIN u ON u.src = members[-1] AND u.dst > members[-1]
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(members) AS m) WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.src = m AND v.dst = u.dst))
) SELECT array_to_string(members, '-') AS clique FROM c WHERE NOT EXISTS (
  SELECT 1 FROM n WHERE NOT list_contains(members, n.id) AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(members) AS m) WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.src = m AND v.dst = n.id)))"""


@query(CLIQUES)
def maximal_cliques(spark, sf_dir):
    found = choices.maximal_cliques(sparse(spark, sf_dir))
    return found.select(F.array_join(F.transform("clique", lambda x: x.cast("string")), "-").alias("clique"))


@query("SELECT false AS cyclic, true AS fewer_than_half")
def feedback_arcs_invariants(spark, sf_dir):
    """What is left has no cycle, and less than half of the edges are taken."""
    graph = sparse(spark, sf_dir)
    gone = choices.feedback_arcs(graph)
    left = edits.remove_edges(graph, gone)
    n, m = gone.count(), graph.edges.count()
    return spark.createDataFrame([(order.is_cyclic_directed(left), 2 * n < m)], "cyclic boolean, fewer_than_half boolean")


def _textbook_sql(rounds: int) -> str:
    out = [f"WITH {sql.SPARSE}, o AS (SELECT n.id, count(e.src) AS out FROM n LEFT JOIN e ON e.src = n.id GROUP BY 1), r0 AS (SELECT id, out, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r FROM o)"]
    for k in range(rounds):
        out.append(f"r{k + 1} AS (SELECT a.id, a.out, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(sum(b.r / b.out), 0) + (SELECT coalesce(sum(r), 0) FROM r{k} WHERE out = 0) / (SELECT count(*) FROM n)) AS r FROM r{k} a LEFT JOIN e ON e.dst = a.id LEFT JOIN r{k} b ON b.id = e.src GROUP BY a.id, a.out)")
    return ", ".join(out) + f" SELECT id, round(r, 6) AS score FROM r{rounds}"


@query(_textbook_sql(8))
def pagerank_textbook_8(spark, sf_dir):
    return rounded(centrality.pagerank(sparse(spark, sf_dir), iterations=8, teleport="textbook"), "score")


@query(f"WITH RECURSIVE {sql.SPARSE}, f AS (SELECT src, dst, weight + (src * 1000 + dst) / 1e9 AS w FROM e), b AS (SELECT src, dst, w FROM f UNION ALL SELECT dst, src, w FROM f), r(src, dst, id) AS (SELECT src, dst, src FROM f UNION SELECT r.src, r.dst, b.dst FROM r JOIN f ON f.src = r.src AND f.dst = r.dst JOIN b ON b.src = r.id AND b.w < f.w) SELECT src, dst FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.src = f.src AND r.dst = f.dst AND r.id = f.dst)")
def minimum_spanning_edges(spark, sf_dir):
    """With weights that are all different, so that one forest alone is right."""
    graph = sparse(spark, sf_dir)
    weighted = graph.edges.withColumn("weight", F.col("weight") + (F.col("src") * 1000 + F.col("dst")) / 1e9)
    return order.spanning_forest(Graph(graph.nodes, weighted)).select("src", "dst")


@query(f"WITH RECURSIVE {sql.SPARSE}, h(id) AS (SELECT 0::BIGINT UNION SELECT dst FROM h JOIN e ON h.id = e.src), r(gone, id) AS (SELECT a.id, 0::BIGINT FROM n a WHERE a.id <> 0 UNION SELECT r.gone, e.dst FROM r JOIN e ON r.id = e.src WHERE e.dst <> r.gone), d AS (SELECT h.id, n.id AS dom FROM h, n WHERE n.id = 0 OR n.id = h.id OR (n.id IN (SELECT id FROM h) AND NOT EXISTS (SELECT 1 FROM r WHERE r.gone = n.id AND r.id = h.id))), k AS (SELECT id, count(*) AS k FROM d GROUP BY 1) SELECT d.id, arg_max(d.dom, k.k) AS idom FROM d JOIN k ON k.id = d.dom WHERE d.id <> d.dom GROUP BY d.id")
def nearest_dominators(spark, sf_dir):
    return choices.immediate_dominators(sparse(spark, sf_dir), 0)


@query(f"WITH {sql.USERS}, n AS (SELECT DISTINCT user_id AS id FROM events), g AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'error' AND value >= (SELECT quantile_cont(value, 0.99) FROM events)) SELECT src, dst, weight FROM e WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)")
def edges_without_nodes(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    limit = events.agg(F.percentile("value", 0.99)).first()[0]
    gone = events.where((F.col("event_type") == "error") & (F.col("value") >= limit)).select(F.col("user_id").alias("id")).distinct()
    return edits.remove_nodes(tables.user_steps(spark, sf_dir), gone).edges.select("src", "dst", "weight")


@query(f"WITH {sql.USERS}, m AS (SELECT max(weight) AS w FROM e) SELECT CASE WHEN weight = w THEN dst ELSE src END AS src, CASE WHEN weight = w THEN src ELSE dst END AS dst, weight FROM e, m")
def reconnected_edges(spark, sf_dir):
    """The heaviest links turned around."""
    graph = tables.user_steps(spark, sf_dir)
    top = graph.edges.agg(F.max("weight")).first()[0]
    moves = graph.edges.where(F.col("weight") == top).select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edits.reconnect(graph, moves).edges.select("src", "dst", "weight")


SYNC = f"WITH {sql.strongest(2)}, f AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS place FROM steps_e WHERE src <> dst) WHERE place <= 3)"


@query(f"{SYNC} SELECT 'node' AS kind, change, n FROM (VALUES ('added', 0::BIGINT), ('removed', 0)) v(change, n) UNION ALL SELECT 'node', 'kept', count(*) FROM n UNION ALL SELECT 'edge', 'added', (SELECT count(*) FROM f) - (SELECT count(*) FROM e) UNION ALL SELECT 'edge', 'removed', 0 UNION ALL SELECT 'edge', 'kept', count(*) FROM e")
def sync_report(spark, sf_dir):
    return edits.sync_report(tables.strongest(spark, sf_dir, 2), sparse(spark, sf_dir))


@query(f"WITH {sql.SPARSE} SELECT 'n' || src AS src, 'n' || dst AS dst, weight FROM e")
def dot_round_trip_edges(spark, sf_dir):
    graph = sparse(spark, sf_dir)
    lines = documents.to_dot_lines(graph.nodes.withColumn("label", F.concat(F.lit('a "name" of '), F.col("id").cast("string"))), graph.edges)
    return documents.from_dot_lines(lines)[1]


@query(f"WITH {sql.SPARSE} SELECT 'n' || id AS name, 'a \"name\" of ' || id AS label FROM n")
def dot_round_trip_nodes(spark, sf_dir):
    graph = sparse(spark, sf_dir)
    lines = documents.to_dot_lines(graph.nodes.withColumn("label", F.concat(F.lit('a "name" of '), F.col("id").cast("string"))), graph.edges)
    return documents.from_dot_lines(lines)[0]


V = "v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS w FROM embeddings)"


def four(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), *(F.get("embedding", k).cast("double").alias(c) for k, c in enumerate("xyzw")))


TURN = "((({2}) - ({0})) * (({5}) - ({1})) - (({3}) - ({1})) * (({4}) - ({0})))"


def _meet_sql(a, b, c, d) -> str:
    """Two segments, each end a pair of expressions, whose ends lie on no common line."""
    turns = [TURN.format(*x) for x in ((*a, *b, *c), (*a, *b, *d), (*c, *d, *a), (*c, *d, *b))]
    return f"(sign({turns[0]}) * sign({turns[1]}) < 0 AND sign({turns[2]}) * sign({turns[3]}) < 0)"


@query(f"WITH {V} SELECT id, {_meet_sql(('0.0', '0.0'), ('x', 'y'), ('z', 'w'), ('w', 'x'))} AS met FROM v")
def segments_meet(spark, sf_dir):
    at = lambda a, b: g.point(F.col(a) if isinstance(a, str) else F.lit(a), F.col(b) if isinstance(b, str) else F.lit(b))
    return four(spark, sf_dir).select("id", g.segments_meet(at(0.0, 0.0), at("x", "y"), at("z", "w"), at("w", "x")).alias("met"))


@query(f"WITH {V} SELECT id, (x BETWEEN -0.05 AND 0.05 AND y BETWEEN -0.05 AND 0.05) OR (z BETWEEN -0.05 AND 0.05 AND w BETWEEN -0.05 AND 0.05) OR " + " OR ".join(_meet_sql(("x", "y"), ("z", "w"), a, b) for a, b in ((("-0.05", "-0.05"), ("-0.05", "0.05")), (("-0.05", "0.05"), ("0.05", "0.05")), (("0.05", "0.05"), ("0.05", "-0.05")), (("0.05", "-0.05"), ("-0.05", "-0.05")))) + " AS met FROM v")
def segments_in_rectangle(spark, sf_dir):
    low, high = g.point(F.lit(-0.05), F.lit(-0.05)), g.point(F.lit(0.05), F.lit(0.05))
    return four(spark, sf_dir).select("id", g.segment_meets_rectangle(g.point(F.col("x"), F.col("y")), g.point(F.col("z"), F.col("w")), low, high).alias("met"))


@query(f"WITH {V} SELECT id, least(x, z) <= 0.05 AND -0.05 <= greatest(x, z) AND least(y, w) <= 0.05 AND -0.05 <= greatest(y, w) AS met FROM v")
def rectangles_meet(spark, sf_dir):
    low, high = g.point(F.least("x", "z"), F.least("y", "w")), g.point(F.greatest("x", "z"), F.greatest("y", "w"))
    return four(spark, sf_dir).select("id", g.rectangles_meet(low, high, g.point(F.lit(-0.05), F.lit(-0.05)), g.point(F.lit(0.05), F.lit(0.05))).alias("met"))


@query(f"WITH {V} SELECT id, round((1 - 0.25) ** 2 * x + 2 * 0.25 * 0.75 * z + 0.25 ** 2 * y, 6) AS qx, round(0.75 ** 3 * x + 3 * 0.25 * 0.75 ** 2 * y + 3 * 0.25 ** 2 * 0.75 * z + 0.25 ** 3 * w, 6) AS cx FROM v")
def curve_points(spark, sf_dir):
    at = lambda a: g.point(F.col(a), F.col(a))
    t = F.lit(0.25)
    rows = four(spark, sf_dir).select("id", g.quadratic(at("x"), at("z"), at("y"), t)["x"].alias("qx"), g.cubic(at("x"), at("y"), at("z"), at("w"), t)["x"].alias("cx"))
    return rounded(rows, "qx", "cx")


@query(f"WITH {V} SELECT id, round(sqrt((z - x) ** 2 + (w - y) ** 2) + sqrt(z ** 2 + w ** 2), 6) AS length, round(least(x, z, 0), 6) AS x0, round(greatest(y, w, 0), 6) AS y1 FROM v")
def polyline_measures(spark, sf_dir):
    points = F.array(g.point(F.col("x"), F.col("y")), g.point(F.col("z"), F.col("w")), g.point(F.lit(0.0), F.lit(0.0)))
    box = g.bounding_box(points)
    return rounded(four(spark, sf_dir).select("id", g.polyline_length(points).alias("length"), box["x0"].alias("x0"), box["y1"].alias("y1")), "length", "x0", "y1")


@query(f"WITH {V} SELECT id, round(least(abs(x), abs(y)), 6) AS d FROM v WHERE x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1")
def corner_distance(spark, sf_dir):
    """To a bent line from (1, 0) over the origin to (0, 1)."""
    line = F.array(*(g.point(F.lit(a), F.lit(b)) for a, b in ((1.0, 0.0), (0.0, 0.0), (0.0, 1.0))))
    rows = four(spark, sf_dir).where("x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1")
    return rounded(rows.select("id", g.polyline_distance(g.point(F.col("x"), F.col("y")), line).alias("d")), "d")


@query(f"WITH {V} SELECT id, x > 0 AND y > 0 AND x + y < 0.1 AS inside FROM v")
def inside_triangle(spark, sf_dir):
    corners = F.array(*(g.point(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (0.1, 0.0), (0.0, 0.1))))
    return four(spark, sf_dir).select("id", g.inside_polygon(g.point(F.col("x"), F.col("y")), corners).alias("inside"))


@query(f"WITH {V} SELECT id, CASE WHEN abs(z - x) >= abs(w - y) THEN round((x + z) / 2, 6) ELSE round(x, 6) END AS bend_x, CASE WHEN abs(z - x) >= abs(w - y) THEN round(y, 6) ELSE round((y + w) / 2, 6) END AS bend_y, round(x - 2 * 0.5, 6) AS loop_x FROM v")
def routes(spark, sf_dir):
    a, b = g.point(F.col("x"), F.col("y")), g.point(F.col("z"), F.col("w"))
    rows = four(spark, sf_dir).select("id", F.get(g.corner_route(a, b), 1).alias("c"), F.get(g.loop_route(a, 0.5, F.lit(1)), 1).alias("l"))
    return rounded(rows.select("id", F.col("c.x").alias("bend_x"), F.col("c.y").alias("bend_y"), F.col("l.x").alias("loop_x")), "bend_x", "bend_y", "loop_x")


@query(f"WITH {V} SELECT id, round(sqrt(x * x + y * y), 6) AS dist FROM v WHERE sqrt(x * x + y * y) <= 0.15")
def disc_query(spark, sf_dir):
    return rounded(spatial.within_disc(tables.vectors(spark, sf_dir), 0.0, 0.0, 0.15), "dist")


LINKED = "SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM v a JOIN v b ON a.id < b.id"


@query("SELECT 0::BIGINT AS too_far, 0::BIGINT AS could_merge")
def complete_linkage_invariants(spark, sf_dir):
    """No group has two points further apart than the threshold, and no two groups could be one."""
    points = tables.vectors(spark, sf_dir)
    groups = cluster.complete_linkage(points, 0.04)
    links = spatial.pairs_within(points, 0.04)
    a, b = groups.select(F.col("id").alias("a"), F.col("group_id").alias("x")), groups.select(F.col("id").alias("b"), F.col("group_id").alias("y"))
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    inside = links.join(a, "a").join(b, "b").where("x = y").groupBy(F.col("x").alias("group_id")).agg(F.count(F.lit(1)).alias("k"))
    far = sizes.join(inside, "group_id", "left").where("coalesce(k, 0) < n * (n - 1) / 2").agg(F.count(F.lit(1)).alias("too_far"))
    between = links.join(a, "a").join(b, "b").where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count(F.lit(1)).alias("k"))
    open_ = between.join(sizes.toDF("x", "nx"), "x").join(sizes.toDF("y", "ny"), "y").where("k = nx * ny").agg(F.count(F.lit(1)).alias("could_merge"))
    return far.join(F.broadcast(open_))


RINGS = f"WITH RECURSIVE {sql.SPARSE}, {sql.BOTH}, s AS (SELECT n.id, count(u.src)::DOUBLE AS score FROM n LEFT JOIN u ON u.src = n.id GROUP BY 1), d AS (SELECT DISTINCT score FROM s), b(k, score) AS (SELECT 0, (SELECT max(score) FROM d) UNION ALL SELECT k + 1, (SELECT max(d.score) FROM d WHERE b.score - d.score >= greatest((SELECT max(score) FROM d) / 4, 1e-9)) FROM b WHERE EXISTS (SELECT 1 FROM d WHERE b.score - d.score >= greatest((SELECT max(score) FROM d) / 4, 1e-9)))"


def degrees(graph):
    d = graph.undirected().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return graph.nodes.select("id").join(d, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


@query(f"{RINGS} SELECT s.id, (count(b.k) - 1)::INTEGER AS ring FROM s JOIN b ON b.score >= s.score GROUP BY s.id")
def concentric_rings(spark, sf_dir):
    return layout.rings(degrees(sparse(spark, sf_dir)))


@query(f"{RINGS} SELECT s.id, (count(b.k) - 1)::INTEGER AS ring FROM s JOIN b ON b.score >= s.score GROUP BY s.id")
def concentric_layout_rings(spark, sf_dir):
    """The ring that a placed node's distance from the middle tells."""
    placed = layout.concentric(degrees(sparse(spark, sf_dir)))
    radius = placed.withColumn("r", F.round(F.hypot("x", "y"), 6))
    radii = [r[0] for r in radius.select("r").distinct().orderBy("r").collect()]
    return radius.select("id", (F.array_position(F.array(*map(F.lit, radii)), F.col("r")) - 1).cast("int").alias("ring"))


@query(f"WITH {sql.SPARSE}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM n) SELECT id, round(sqrt(k) * 20 * cos(k * {math.pi * (3 - math.sqrt(5))!r}), 6) AS x, round(sqrt(k) * 20 * sin(k * {math.pi * (3 - math.sqrt(5))!r}), 6) AS y FROM o")
def layout_spiral(spark, sf_dir):
    return rounded(layout.spiral(sparse(spark, sf_dir).nodes), "x", "y")


@query("SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_append(string_split(p_type, ' '), 'MARKED'))), ' ') AS more, array_to_string(list_filter(list_sort(list_distinct(string_split(p_type, ' '))), lambda x: x <> 'STEEL'), ' ') AS fewer, p_name NOT LIKE '% %' AND p_name <> '' AS one_word, p_size BETWEEN 10 AND 20 AS middle FROM part")
def class_edits(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    classes = F.array_sort(F.array_distinct(F.split("p_type", " ")))
    return part.select(F.col("p_partkey").alias("id"), F.array_join(p.with_class(classes, "MARKED"), " ").alias("more"), F.array_join(p.without_class(classes, "STEEL"), " ").alias("fewer"), p.valid_name(F.col("p_name")).alias("one_word"), p.number_in(F.col("p_size").cast("double"), 10, 20).alias("middle"))


@query("SELECT p_partkey AS id, p_size::DOUBLE + 1 AS size, 2::INTEGER AS keys, 1::INTEGER AS fewer FROM part")
def attribute_edits(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    attrs = F.create_map(F.lit("size"), p.value(F.col("p_size"), "num"))
    changed = p.with_attribute(p.with_attribute(attrs, "size", p.value(F.col("p_size") + 1, "num")), "brand", p.value(F.col("p_brand"), "text"))
    return part.select(F.col("p_partkey").alias("id"), F.element_at(changed, "size")["num"].alias("size"), F.size(changed).alias("keys"), F.size(p.without_attribute(changed, "brand")).alias("fewer"))


@query(f"WITH {sql.USERS} SELECT src AS id, median(weight) AS middle, list_sort(list(dst))[1] AS first_neighbour, count(*) AS n FROM e GROUP BY 1")
def link_summaries(spark, sf_dir):
    """Median weight and sorted neighbours of each user."""
    edges = tables.user_steps(spark, sf_dir).edges
    return edges.groupBy(F.col("src").alias("id")).agg(F.percentile("weight", 0.5).alias("middle"), F.get(F.array_sort(F.collect_list("dst")), 0).alias("first_neighbour"), F.count(F.lit(1)).alias("n"))


@query("SELECT check_ AS \"check\", id FROM (VALUES (1, 3::BIGINT), (2, 77), (3, 5), (4, 10), (4, 11), (4, 9), (5, 1)) v(check_, id)")
def document_faults(spark, sf_dir):
    """A document with one fault of each kind, and a chain of containers that is one too deep."""
    chain = [(100 + k, "c", 100 + k - 1 if k else None, False) for k in range(9)]
    nodes = [(3, "a", None, False), (3, "b", None, False), (5, "c", 999, False), (10, "d", 11, False), (11, "e", 10, False), (1, "f", None, False), (9, "g", 108, False), *chain]
    edges = [(1, 77, 1.0), (1, 3, float("nan"))]
    return documents.violations(spark.createDataFrame(nodes, "id long, label string, parent long, collapsed boolean"), spark.createDataFrame(edges, "src long, dst long, weight double"))


@query()
def affinity_groups(spark, sf_dir):
    return cluster.affinity_clusters(tables.vectors(spark, sf_dir), 0.5)


@query(f"WITH {sql.SPLIT}, {sql.BOTH} SELECT count(*) AS n FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM u)")
def block_edges(spark, sf_dir):
    """Every link lies in exactly one block: the links between the members of each block, added up."""
    from loomgraph.operators import blocks

    graph = split(spark, sf_dir)
    members = blocks.blocks(graph).select("block", "group_id", "id")
    links = graph.undirected().where("src < dst")
    a, b = members.withColumnRenamed("id", "src"), members.withColumnRenamed("id", "dst")
    return links.join(a, "src").join(b, ["group_id", "block", "dst"]).agg(F.count(F.lit(1)).alias("n"))
