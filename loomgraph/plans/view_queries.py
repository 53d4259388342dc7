"""Queries of sets, containers, predicates, groupings, layouts, styles, documents and change streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loomgraph.functions import geometry as g
from loomgraph.functions import predicates as p
from loomgraph.operators import cluster, compound, layout, sets, spatial, style
from loomgraph.plans import sql
from loomgraph.plans.graph_queries import acyclic, rounded, sparse, split
from loomgraph.plans.registry import query
from loomgraph.session import dealt, tasks_for
from loomgraph.sources import documents, tables
from loomgraph.streaming import changes

GEO = """geo AS (
  SELECT c_custkey AS id, c_name AS label, 2000000 + c_nationkey::BIGINT AS parent, false AS collapsed FROM customer
  UNION ALL SELECT 1000000 + s_suppkey, s_name, 2000000 + s_nationkey::BIGINT, false FROM supplier
  UNION ALL SELECT 2000000 + n_nationkey::BIGINT, n_name, 3000000 + n_regionkey::BIGINT, n_nationkey % 5 = 0 FROM nation
  UNION ALL SELECT 3000000 + r_regionkey::BIGINT, r_name, NULL, false FROM region
), ge AS (
  SELECT o_custkey AS src, 1000000 + l_suppkey AS dst, count(*)::DOUBLE AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2
), up AS (
  SELECT id, parent AS ancestor, 1 AS depth FROM geo WHERE parent IS NOT NULL
  UNION ALL SELECT a.id, b.parent, 2 FROM geo a JOIN geo b ON a.parent = b.id WHERE b.parent IS NOT NULL
), seen AS (
  SELECT geo.id, geo.collapsed OR coalesce(bool_or(a.collapsed), false) = false AS visible
  FROM geo LEFT JOIN up ON up.id = geo.id LEFT JOIN geo a ON a.id = up.ancestor GROUP BY geo.id, geo.collapsed
), proxies AS (
  SELECT s.id, s.visible, CASE WHEN s.visible THEN s.id ELSE (SELECT arg_min(up.ancestor, up.depth) FROM up JOIN seen v ON v.id = up.ancestor WHERE up.id = s.id AND v.visible) END AS proxy FROM seen s
)"""


def geo(spark, sf_dir):
    """Customers and suppliers in nations in regions; every fifth nation is collapsed."""
    t = lambda name: tables.table(spark, sf_dir, name)
    part = lambda df, id_, label, parent, closed: df.select(id_.cast("long").alias("id"), F.col(label).alias("label"), parent.cast("long").alias("parent"), closed.alias("collapsed"))
    nodes = part(t("customer"), F.col("c_custkey"), "c_name", F.col("c_nationkey") + 2000000, F.lit(False))
    nodes = nodes.union(part(t("supplier"), F.col("s_suppkey") + 1000000, "s_name", F.col("s_nationkey") + 2000000, F.lit(False)))
    nodes = nodes.union(part(t("nation"), F.col("n_nationkey") + 2000000, "n_name", F.col("n_regionkey") + 3000000, F.col("n_nationkey") % 5 == 0))
    nodes = nodes.union(part(t("region"), F.col("r_regionkey") + 3000000, "r_name", F.lit(None), F.lit(False)))
    tasks = tasks_for(t("lineitem").count())
    orders, items = dealt(t("orders").select("o_orderkey", "o_custkey"), tasks, "o_orderkey"), dealt(t("lineitem").select("l_orderkey", "l_suppkey"), tasks, "l_orderkey")
    lines = orders.join(items, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"))
    edges = dealt(lines, tasks, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return nodes, edges


@query(f"WITH {GEO} SELECT id, ancestor, depth::INTEGER AS depth FROM up")
def compound_ancestors(spark, sf_dir):
    return compound.ancestors(geo(spark, sf_dir)[0])


@query(f"WITH {GEO} SELECT id, depth::INTEGER AS depth FROM up WHERE ancestor = 3000001")
def compound_descendants(spark, sf_dir):
    return compound.descendants(geo(spark, sf_dir)[0], 3000001)


@query(f"WITH {GEO} SELECT id, visible, proxy FROM proxies")
def compound_visibility(spark, sf_dir):
    return compound.visibility(geo(spark, sf_dir)[0])


@query(f"WITH {GEO} SELECT a.proxy AS src, b.proxy AS dst FROM ge JOIN proxies a ON a.id = ge.src JOIN proxies b ON b.id = ge.dst")
def compound_visible_edges(spark, sf_dir):
    return compound.visible_edges(*geo(spark, sf_dir))


@query(f"WITH {GEO} SELECT coalesce((SELECT arg_max(ancestor, depth) FROM up WHERE up.id = s.id), s.id) AS group_id, s.id FROM seen s WHERE visible")
def compound_groups(spark, sf_dir):
    return compound.groups(geo(spark, sf_dir)[0])


@query(f"WITH {GEO} SELECT count(*) AS n_violations FROM ge WHERE src NOT IN (SELECT id FROM geo)")
def document_violations(spark, sf_dir):
    return documents.violations(*geo(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_violations"))


@query(f"WITH {GEO} SELECT id, label, parent, collapsed FROM geo")
def json_round_trip(spark, sf_dir):
    return documents.from_json_lines(documents.to_json_lines(*geo(spark, sf_dir)))[0].select("id", "label", "parent", "collapsed")


@query(f"WITH {GEO} SELECT src, dst, weight FROM ge")
def json_round_trip_edges(spark, sf_dir):
    return documents.from_json_lines(documents.to_json_lines(*geo(spark, sf_dir)))[1].select("src", "dst", "weight")


@query(f"WITH {GEO} SELECT 1 AS part, '  n' || id || ' [label=\"' || label || '\"];' AS line FROM geo UNION ALL SELECT 2, '  n' || src || ' -> n' || dst || ' [weight=\"' || weight || '\"];' FROM ge UNION ALL SELECT 0, 'digraph {{' UNION ALL SELECT 3, '}}'")
def dot_lines(spark, sf_dir):
    return documents.to_dot_lines(*geo(spark, sf_dir))


@query(f"WITH {GEO}, d AS (SELECT id, 'new ' || label AS label FROM geo WHERE id % 3 = 0 UNION ALL SELECT 9000000, 'x'), m AS (SELECT coalesce(geo.id, d.id) AS id, coalesce(d.label, geo.label) AS label, CASE WHEN geo.id IS NULL THEN 'added' WHEN d.id IS NULL THEN 'kept' ELSE 'updated' END AS change FROM geo FULL JOIN d ON geo.id = d.id) SELECT id, label, change FROM m")
def document_merge(spark, sf_dir):
    nodes, _ = geo(spark, sf_dir)
    new = nodes.where("id % 3 = 0").withColumn("label", F.concat(F.lit("new "), "label"))
    new = new.union(spark.createDataFrame([(9000000, "x", None, False)], nodes.schema))
    return documents.merge(nodes, new).select("id", "label", "change")


def set_sides(spark, sf_dir):
    graph = split(spark, sf_dir)
    return graph.edges.select(F.col("src").alias("id")).distinct(), graph.edges.select(F.col("dst").alias("id")).distinct(), graph


for _name, _op in (("union", "UNION"), ("intersection", "INTERSECT"), ("difference", "EXCEPT")):

    def _set(spark, sf_dir, name=_name):
        a, b, _ = set_sides(spark, sf_dir)
        return getattr(sets, name)(a, b)

    _set.__name__ = f"set_{_name}"
    query(f"WITH {sql.SPLIT} SELECT src AS id FROM e {_op} SELECT dst FROM e")(_set)


@query(f"WITH {sql.SPLIT} SELECT id FROM n EXCEPT SELECT src FROM e")
def set_complement(spark, sf_dir):
    a, _, graph = set_sides(spark, sf_dir)
    return sets.complement(a, graph.nodes)


@query(f"WITH {sql.SPLIT}, {sql.BOTH} SELECT id FROM (VALUES (2::BIGINT), (5)) s(id) UNION SELECT dst FROM u WHERE src IN (2, 5)")
def set_neighborhood(spark, sf_dir):
    graph = split(spark, sf_dir)
    return sets.neighborhood(graph.edges, spark.createDataFrame([(2,), (5,)], "id long"))


@query(f"WITH {sql.SPARSE} SELECT src, dst FROM e WHERE src < 12 AND dst < 12")
def induced_edges(spark, sf_dir):
    graph = sparse(spark, sf_dir)
    return sets.induced_edges(graph.edges, graph.nodes.where("id < 12")).select("src", "dst")


def placed_parts(spark, sf_dir):
    parts = tables.table(spark, sf_dir, "part")
    attrs = F.create_map(F.lit("size"), p.value(F.col("p_size"), "num"), F.lit("brand"), p.value(F.col("p_brand"), "text"), F.lit("big"), p.value(F.col("p_size") > 25, "flag"))
    return parts.select(F.col("p_partkey").alias("id"), attrs.alias("attrs"), F.array_sort(F.split("p_type", " ")).alias("classes"), F.col("p_retailprice").alias("price"))


@query("SELECT p_partkey AS id FROM part WHERE p_size >= 10 AND p_size < 30 AND list_contains(string_split(p_type, ' '), string_split((SELECT min(p_type) FROM part), ' ')[1])")
def select_by_attribute_and_class(spark, sf_dir):
    name = tables.table(spark, sf_dir, "part").agg(F.split(F.min("p_type"), " ")[0]).first()[0]
    rows = placed_parts(spark, sf_dir)
    wanted = p.all_of(p.attribute(F.col("attrs"), "size", ">=", 10), p.attribute(F.col("attrs"), "size", "<", 30), p.has_classes(F.col("classes"), name))
    return rows.where(wanted).select("id")


@query("SELECT p_partkey AS id FROM part WHERE NOT (p_size > 25)")
def select_by_flag(spark, sf_dir):
    return placed_parts(spark, sf_dir).where(p.attribute(F.col("attrs"), "big", "!=", True)).select("id")


@query("SELECT p_partkey AS id FROM part")
def select_other_kind(spark, sf_dir):
    """A value of another kind matches "!=" alone."""
    rows = placed_parts(spark, sf_dir)
    hit = p.any_of(p.attribute(F.col("attrs"), "brand", ">", 3), p.attribute(F.col("attrs"), "none", "!=", 3), p.attribute(F.col("attrs"), "brand", "!=", 3))
    return rows.where(hit).select("id")


VECTORS = "v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
NEAR = "w AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id WHERE {0} <= 0.04)"
D2 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(f"WITH {VECTORS}, {NEAR.format(D2)} SELECT a, b FROM w")
def pairs_within(spark, sf_dir):
    return spatial.pairs_within(tables.vectors(spark, sf_dir), 0.04).select("a", "b")


def _cluster_sql(d: str) -> str:
    return f"WITH RECURSIVE {VECTORS}, {NEAR.format(d)}, u AS (SELECT a AS src, b AS dst FROM w UNION SELECT b, a FROM w), c(id, other) AS (SELECT id, id FROM v UNION SELECT c.id, u.dst FROM c JOIN u ON c.other = u.src) SELECT min(other) AS group_id, id FROM c GROUP BY id"


@query(_cluster_sql(D2))
def metric_clusters_euclidean(spark, sf_dir):
    return cluster.metric_clusters(tables.vectors(spark, sf_dir), 0.04)


@query(_cluster_sql("abs(a.x - b.x) + abs(a.y - b.y)"))
def metric_clusters_manhattan(spark, sf_dir):
    return cluster.metric_clusters(tables.vectors(spark, sf_dir), 0.04, "manhattan")


@query(_cluster_sql("greatest(abs(a.x - b.x), abs(a.y - b.y))"))
def metric_clusters_chebyshev(spark, sf_dir):
    return cluster.metric_clusters(tables.vectors(spark, sf_dir), 0.04, "chebyshev")


ALL_VECTORS = "v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def _kmeans_sql(k: int, rounds: int) -> str:
    out = [f"WITH {ALL_VECTORS}, c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS slot, x, y FROM v ORDER BY id LIMIT {k})"]
    for r in range(rounds):
        out.append(f"a{r} AS (SELECT v.id, any_value(v.x) AS x, any_value(v.y) AS y, arg_min(c.slot, ((v.x - c.x) ** 2 + (v.y - c.y) ** 2, c.slot)) AS slot FROM v, c{r} c GROUP BY v.id)")
        out.append(f"c{r + 1} AS (SELECT c.slot, coalesce(avg(a.x), any_value(c.x)) AS x, coalesce(avg(a.y), any_value(c.y)) AS y FROM c{r} c LEFT JOIN a{r} a USING (slot) GROUP BY c.slot)")
    return ", ".join(out) + f" SELECT min(id) OVER (PARTITION BY slot) AS group_id, id FROM a{rounds - 1}"


@query(_kmeans_sql(4, 3))
def kmeans_4(spark, sf_dir):
    return cluster.kmeans(tables.vectors(spark, sf_dir), 4, 3)


@query()
def kmedoids_4(spark, sf_dir):
    return cluster.kmedoids(tables.vectors(spark, sf_dir), 4, 5)


@query()
def fuzzy_cmeans_3(spark, sf_dir):
    return cluster.fuzzy_cmeans(tables.vectors(spark, sf_dir), 3, 5)


def _markov_sql(rounds: int) -> str:
    start = f"WITH {sql.SPARSE}, s AS (SELECT row, col, sum(val) AS val FROM (SELECT id AS row, id AS col, 1.0::DOUBLE AS val FROM n UNION ALL SELECT dst, src, weight FROM e) GROUP BY 1, 2), m0 AS (SELECT row, col, val / sum(val) OVER (PARTITION BY col) AS val FROM s)"
    for r in range(rounds):
        start += f", q{r} AS (SELECT a.row, b.col, sum(a.val * b.val) ** 2.0 AS val FROM m{r} a JOIN m{r} b ON a.col = b.row GROUP BY 1, 2), m{r + 1} AS (SELECT row, col, val FROM (SELECT row, col, val / sum(val) OVER (PARTITION BY col) AS val FROM q{r}) WHERE val >= 1e-9)"
    return start + f" SELECT row AS r, col AS c, round(val, 6) AS val FROM m{rounds} WHERE val >= 1e-5"


@query(_markov_sql(2))
def markov_matrix_2(spark, sf_dir):
    m = cluster.markov_matrix(sparse(spark, sf_dir), 2.0, 2).where("val >= 1e-5")
    return rounded(m.select(F.col("row").alias("r"), F.col("col").alias("c"), "val"), "val")


@query()
def markov_clusters(spark, sf_dir):
    return cluster.markov_clusters(sparse(spark, sf_dir), 2.0, 15)


@query(f"SELECT n_nationkey::BIGINT AS id, round(greatest(100.0, 40.0 / (2 * sin(pi() / 25))) * cos((row_number() OVER (ORDER BY n_nationkey) - 1) * {2 * math.pi / 25!r}), 6) AS x, round(greatest(100.0, 40.0 / (2 * sin(pi() / 25))) * sin((row_number() OVER (ORDER BY n_nationkey) - 1) * {2 * math.pi / 25!r}), 6) AS y FROM nation")
def layout_circle(spark, sf_dir):
    return rounded(layout.circle(tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))), "x", "y")


@query("SELECT c_custkey AS id, (k % w) * 50.0 AS x, floor(k / w) * 50.0 AS y FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k, ceil(sqrt((SELECT count(*) FROM customer)))::BIGINT AS w FROM customer)")
def layout_grid(spark, sf_dir):
    return layout.grid(tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@query(f"WITH RECURSIVE {sql.SPARSE}, h(id, level) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, level + 1 FROM h JOIN e ON h.id = e.src WHERE level < 60), l AS (SELECT n.id, coalesce(min(level), -1) AS level FROM n LEFT JOIN h USING (id) GROUP BY 1) SELECT id, (row_number() OVER (PARTITION BY level ORDER BY id) - 1 - (count(*) OVER (PARTITION BY level) - 1) / 2.0) * 40.0 AS x, level * 80.0 AS y FROM l")
def layout_layered(spark, sf_dir):
    graph = sparse(spark, sf_dir)
    return layout.layered(graph, graph.nodes.where("id = 0"))


@query(f"WITH RECURSIVE {sql.ACYCLIC}, d(id, k) AS (SELECT id, 0 FROM n UNION SELECT dst, k + 1 FROM d JOIN e ON d.id = e.src), l AS (SELECT id, max(k) AS level FROM d GROUP BY 1) SELECT id, (row_number() OVER (PARTITION BY level ORDER BY id) - 1 - (count(*) OVER (PARTITION BY level) - 1) / 2.0) * 40.0 AS x, level * 80.0 AS y FROM l")
def layout_ranked(spark, sf_dir):
    return layout.ranked(acyclic(spark, sf_dir))


@query()
def layout_scattered(spark, sf_dir):
    return layout.scattered(tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), 1000.0, 600.0)


@query("WITH e AS (SELECT o_orderkey AS edge_id, o_custkey % 50 AS src, o_custkey % 7 AS dst FROM orders) SELECT edge_id, row_number() OVER w - 1 AS slot, count(*) OVER (PARTITION BY least(src, dst), greatest(src, dst)) AS size FROM e WINDOW w AS (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY edge_id)")
def edge_bundles(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_orderkey").alias("edge_id"), (F.col("o_custkey") % 50).alias("src"), (F.col("o_custkey") % 7).alias("dst"))
    return layout.bundles(edges).select("edge_id", F.col("slot").cast("long").alias("slot"), "size")


@query(f"WITH {ALL_VECTORS} SELECT id FROM v WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN 0 AND 0.2")
def rectangle_query(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    return v.where(g.in_rectangle(g.point(F.col("x"), F.col("y")), -0.1, 0.0, 0.1, 0.2)).select("id")


@query(f"WITH {ALL_VECTORS}, q(qid, qx, qy) AS (VALUES (1, 0.0, 0.0), (2, 0.1, -0.1)), d AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)), id) AS place FROM v, q) SELECT qid AS query, id, place::INTEGER AS place FROM d WHERE place <= 5")
def nearest_points(spark, sf_dir):
    queries = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.1, -0.1)], "qid int, x double, y double")
    return spatial.nearest(tables.vectors(spark, sf_dir), queries, 5)


@query(f"WITH {ALL_VECTORS}, t AS (SELECT id, x, y, least(greatest((x * 0.3 + y * 0.4) / 0.25, 0), 1) AS t FROM v) SELECT id, round(sqrt((x - 0.3 * t) ** 2 + (y - 0.4 * t) ** 2), 6) AS dist FROM t")
def segment_distances(spark, sf_dir):
    at = lambda x, y: g.point(F.lit(x), F.lit(y))
    v = tables.vectors(spark, sf_dir)
    return rounded(v.select("id", g.distance_to_segment(g.point(F.col("x"), F.col("y")), at(0.0, 0.0), at(0.3, 0.4)).alias("dist")), "dist")


@query("SELECT p_partkey AS id, round(10 + least(greatest((p_size - 5) / 40.0, 0), 1) * 30, 6) AS width FROM part")
def style_linear(spark, sf_dir):
    parts = tables.table(spark, sf_dir, "part")
    return rounded(parts.select(F.col("p_partkey").alias("id"), style.linear(F.col("p_size").cast("double"), 5.0, 45.0, 10.0, 40.0).alias("width")), "width")


@query("SELECT p_partkey AS id, CASE WHEN p_retailprice > 1500 THEN 'gold' WHEN p_size > 40 THEN 'large' ELSE 'plain' END AS shape FROM part")
def style_rules(spark, sf_dir):
    parts = tables.table(spark, sf_dir, "part")
    rules = ((F.col("p_size") > 40, F.lit("large")), (F.col("p_retailprice") > 1500, F.lit("gold")))
    return parts.select(F.col("p_partkey").alias("id"), style.folded(F.lit("plain"), *rules).alias("shape"))


@query("SELECT p_partkey AS id, ((dense_rank() OVER (ORDER BY p_brand) - 1) % 8)::INTEGER AS slot FROM part")
def style_palette(spark, sf_dir):
    parts = tables.table(spark, sf_dir, "part")
    return style.palette_slot(parts, "p_brand", 8).select(F.col("p_partkey").alias("id"), "slot")


@query("SELECT user_id AS element_id, max(event_id) AS seq, arg_max(event_type, event_id) AS kind, count(*) AS n FROM events GROUP BY 1")
def change_stream(spark, sf_dir):
    return changes.applied(changes.event_changes(spark, sf_dir), changes.merge_last).select("element_id", "seq", "kind", "n")
