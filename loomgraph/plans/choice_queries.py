"""Queries of matchings, colourings, bridges, dominators, paths and trails; where many answers are right, what must hold of one."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import blocks, choices
from loomgraph.plans import sql
from loomgraph.plans.graph_queries import acyclic, flag, sparse, split
from loomgraph.plans.registry import query


@query(f"WITH RECURSIVE {sql.SPLIT}, {sql.BOTH}, p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM e WHERE src <> dst GROUP BY 1, 2), r(a, b, id) AS (SELECT a, b, a FROM p UNION SELECT r.a, r.b, u.dst FROM r JOIN u ON r.id = u.src WHERE NOT (least(u.src, u.dst) = r.a AND greatest(u.src, u.dst) = r.b)) SELECT a AS src, b AS dst FROM p WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE r.a = p.a AND r.b = p.b AND r.id = p.b)")
def bridges(spark, sf_dir):
    return choices.bridges(split(spark, sf_dir))


@query("SELECT 0::BIGINT AS shared_ends, 0::BIGINT AS open_edges")
def maximal_matching_invariants(spark, sf_dir):
    graph = sparse(spark, sf_dir)
    m = choices.maximal_matching(graph)
    ends = m.select(F.col("src").alias("id")).union(m.select("dst"))
    shared = ends.groupBy("id").count().where("count > 1").agg(F.count(F.lit(1)).alias("shared_ends"))
    rest = graph.edges.where("src <> dst").join(ends.withColumnRenamed("id", "src"), "src", "left_anti").join(ends.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return shared.join(F.broadcast(rest.agg(F.count(F.lit(1)).alias("open_edges"))))


@query(f"WITH {sql.SPARSE} SELECT (SELECT count(*) FROM n) AS coloured, 0::BIGINT AS clashes")
def colouring_invariants(spark, sf_dir):
    graph = sparse(spark, sf_dir)
    c = choices.colouring(graph)
    a, b = c.select(F.col("id").alias("src"), F.col("colour").alias("a")), c.select(F.col("id").alias("dst"), F.col("colour").alias("b"))
    clashes = graph.edges.where("src <> dst").join(a, "src").join(b, "dst").where("a = b").agg(F.count(F.lit(1)).alias("clashes"))
    return c.where("colour IS NOT NULL").agg(F.count(F.lit(1)).alias("coloured")).join(F.broadcast(clashes))


@query(f"WITH RECURSIVE {sql.SPARSE}, r(gone, id) AS (SELECT a.id, 0::BIGINT FROM n a WHERE a.id <> 0 UNION SELECT r.gone, e.dst FROM r JOIN e ON r.id = e.src WHERE e.dst <> r.gone), h(id) AS (SELECT 0::BIGINT UNION SELECT dst FROM h JOIN e ON h.id = e.src) SELECT h.id, n.id AS dominator FROM h, n WHERE n.id = 0 OR n.id = h.id OR (n.id IN (SELECT id FROM h) AND NOT EXISTS (SELECT 1 FROM r WHERE r.gone = n.id AND r.id = h.id))")
def dominators(spark, sf_dir):
    return choices.dominators(sparse(spark, sf_dir), 0)


@query()
def immediate_dominators(spark, sf_dir):
    return choices.immediate_dominators(sparse(spark, sf_dir), 0)


@query(f"WITH RECURSIVE {sql.ACYCLIC}, p(id, route) AS (SELECT 0::BIGINT, [0::BIGINT] UNION ALL SELECT e.dst, list_append(route, e.dst) FROM p JOIN e ON p.id = e.src) SELECT array_to_string(route, '-') AS path FROM p WHERE id = 125 ORDER BY len(route), route LIMIT 10")
def simple_paths(spark, sf_dir):
    return choices.simple_paths(acyclic(spark, sf_dir), 0, 125, 10).select(F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


@query(f"WITH RECURSIVE {sql.SPARSE}, {sql.BOTH}, d AS (SELECT id, (SELECT count(*) FROM e WHERE src = id) - (SELECT count(*) FROM e WHERE dst = id) AS k FROM n), c(id, other) AS (SELECT src, src FROM u UNION SELECT c.id, u.dst FROM c JOIN u ON c.other = u.src) SELECT (SELECT count(DISTINCT m) = 1 FROM (SELECT min(other) AS m FROM c GROUP BY id)) AND bool_and(abs(k) <= 1) AND count(*) FILTER (WHERE k = 1) <= 1 AND count(*) FILTER (WHERE k = -1) <= 1 AS has_trail FROM d")
def euler_trail_exists(spark, sf_dir):
    return flag(spark, "has_trail", choices.euler_check(sparse(spark, sf_dir)))


@query(f"WITH RECURSIVE {sql.SPLIT}, {sql.BOTH}, r(gone, start, id) AS (SELECT g.id, a.id, a.id FROM n g, n a WHERE a.id <> g.id UNION SELECT r.gone, r.start, u.dst FROM r JOIN u ON r.id = u.src WHERE u.dst <> r.gone), c AS (SELECT gone, start, min(id) AS label FROM r GROUP BY 1, 2) SELECT DISTINCT x.src AS id FROM u x JOIN u y ON x.src = y.src JOIN c a ON a.gone = x.src AND a.start = x.dst JOIN c b ON b.gone = x.src AND b.start = y.dst WHERE a.label <> b.label")
def articulation_points(spark, sf_dir):
    return blocks.articulation_points(split(spark, sf_dir))


@query()
def biconnected_components(spark, sf_dir):
    return blocks.blocks(split(spark, sf_dir)).select("group_id", "block", "id")
