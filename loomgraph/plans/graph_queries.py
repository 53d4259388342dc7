"""Queries of the graph operators over the table graphs, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import centrality, order, reach
from loomgraph.operators.components import component_labels
from loomgraph.plans import sql
from loomgraph.plans.registry import query
from loomgraph.sources import tables


def sparse(spark: SparkSession, sf_dir: str):
    return tables.strongest(spark, sf_dir, 3)


def split(spark: SparkSession, sf_dir: str):
    return tables.strongest(spark, sf_dir, 1)


def acyclic(spark: SparkSession, sf_dir: str):
    return tables.oriented(tables.strongest(spark, sf_dir, 2))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def flag(spark: SparkSession, name: str, value: bool) -> DataFrame:
    return spark.createDataFrame([(bool(value),)], f"{name} boolean")


@query(f"WITH {sql.SUPPLY}, {sql.BOTH}, d AS (SELECT src AS id, count(*) AS d FROM u GROUP BY 1) SELECT n.id, round(coalesce(d, 0) / ((SELECT count(*) FROM n) - 1)::DOUBLE, 6) AS score FROM n LEFT JOIN d USING (id)")
def degree_centrality(spark, sf_dir):
    return rounded(centrality.degree_centrality(tables.supply(spark, sf_dir)), "score")


@query(f"WITH {sql.SUPPLY}, s AS (SELECT src AS id, count(*) AS d, sum(greatest(weight, 0)) AS s FROM e WHERE src <> dst GROUP BY 1), r AS (SELECT n.id, CASE WHEN d > 0 THEN sqrt(d::DOUBLE) * sqrt(s) ELSE 0 END AS raw FROM n LEFT JOIN s USING (id)) SELECT id, round(raw / (SELECT max(raw) FROM r), 6) AS score FROM r")
def weighted_degree_directed(spark, sf_dir):
    return rounded(centrality.weighted_degree(tables.supply(spark, sf_dir), 0.5, True), "score")


@query(f"WITH {sql.SUPPLY}, f AS (SELECT src, dst, weight AS w FROM e UNION ALL SELECT dst, src, weight FROM e), s AS (SELECT src AS id, count(DISTINCT dst) AS d, sum(w) AS s FROM f WHERE src <> dst GROUP BY 1), r AS (SELECT n.id, CASE WHEN d > 0 THEN sqrt(d::DOUBLE) * sqrt(s) ELSE 0 END AS raw FROM n LEFT JOIN s USING (id)) SELECT id, round(raw / (SELECT max(raw) FROM r), 6) AS score FROM r")
def weighted_degree_undirected(spark, sf_dir):
    return rounded(centrality.weighted_degree(tables.supply(spark, sf_dir), 0.5, False), "score")


@query(f"WITH RECURSIVE {sql.SPARSE}, {sql.BOTH}, h(source, id, level) AS (SELECT id, id, 0 FROM n UNION SELECT source, dst, level + 1 FROM h JOIN u ON h.id = u.src WHERE level < 60), b AS (SELECT source, id, min(level) AS level FROM h GROUP BY 1, 2), c AS (SELECT source, count(*) AS r, sum(level) AS s FROM b WHERE level > 0 GROUP BY 1) SELECT n.id, round(coalesce(r / ((SELECT count(*) FROM n) - 1)::DOUBLE * r / s, 0), 6) AS score FROM n LEFT JOIN c ON c.source = n.id")
def closeness_centrality(spark, sf_dir):
    return rounded(centrality.closeness(sparse(spark, sf_dir)), "score")


@query(f"""WITH RECURSIVE {sql.SPARSE}, {sql.BOTH}, h(source, id, level) AS (SELECT id, id, 0 FROM n UNION SELECT source, dst, level + 1 FROM h JOIN u ON h.id = u.src WHERE level < 60),
b AS (SELECT source, id, min(level) AS level FROM h GROUP BY 1, 2),
p(source, id, level, route) AS (SELECT id, id, 0, [id] FROM n UNION ALL SELECT p.source, u.dst, p.level + 1, list_append(route, u.dst) FROM p JOIN u ON p.id = u.src JOIN b ON b.source = p.source AND b.id = u.dst AND b.level = p.level + 1),
c AS (SELECT source, id, count(*) AS k FROM p GROUP BY 1, 2),
m AS (SELECT p.source, p.id AS goal, unnest(route[2:-2]) AS mid FROM p WHERE level > 1),
d AS (SELECT mid AS id, sum(1.0::DOUBLE / k) AS d FROM m JOIN c ON c.source = m.source AND c.id = m.goal GROUP BY 1)
SELECT n.id, round(coalesce(d, 0) / (((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM n) - 2))::DOUBLE, 6) AS score FROM n LEFT JOIN d USING (id)""")
def betweenness_centrality(spark, sf_dir):
    return rounded(centrality.betweenness(sparse(spark, sf_dir)), "score")


def _rank_sql(rounds: int) -> str:
    """The rounds unrolled, one block for each."""
    out = [f"WITH {sql.SPARSE}, o AS (SELECT n.id, count(e.src) AS out FROM n LEFT JOIN e ON e.src = n.id GROUP BY 1), l AS (SELECT DISTINCT src, dst FROM e), r0 AS (SELECT id, out, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r FROM o)"]
    for k in range(rounds):
        out.append(
            f"c{k} AS (SELECT dst AS id, sum(r / out) AS flow, sum(r) AS near FROM r{k} JOIN l ON l.src = r{k}.id WHERE out > 0 GROUP BY 1), "
            f"w{k} AS (SELECT r{k}.id, out, 0.85 * coalesce(flow, 0) + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{k} WHERE out = 0) / (SELECT count(*) FROM n) + 0.15 / (SELECT count(*) FROM n) * ((SELECT coalesce(sum(r), 0) FROM r{k} WHERE out > 0) - coalesce(near, 0)) AS r FROM r{k} LEFT JOIN c{k} USING (id)), "
            f"r{k + 1} AS (SELECT id, out, r / (SELECT sum(r) FROM w{k}) AS r FROM w{k})"
        )
    return ", ".join(out) + f" SELECT id, round(r, 6) AS score FROM r{rounds}"


@query(_rank_sql(5))
def pagerank_5(spark, sf_dir):
    return rounded(centrality.pagerank(sparse(spark, sf_dir), iterations=5), "score")


@query()
def pagerank_textbook_20(spark, sf_dir):
    return rounded(centrality.pagerank(sparse(spark, sf_dir), teleport="textbook"), "score")


@query(f"WITH RECURSIVE {sql.SPARSE}, h(id, level) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, level + 1 FROM h JOIN e ON h.id = e.src WHERE level < 60) SELECT id, min(level)::INTEGER AS level FROM h GROUP BY 1")
def breadth_first_levels(spark, sf_dir):
    graph = sparse(spark, sf_dir)
    return reach.hop_levels(graph.edges, graph.nodes.where("id = 0")).select("id", "level")


CLOSURE = "r(id) AS (SELECT dst FROM e WHERE src IN (1, 4) UNION SELECT dst FROM r JOIN e ON r.id = e.src)"


@query(f"WITH RECURSIVE {sql.SPLIT}, {CLOSURE} SELECT id FROM r")
def successors_closure(spark, sf_dir):
    graph = split(spark, sf_dir)
    return reach.successors_closure(graph.edges, graph.nodes.where("id IN (1, 4)"))


@query(f"WITH RECURSIVE {sql.SPLIT}, r(id) AS (SELECT src FROM e WHERE dst IN (1, 4) UNION SELECT src FROM r JOIN e ON r.id = e.dst) SELECT id FROM r")
def predecessors_closure(spark, sf_dir):
    graph = split(spark, sf_dir)
    return reach.predecessors_closure(graph.edges, graph.nodes.where("id IN (1, 4)"))


@query(f"WITH RECURSIVE {sql.SPLIT}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def reachability_pairs(spark, sf_dir):
    return reach.reach_pairs(split(spark, sf_dir).edges)


@query(f"WITH RECURSIVE {sql.SPARSE}, r(id) AS (SELECT 3::BIGINT UNION SELECT dst FROM r JOIN e ON r.id = e.src) SELECT count(*) > 0 AS has_path FROM r WHERE id = 17")
def has_directed_path(spark, sf_dir):
    graph = sparse(spark, sf_dir)
    return flag(spark, "has_path", reach.hop_levels(graph.edges, graph.nodes.where("id = 3")).where("id = 17").limit(1).count())


DISTANCES = "d(source, id, dist, hops) AS (SELECT id, id, 0.0::DOUBLE, 0 FROM n WHERE {0} UNION SELECT source, dst, dist + weight, hops + 1 FROM d JOIN e ON d.id = e.src WHERE hops < {1})"


@query(f"WITH RECURSIVE {sql.ACYCLIC}, {DISTANCES.format('id = 0', 25)} SELECT id, min(dist) AS dist FROM d GROUP BY 1")
def shortest_paths(spark, sf_dir):
    graph = acyclic(spark, sf_dir)
    return reach.distances(graph.edges, graph.nodes.where("id = 0"), graph.nodes).select("id", "dist")


@query(f"WITH RECURSIVE {sql.ACYCLIC.replace('max(weight) AS weight', 'max(weight) - 3 AS weight')}, {DISTANCES.format('id = 0', 25)} SELECT id, min(dist) AS dist FROM d GROUP BY 1")
def negative_weight_paths(spark, sf_dir):
    graph = acyclic(spark, sf_dir)
    shifted = graph.edges.withColumn("weight", F.col("weight") - 3)
    return reach.distances(shifted, graph.nodes.where("id = 0"), graph.nodes).select("id", "dist")


@query(f"WITH RECURSIVE {sql.ACYCLIC}, {DISTANCES.format('true', 25)} SELECT source, id, min(dist) AS dist FROM d GROUP BY 1, 2")
def all_pairs_shortest_paths(spark, sf_dir):
    graph = acyclic(spark, sf_dir)
    return reach.distances(graph.edges, graph.nodes, graph.nodes)


@query(f"WITH RECURSIVE {sql.ACYCLIC}, w(id, dist) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION ALL SELECT dst, dist + weight FROM w JOIN e ON w.id = e.src), k AS (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist) AS place FROM w) SELECT id, dist FROM k WHERE place = 2")
def second_shortest_walks(spark, sf_dir):
    graph = acyclic(spark, sf_dir)
    return reach.kth_walk_costs(graph.edges, 0, 2, graph.nodes)


COMPONENTS = "c(id, other) AS (SELECT id, id FROM n UNION SELECT c.id, u.dst FROM c JOIN u ON c.other = u.src)"


@query(f"WITH RECURSIVE {sql.SPLIT}, {sql.BOTH}, {COMPONENTS} SELECT id, min(other) AS component FROM c GROUP BY 1")
def components_undirected(spark, sf_dir):
    return order.component_ids(split(spark, sf_dir))


@query(f"WITH RECURSIVE {sql.SPLIT}, r(src, dst) AS (SELECT id, id FROM n UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT a.src AS id, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1")
def strongly_connected_components(spark, sf_dir):
    return order.strong_components(split(spark, sf_dir))


@query(f"WITH RECURSIVE {sql.SPLIT}, r(src, dst) AS (SELECT id, id FROM n UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src), c AS (SELECT a.src AS id, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) SELECT DISTINCT x.component AS src, y.component AS dst FROM e JOIN c x ON x.id = e.src JOIN c y ON y.id = e.dst WHERE x.component <> y.component")
def condensation_links(spark, sf_dir):
    return order.condensation(split(spark, sf_dir))


@query(f"WITH RECURSIVE {sql.ACYCLIC}, d(id, k) AS (SELECT id, 0 FROM n UNION SELECT dst, k + 1 FROM d JOIN e ON d.id = e.src) SELECT id, max(k)::INTEGER AS round FROM d GROUP BY 1")
def topological_rounds(spark, sf_dir):
    return order.topological_rounds(acyclic(spark, sf_dir))


@query(f"WITH RECURSIVE {sql.SPLIT}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT count(*) > 0 AS cyclic FROM r WHERE src = dst")
def is_cyclic_directed(spark, sf_dir):
    return flag(spark, "cyclic", order.is_cyclic_directed(split(spark, sf_dir)))


@query(f"WITH RECURSIVE {sql.SPLIT}, {sql.BOTH}, {COMPONENTS}, l AS (SELECT id, min(other) AS c FROM c GROUP BY 1) SELECT (SELECT count(*) FROM e) > (SELECT count(*) FROM l) - (SELECT count(DISTINCT c) FROM l) AS cyclic")
def is_cyclic_undirected(spark, sf_dir):
    return flag(spark, "cyclic", order.is_cyclic_undirected(split(spark, sf_dir)))


@query(f"WITH RECURSIVE {sql.SPARSE}, {sql.BOTH}, w(source, id, odd) AS (SELECT id, id, 0 FROM n UNION SELECT source, dst, 1 - odd FROM w JOIN u ON w.id = u.src) SELECT count(*) = 0 AS bipartite FROM w WHERE source = id AND odd = 1")
def is_bipartite(spark, sf_dir):
    return flag(spark, "bipartite", order.is_bipartite(sparse(spark, sf_dir)))


@query(f"WITH {sql.SUPPLY} SELECT count(*) FILTER (WHERE (src < 1000000) = (dst < 1000000)) = 0 AS bipartite FROM e")
def is_bipartite_supply(spark, sf_dir):
    return flag(spark, "bipartite", order.is_bipartite(tables.supply(spark, sf_dir)))


@query(f"WITH RECURSIVE {sql.ACYCLIC}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e f JOIN r ON f.dst = r.src WHERE f.src = e.src AND r.dst = e.dst)")
def transitive_reduction(spark, sf_dir):
    return order.transitive_reduction(acyclic(spark, sf_dir))


@query(f"WITH RECURSIVE {sql.SPARSE}, {sql.BOTH}, {COMPONENTS}, l AS (SELECT id, min(other) AS c FROM c GROUP BY 1) SELECT (SELECT count(*) FROM l) - (SELECT count(DISTINCT c) FROM l) AS n_edges")
def spanning_forest_size(spark, sf_dir):
    return order.spanning_forest(sparse(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_edges"))


@query()
def minimum_spanning_forest(spark, sf_dir):
    return order.spanning_forest(sparse(spark, sf_dir)).select("src", "dst", "weight")


@query(f"WITH {sql.USERS} SELECT src, dst, weight FROM e")
def user_transitions(spark, sf_dir):
    return tables.user_steps(spark, sf_dir).edges.select("src", "dst", "weight")


def _labels_sql(rounds: int) -> str:
    """The smallest label among neighbours, round by round; the last block is there only where nothing changes any more."""
    out = [f"WITH RECURSIVE {sql.SUPPLY}, {sql.BOTH}, c0 AS (SELECT DISTINCT src AS id, src AS label FROM u)"]
    for k in range(rounds):
        out.append(f"c{k + 1} AS (SELECT a.id, least(a.label, min(b.label)) AS label FROM c{k} a JOIN u ON u.src = a.id JOIN c{k} b ON b.id = u.dst GROUP BY a.id, a.label)")
    return ", ".join(out) + f" SELECT id, label AS component FROM c{rounds} WHERE (SELECT count(*) FROM c{rounds} x JOIN c{rounds - 1} y USING (id) WHERE x.label <> y.label) = 0"


@query(_labels_sql(8))
def supply_components(spark, sf_dir):
    graph = tables.supply(spark, sf_dir)
    return component_labels(graph.edges, tasks=graph.tasks)
