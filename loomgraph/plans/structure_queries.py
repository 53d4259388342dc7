"""Queries of trails, depth-first orders, flows and matchings; where many answers are right, what proves that one of them is."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.ordinals import with_ordinal
from loomgraph.model import Graph
from loomgraph.operators import choices, flow, matching, sets, trails
from loomgraph.operators.order import component_ids, strong_components
from loomgraph.plans import sql
from loomgraph.plans.graph_queries import acyclic
from loomgraph.plans.registry import query
from loomgraph.plans.view_queries import GEO, geo
from loomgraph.sources import tables

SOURCE, GOAL = -1, -2

STEPS = "WITH steps AS (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, row_number() OVER (ORDER BY ts, event_id) AS k FROM events), w AS (SELECT * FROM steps WHERE dst IS NOT NULL)"
FIRST, LAST = "(SELECT arg_min(src, k) FROM w)", "(SELECT arg_max(dst, k) FROM w)"


def walked(spark, sf_dir) -> Graph:
    """Users, and an edge of its own for every event to the user of the next one."""
    events = with_ordinal(tables.table(spark, sf_dir, "events").select("ts", "event_id", "user_id"), "ts", "event_id").select("ordinal", "user_id")
    after = events.select((F.col("ordinal") - 1).alias("ordinal"), F.col("user_id").alias("dst"))
    return Graph.from_edges(events.join(after, "ordinal").select(F.col("user_id").alias("src"), "dst", F.lit(1.0).alias("weight")))


def _walk_summary(trail, graph):
    """Steps, edges used, steps that do not start where the one before ended, and both ends."""
    before = trail.select((F.col("step") + 1).alias("step"), F.col("dst").alias("from"))
    breaks = trail.join(before, "step").where("src <> from").agg(F.count(F.lit(1)).alias("breaks"))
    used = trail.join(graph.edges.select("edge_id"), "edge_id").agg(F.count_distinct("edge_id").alias("edges_used"))
    ends = trail.agg(F.count(F.lit(1)).alias("steps"), F.min_by("src", "step").alias("first"), F.max_by("dst", "step").alias("last"))
    return ends.join(F.broadcast(breaks)).join(F.broadcast(used))


@query(f"{STEPS} SELECT count(*) AS steps, count(*) AS edges_used, 0::BIGINT AS breaks, CASE WHEN {FIRST} = {LAST} THEN min(src) ELSE {FIRST} END AS first, CASE WHEN {FIRST} = {LAST} THEN min(src) ELSE {LAST} END AS last FROM w")
def euler_trail(spark, sf_dir):
    """The users' events are one walk over an edge for each event, so a trail over all edges exists; its ends are known."""
    graph = walked(spark, sf_dir)
    return _walk_summary(trails.euler_trail(graph), graph)


@query(f"{STEPS} SELECT count(*) AS steps, count(*) AS edges_used, 0::BIGINT AS breaks, CASE WHEN {FIRST} = {LAST} THEN min(least(src, dst)) ELSE least({FIRST}, {LAST}) END AS low_end, CASE WHEN {FIRST} = {LAST} THEN min(least(src, dst)) ELSE greatest({FIRST}, {LAST}) END AS high_end FROM w")
def euler_trail_undirected(spark, sf_dir):
    """The same edges with every second one turned round, read without directions."""
    graph = walked(spark, sf_dir)
    turned = F.col("edge_id") % 2 == 0
    mixed = Graph(graph.nodes, graph.edges.select("edge_id", F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"), "weight"))
    rows = _walk_summary(trails.euler_trail_undirected(mixed), mixed)
    return rows.select("steps", "edges_used", "breaks", F.least("first", "last").alias("low_end"), F.greatest("first", "last").alias("high_end"))


@query(f"""WITH RECURSIVE {GEO}, r(id, root, route) AS (
  SELECT id, id, [id] FROM geo WHERE parent IS NULL UNION ALL SELECT geo.id, r.root, list_append(r.route, geo.id) FROM r JOIN geo ON geo.parent = r.id
) SELECT id, root, row_number() OVER (ORDER BY route) - 1 AS pre, row_number() OVER (ORDER BY list_append(route, 9000000000)) - 1 AS post FROM r""")
def depth_first_order(spark, sf_dir):
    """Regions, nations, customers and suppliers, from container to content."""
    nodes, _ = geo(spark, sf_dir)
    links = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    return trails.depth_first(Graph.from_edges(links, nodes.select("id")))


def delivery(spark, sf_dir) -> Graph:
    """The supply graph with a source that feeds each part by its size and a goal that takes a quarter of what a supplier delivers."""
    graph = tables.supply(spark, sf_dir)
    parts = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 4.0).alias("amount"))
    wanted = graph.edges.groupBy(F.col("dst").alias("id")).agg((F.sum("weight") * 0.25).alias("amount"))
    return flow.with_terminals(graph, parts, wanted, SOURCE, GOAL)


@query("SELECT true AS positive, true AS value_is_cut, 0::BIGINT AS unbalanced, 0::BIGINT AS overfull")
def maximum_flow(spark, sf_dir):
    """A flow that keeps capacities and balances, with the value of a cut, is the largest one."""
    found = flow.maximum_flow(delivery(spark, sf_dir), SOURCE, GOAL)
    net = found.edges.select(F.col("src").alias("id"), F.col("flow").alias("f")).union(found.edges.select("dst", -F.col("flow"))).groupBy("id").agg(F.sum("f").alias("f"))
    want = F.when(F.col("id") == SOURCE, F.lit(found.value)).when(F.col("id") == GOAL, F.lit(-found.value)).otherwise(F.lit(0.0))
    unbalanced = net.where(F.abs(F.col("f") - want) > 1e-6).agg(F.count(F.lit(1)).alias("unbalanced"))
    overfull = found.edges.where("flow < 0 OR flow > capacity").agg(F.count(F.lit(1)).alias("overfull"))
    cut = flow.cut_edges(found).agg((F.abs(F.sum("capacity") - F.lit(found.value)) <= 1e-6).alias("value_is_cut"), F.lit(found.value > 0).alias("positive"))
    return cut.join(F.broadcast(unbalanced)).join(F.broadcast(overfull))


def _matching_proof(graph: Graph, found: matching.Matching):
    """Ends shared, pairs that are no links, and by how much the free nodes exceed what the barrier proves to be unavoidable."""
    ends = found.pairs.select(F.col("src").alias("id")).union(found.pairs.select("dst"))
    shared = ends.groupBy("id").count().where("count > 1").agg(F.count(F.lit(1)).alias("shared_ends"))
    strange = found.pairs.join(graph.undirected(), ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("no_links"))
    rest = Graph(graph.nodes.select("id").distinct().join(found.barrier, "id", "left_anti"), graph.edges.join(found.barrier.withColumnRenamed("id", "src"), "src", "left_anti").join(found.barrier.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    odd = component_ids(rest).groupBy("component").agg((F.count(F.lit(1)) % 2).alias("odd")).agg(F.coalesce(F.sum("odd"), F.lit(0)).alias("odd"))
    free = graph.nodes.select("id").distinct().join(ends, "id", "left_anti").agg(F.count(F.lit(1)).alias("free"))
    size = found.barrier.agg(F.count(F.lit(1)).alias("barrier"))
    proof = odd.join(F.broadcast(free)).join(F.broadcast(size)).select((F.col("free") - (F.col("odd") - F.col("barrier"))).alias("gap"))
    return shared.join(F.broadcast(strange)).join(F.broadcast(proof))


@query("SELECT 0::BIGINT AS shared_ends, 0::BIGINT AS no_links, 0::BIGINT AS gap")
def maximum_matching_supply(spark, sf_dir):
    graph = tables.supply(spark, sf_dir)
    return _matching_proof(graph, matching.maximum_matching(graph))


@query("SELECT 0::BIGINT AS shared_ends, 0::BIGINT AS no_links, 0::BIGINT AS gap")
def maximum_matching_users(spark, sf_dir):
    """Each user's heaviest link: components with one circle each, of odd length too."""
    graph = tables.strongest(spark, sf_dir, 1)
    return _matching_proof(graph, matching.maximum_matching(graph))


@query(f"WITH {sql.USERS} SELECT count(*) // 2 AS pairs FROM (SELECT src FROM e WHERE src <> dst UNION SELECT dst FROM e WHERE src <> dst)")
def maximum_matching_steps(spark, sf_dir):
    """All links between users: so dense that one user at most stays alone."""
    return matching.maximum_matching(tables.user_steps(spark, sf_dir)).pairs.agg(F.count(F.lit(1)).alias("pairs"))


@query(f"WITH RECURSIVE {sql.USERS}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r(src, dst) AS (SELECT id, id FROM n UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT a.src AS id, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1")
def strong_components_steps(spark, sf_dir):
    """All links between users."""
    return strong_components(tables.user_steps(spark, sf_dir))


@query("WITH p AS (SELECT p_partkey AS id FROM part UNION ALL SELECT s_suppkey + 1000000 FROM supplier) SELECT id, id AS component FROM p")
def strong_components_supply(spark, sf_dir):
    """Every link leads from a part to a supplier: nothing lies on a circle. From the millionth part on, parts have the usual ids of suppliers too, so ids are kept apart until the result."""
    found = strong_components(tables.supply_apart(spark, sf_dir))
    return found.select(F.floor(F.col("id") / 2).alias("id"), F.floor(F.col("component") / 2).alias("component"))


@query(f"WITH RECURSIVE {sql.ACYCLIC}, top AS (SELECT max(dst) AS goal FROM e WHERE src = 0), p(id, route) AS (SELECT 0::BIGINT, [0::BIGINT] UNION ALL SELECT e.dst, list_append(route, e.dst) FROM p JOIN e ON p.id = e.src) SELECT array_to_string(route, '-') AS path FROM p, top WHERE id = goal ORDER BY len(route), route LIMIT 10")
def simple_paths_to_farthest(spark, sf_dir):
    """From user 0 to the one of the largest id that it is linked with, so there is a path at every size."""
    graph = acyclic(spark, sf_dir)
    goal = graph.edges.where("src = 0").agg(F.max("dst")).first()[0]
    paths = choices.simple_paths(graph, 0, goal if goal is not None else 0, 10)
    return paths.select(F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


@query(f"WITH {sql.SPLIT} SELECT id FROM n EXCEPT SELECT dst FROM e")
def set_complement_followed(spark, sf_dir):
    """Users that nobody's heaviest link leads to."""
    graph = tables.strongest(spark, sf_dir, 1)
    return sets.complement(graph.edges.select(F.col("dst").alias("id")).distinct(), graph.nodes)
