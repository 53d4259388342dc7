"""Queries of force-directed and hierarchical places and of groups moved apart; for the first two, what holds for every right answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import force, hierarchy, layout, separation
from loomgraph.plans import sql
from loomgraph.plans.graph_queries import acyclic, rounded, split
from loomgraph.plans.registry import query
from loomgraph.plans.view_queries import GEO, geo
from loomgraph.session import materialize


def _balance(positions, forces):
    """Pushes of exact pairs cancel in their sum over all nodes; those of means leave a little."""
    sums = force.repulsion(positions, forces).agg(F.hypot(F.sum("fx"), F.sum("fy")).alias("sum"), F.sum(F.hypot("fx", "fy")).alias("size"))
    return sums.select((F.col("sum") <= 0.02 * F.col("size")).alias("balanced"))


@query(f"WITH {sql.SPLIT} SELECT count(*) AS nodes, count(*) AS placed, true AS within_heat, true AS fewer_overlaps, true AS balanced FROM n")
def force_layout_users(spark, sf_dir):
    """Three rounds from a grid whose nodes overlap, with few springs: no node moves further than the heat allows, overlaps become fewer, and pushes balance."""
    graph = split(spark, sf_dir)
    forces = force.Forces(iterations=3, initial_temp=64.0)
    start = materialize(layout.grid(graph.nodes, cell=12.0), "force-start")
    end = force.force_layout(graph, start, None, forces)
    heat = sum(forces.initial_temp * forces.cooling**k for k in range(forces.iterations))
    moved = end.join(start.select("id", F.col("x").alias("x0"), F.col("y").alias("y0")), "id")
    each = moved.agg(F.count(F.lit(1)).alias("nodes"), F.count_if((~F.isnan("x")) & (~F.isnan("y"))).alias("placed"), (F.max(F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))) <= heat + 1e-6).alias("within_heat"))

    def crowded(places, name):
        # Nodes beyond one in each cell of a node's size, a measure of overlaps without pairs.
        cell = [F.floor(F.col(c) / forces.node_size).alias(c) for c in ("x", "y")]
        return places.select(*cell).groupBy("x", "y").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n").alias(name))

    fewer = crowded(end, "after").join(F.broadcast(crowded(start, "before"))).select((F.col("after") < F.col("before")).alias("fewer_overlaps"))
    return each.join(F.broadcast(fewer)).join(F.broadcast(_balance(end, forces)))


@query(f"""WITH RECURSIVE {sql.SPLIT}, r(src, dst) AS (SELECT id, id FROM n UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
c AS (SELECT a.src AS id, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
l AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM e JOIN c a ON a.id = e.src JOIN c b ON b.id = e.dst WHERE a.component <> b.component),
k(component, layer) AS (SELECT component, 0 FROM c UNION SELECT l.dst, layer + 1 FROM k JOIN l ON k.component = l.src)
SELECT c.id, max(k.layer) AS layer FROM c JOIN k USING (component) GROUP BY 1""")
def hierarchical_ranks(spark, sf_dir):
    """Layers of users by their heaviest links, which have circles."""
    return hierarchy.component_ranks(split(spark, sf_dir))


@query(f"""WITH RECURSIVE {sql.ACYCLIC}, k(id, layer) AS (SELECT id, 0 FROM n UNION SELECT e.dst, layer + 1 FROM k JOIN e ON k.id = e.src),
d AS (SELECT id, max(layer) AS layer FROM k GROUP BY 1),
s AS (SELECT a.layer AS layer, sum(b.layer - a.layer - 1) AS longer FROM e JOIN d a ON a.id = e.src JOIN d b ON b.id = e.dst GROUP BY 1)
SELECT (SELECT count(*) FROM d) AS nodes, (SELECT max(layer) + 1 FROM d) AS layers, (SELECT sum(longer) FROM s)::BIGINT AS bends, true AS fewer_crossings, true AS as_counted""")
def hierarchical_order(spark, sf_dir):
    """Orders in layers: all nodes and bends have places, no place is taken twice, and crossings become fewer."""
    graph = acyclic(spark, sf_dir)
    found = hierarchy.layered_order(graph, sweeps=2)
    both = found.places.select("layer", "place").union(found.bends.select("layer", "place"))
    taken = both.groupBy("layer").agg((F.count(F.lit(1)) == F.count_distinct("place")).alias("once"), (F.max("place") == F.count(F.lit(1)) - 1).alias("gapless")).agg(F.bool_and(F.col("once") & F.col("gapless")).alias("as_counted"))
    sizes = found.places.agg(F.count(F.lit(1)).alias("nodes"), (F.max("layer") + 1).alias("layers")).join(F.broadcast(found.bends.agg(F.count(F.lit(1)).alias("bends"))))
    return sizes.withColumn("fewer_crossings", F.lit(found.crossings_after < found.crossings_before)).join(F.broadcast(taken))


@query(f"""WITH {GEO}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM geo), p AS (SELECT id, (k % 40)::DOUBLE * 50 AS x, floor(k / 40)::DOUBLE * 50 AS y FROM o),
g AS (SELECT s.id, coalesce(arg_max(up.ancestor, up.depth), s.id) AS group_id FROM seen s LEFT JOIN up USING (id) WHERE s.visible GROUP BY s.id),
b AS (SELECT group_id, min(id) AS first, min(x) - 12 AS x0, max(x) - min(x) + 24 + 80 AS wide FROM g JOIN p USING (id) GROUP BY 1),
m AS (SELECT group_id, coalesce(sum(wide) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - x0 AS shift FROM b),
q AS (SELECT p.id, p.x + coalesce(shift, 0) AS x, p.y FROM p LEFT JOIN g USING (id) LEFT JOIN m USING (group_id)),
w AS (SELECT up.ancestor AS id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM up JOIN q ON q.id = up.id JOIN seen s ON s.id = up.id AND s.visible WHERE up.id NOT IN (SELECT parent FROM geo WHERE parent IS NOT NULL) GROUP BY 1)
SELECT q.id, round(CASE WHEN s.visible THEN coalesce(mx, q.x) ELSE q.x END, 6) AS x, round(CASE WHEN s.visible THEN coalesce(my, q.y) ELSE q.y END, 6) AS y FROM q JOIN seen s USING (id) LEFT JOIN w USING (id)""")
def separated_regions(spark, sf_dir):
    """Regions laid side by side, and nations and regions over what they hold."""
    nodes, _ = geo(spark, sf_dir)
    nodes = materialize(nodes, "geo")
    moved = materialize(separation.separated(nodes, layout.grid(nodes, columns=40)), "separated")
    return rounded(separation.over_contents(nodes, moved), "x", "y")
