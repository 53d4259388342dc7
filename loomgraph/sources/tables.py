"""Graphs derived from the star-schema tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.ordinals import with_ordinal
from loomgraph.model import Graph
from loomgraph.session import dealt, materialize, tasks_for

SUPPLIER_OFFSET = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts and suppliers; an edge for each pair that a line item has, weighted by its quantity."""
    lines = table(spark, sf_dir, "lineitem")
    tasks = tasks_for(lines.count())
    pairs = lines.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIER_OFFSET).alias("dst"), "l_quantity")
    edges = dealt(pairs, tasks, "src", "dst").groupBy("src", "dst").agg(F.sum("l_quantity").alias("weight"))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).union(table(spark, sf_dir, "supplier").select(F.col("s_suppkey") + SUPPLIER_OFFSET))
    return replace(Graph.from_edges(edges, nodes), tasks=tasks)


def supply_apart(spark: SparkSession, sf_dir: str) -> Graph:
    """The supply graph with ids that no part shares with a supplier, however many there are: twice the usual id, and one more for suppliers."""
    graph = supply(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("id"))
    nodes = parts.union(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIER_OFFSET) * 2 + 1))
    return replace(Graph.from_edges(graph.edges.select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst"), "weight"), nodes), tasks=graph.tasks)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations; an edge from the customer's to the supplier's, weighted by line items."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = joined.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    return Graph.from_edges(edges, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")))


def user_steps(spark: SparkSession, sf_dir: str) -> Graph:
    """Users; an edge to the user of the next event, in one order over all events."""
    events = with_ordinal(table(spark, sf_dir, "events").select("ts", "event_id", "user_id"), "ts", "event_id").select("ordinal", "user_id")
    after = events.select((F.col("ordinal") - 1).alias("ordinal"), F.col("user_id").alias("dst"))
    edges = events.join(after, "ordinal").groupBy(F.col("user_id").alias("src"), "dst").agg(F.count(F.lit(1)).alias("weight"))
    return Graph.from_edges(edges)


def strongest(spark: SparkSession, sf_dir: str, k: int) -> Graph:
    """Each user's k heaviest links to other users who followed (of equal ones those of the smallest ids), written once."""
    graph = user_steps(spark, sf_dir)
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    ranked = graph.edges.where("src <> dst").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")
    return Graph(graph.nodes, materialize(ranked, "strongest-links"))


def oriented(graph: Graph) -> Graph:
    """The graph without directions, then directed from the smaller id to the larger one: it has no cycle. A pair keeps its largest weight."""
    pairs = graph.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))
    return Graph.from_edges(materialize(pairs, "oriented-links"), graph.nodes)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions (id, x, y) from the first two dimensions of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
