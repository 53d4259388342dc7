"""Positions of nodes and drawing order of edges as relations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.ordinals import with_ordinal
from loomgraph.model import Graph
from loomgraph.operators.order import topological_rounds
from loomgraph.operators.reach import hop_levels


def circle(nodes: DataFrame, spacing: float = 40.0, least: float = 100.0) -> DataFrame:
    """(id, x, y): nodes by id on a circle whose neighbours are at least `spacing` apart along the chord."""
    n = nodes.count()
    radius = max(least, spacing / (2 * math.sin(math.pi / n))) if n > 1 else 0.0
    angle = F.col("ordinal") * F.lit(2 * math.pi / max(n, 1))
    return with_ordinal(nodes.select("id"), "id").select("id", (F.cos(angle) * radius).alias("x"), (F.sin(angle) * radius).alias("y"))


def grid(nodes: DataFrame, cell: float = 50.0, columns: int | None = None) -> DataFrame:
    """(id, x, y): nodes by id in rows of about the square root of their number."""
    n = nodes.count()
    columns = columns or max(1, math.ceil(math.sqrt(n)))
    return with_ordinal(nodes.select("id"), "id").select("id", (F.pmod(F.col("ordinal"), F.lit(columns)) * cell).alias("x"), (F.floor(F.col("ordinal") / columns) * cell).cast("double").alias("y"))


def scattered(nodes: DataFrame, width: float, height: float, seed: int = 0) -> DataFrame:
    """(id, x, y): a place for each id from a hash, the same in every run."""
    unit = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    return nodes.select("id", (unit(0) * width).alias("x"), (unit(1) * height).alias("y"))


def preset(nodes: DataFrame, positions: DataFrame) -> DataFrame:
    """(id, x, y): given positions, and the origin for nodes without one."""
    return nodes.select("id").join(positions.select("id", "x", "y"), "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def layered(graph: Graph, roots: DataFrame, gap: float = 80.0, step: float = 40.0) -> DataFrame:
    """(id, x, y): levels of hops from the roots, one below another; what they do not reach is the leading level."""
    levels = hop_levels(graph.edges, roots).groupBy("id").agg(F.min("level").alias("level"))
    rows = graph.nodes.select("id").join(levels, "id", "left").withColumn("level", F.coalesce("level", F.lit(-1)))
    return _in_rows(rows, gap, step)


def ranked(graph: Graph, gap: float = 80.0, step: float = 40.0) -> DataFrame:
    """(id, x, y): ranks by the longest way from a source; nodes on or behind cycles are the leading level."""
    rows = graph.nodes.select("id").join(topological_rounds(graph).withColumnRenamed("round", "level"), "id", "left").withColumn("level", F.coalesce("level", F.lit(-1)))
    return _in_rows(rows, gap, step)


def _in_rows(rows: DataFrame, gap: float, step: float) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("level").orderBy("id")) - 1
    wide = F.count(F.lit(1)).over(Window.partitionBy("level"))
    return rows.select("id", ((place - (wide - 1) / 2) * step).alias("x"), (F.col("level") * gap).cast("double").alias("y"))


def bundles(edges: DataFrame) -> DataFrame:
    """(edge_id, src, dst, slot, size, offset): parallel edges of an unordered pair, numbered by id and spread evenly."""
    pair = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst"))
    slot = F.row_number().over(pair.orderBy("edge_id")) - 1
    rows = edges.select("edge_id", "src", "dst", slot.alias("slot"), F.count(F.lit(1)).over(pair).alias("size"))
    return rows.withColumn("offset", F.col("slot") - (F.col("size") - 1) / 2)


def bounds(nodes: DataFrame, positions: DataFrame) -> DataFrame:
    """(parent, x0, y0, x1, y1): the box of each container's direct members."""
    rows = nodes.where("parent IS NOT NULL").select("id", "parent").join(positions, "id")
    return rows.groupBy("parent").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def rings(scores: DataFrame, width: float | None = None) -> DataFrame:
    """(id, ring): nodes (id, score) from the largest score outwards; a ring holds scores less than `width` below its first.

    width: a quarter of the largest score by default. Only distinct scores are laid out one after another.
    """
    top = scores.agg(F.max("score")).first()[0] or 0.0
    step = width if width is not None else max(top / 4, 1e-9)
    distinct = [r[0] for r in scores.select("score").distinct().orderBy(F.desc("score")).toLocalIterator()]
    first, bounds = None, []
    for v in distinct:
        if first is None or first - v >= step:
            bounds.append(v)
            first = v
    ring = F.size(F.filter(F.array(*(F.lit(float(b)) for b in bounds)).cast("array<double>"), lambda b: b >= F.col("score"))) - 1
    return scores.select("id", ring.alias("ring"))


def concentric(scores: DataFrame, width: float | None = None, spacing: float = 10.0, size: float = 24.0) -> DataFrame:
    """(id, x, y): each ring of rings() on a circle, evenly by id; radii grow so that nodes of a ring and rings keep apart."""
    placed = rings(scores, width)
    sizes = {r.ring: r.n for r in placed.groupBy("ring").agg(F.count(F.lit(1)).alias("n")).collect()}
    apart, radius, radii = spacing + size, 0.0, []
    for k in range(len(sizes)):
        n = sizes[k]
        least = 0.0 if k == 0 and n == 1 else max(apart, apart / (2 * math.sin(math.pi / n)) if n > 1 else apart)
        radius = least if not radii else max(radii[-1] + apart, least)
        radii.append(radius)
    ordinal = with_ordinal(placed, "ring", "id")
    firsts = ordinal.groupBy("ring").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n"))
    rows = ordinal.join(F.broadcast(firsts), "ring")
    angle = (F.col("ordinal") - F.col("first")) * (2 * math.pi) / F.col("n")
    r = F.element_at(F.array(*map(F.lit, radii or [0.0])), F.col("ring") + 1)
    return rows.select("id", (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))


def spiral(nodes: DataFrame, spacing: float = 20.0, radius: float | None = None) -> DataFrame:
    """(id, x, y): nodes by id on a sunflower spiral, at even density from the middle; with a radius, all within it."""
    golden = math.pi * (3 - math.sqrt(5))
    if radius is not None:
        spacing = radius / math.sqrt(max(nodes.count(), 1))
    k = F.col("ordinal")
    return with_ordinal(nodes.select("id"), "id").select("id", (F.sqrt(k) * spacing * F.cos(k * golden)).alias("x"), (F.sqrt(k) * spacing * F.sin(k * golden)).alias("y"))
