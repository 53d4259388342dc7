"""The hierarchy of containers: ancestors, visibility, and edges folded into collapsed containers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import materialize

MAX_DEPTH = 8


class CompoundError(ValueError):
    """A mount that would close a cycle or go too deep."""


def ancestors(nodes: DataFrame, levels: int = MAX_DEPTH) -> DataFrame:
    """(id, ancestor, depth): every container above a node, the nearest at depth 1; a join for each level there is, at most `levels`."""
    parents = materialize(nodes.where("parent IS NOT NULL").select("id", F.col("parent").alias("ancestor")), "parents")
    up = parents.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("above"))
    level = parents.withColumn("depth", F.lit(1))
    out = level
    for depth in range(2, levels + 1):
        level = materialize(level.join(up, "ancestor").select("id", F.col("above").alias("ancestor"), F.lit(depth).alias("depth")), "ancestors")
        if not level.limit(1).count():
            break
        out = out.union(level)
    return out


def descendants(nodes: DataFrame, container: int) -> DataFrame:
    """(id, depth): what a container holds, at any depth."""
    return ancestors(nodes).where(F.col("ancestor") == container).select("id", "depth")


def visibility(nodes: DataFrame) -> DataFrame:
    """(id, visible, proxy): a collapsed node is visible always, another if no container above it is collapsed.

    proxy is the nearest visible container of a hidden node, and a visible node itself.
    """
    chain = ancestors(nodes)
    flags = nodes.select(F.col("id").alias("ancestor"), "collapsed")
    up = chain.join(flags, "ancestor", "left").withColumn("closed", F.coalesce("collapsed", F.lit(True)))
    hidden = up.groupBy("id").agg(F.max("closed").alias("under"))
    seen = nodes.select("id", "collapsed").join(hidden, "id", "left").select("id", (F.col("collapsed") | ~F.coalesce("under", F.lit(False))).alias("visible"))
    seen = materialize(seen, "visible")
    open_ = seen.where("visible").select(F.col("id").alias("ancestor"))
    nearest = chain.join(open_, "ancestor", "left_semi").groupBy("id").agg(F.min_by("ancestor", "depth").alias("near"))
    return seen.join(nearest, "id", "left").select("id", "visible", F.when(F.col("visible"), F.col("id")).otherwise(F.col("near")).alias("proxy"))


def visible_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): each edge between the proxies of its ends; parallels stay, and an edge inside a folded container is a loop on it."""
    view = visibility(nodes).where("proxy IS NOT NULL").select("id", "proxy")
    a, b = view.select(F.col("id").alias("src"), F.col("proxy").alias("a")), view.select(F.col("id").alias("dst"), F.col("proxy").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def groups(nodes: DataFrame) -> DataFrame:
    """(group_id, id): visible nodes by their highest container."""
    top = ancestors(nodes).groupBy("id").agg(F.max_by("ancestor", "depth").alias("top"))
    return visibility(nodes).where("visible").join(top, "id", "left").select(F.coalesce("top", "id").alias("group_id"), "id")


def mount(nodes: DataFrame, child: int, parent: int | None) -> DataFrame:
    """The nodes with a child under another container, or under none; raises where that closes a cycle or is too deep."""
    if parent is not None:
        up = ancestors(nodes)
        if child == parent or up.where((F.col("id") == parent) & (F.col("ancestor") == child)).limit(1).count():
            raise CompoundError(f"node {child} would contain itself")
        above = up.where(F.col("id") == parent).count() + 1
        below = up.where(F.col("ancestor") == child).agg(F.max("depth")).first()[0] or 0
        if above + below > MAX_DEPTH:
            raise CompoundError(f"a hierarchy has at most {MAX_DEPTH} levels")
    return nodes.withColumn("parent", F.when(F.col("id") == child, F.lit(parent).cast("long")).otherwise(F.col("parent")))
