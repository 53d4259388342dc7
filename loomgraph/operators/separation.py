"""Containers after a layout: groups moved apart, containers put over what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ordinals import with_sum_before
from loomgraph.operators.compound import ancestors, groups, visibility

#: Room between two groups.
GAP = 80.0


def group_boxes(members: DataFrame, positions: DataFrame, half: float) -> DataFrame:
    """(group_id, x0, y0, x1, y1): the box of each group's (group_id, id) placed members, `half` wider on each side."""
    rows = members.join(positions.select("id", "x", "y"), "id").where("x IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy("group_id").agg((F.min("x") - half).alias("x0"), (F.min("y") - half).alias("y0"), (F.max("x") + half).alias("x1"), (F.max("y") + half).alias("y1"))


def separated(nodes: DataFrame, positions: DataFrame, half: float = 12.0) -> DataFrame:
    """(id, x, y): top-level groups side by side from x = 0 on, by their smallest member, GAP apart; each keeps its shape and height.

    Where a box starts is a running sum of widths over ranges of groups, so any number of groups is spread over tasks. A
    graph of one group, and nodes in no group (hidden ones), stay where they are. Nodes without a place have none after.
    """
    members = groups(nodes)
    first = members.groupBy("group_id").agg(F.min("id").alias("first"))
    boxes = group_boxes(members, positions, half).join(first, "group_id").select(F.lit(0).alias("all"), "group_id", "first", "x0", (F.col("x1") - F.col("x0") + GAP).alias("wide"))
    shifts = with_sum_before(boxes, ["all"], ["first"], "wide").select("group_id", (F.col("before") - F.col("x0")).alias("shift"))
    several = first.agg((F.count(F.lit(1)) > 1).alias("several"))
    rows = positions.select("id", "x", "y").join(members, "id", "left").join(shifts, "group_id", "left").join(F.broadcast(several))
    return rows.select("id", (F.col("x") + F.when(F.col("several"), F.coalesce("shift", F.lit(0.0))).otherwise(0.0)).alias("x"), "y")


def over_contents(nodes: DataFrame, positions: DataFrame) -> DataFrame:
    """(id, x, y): each visible container in the middle of the box of the visible nodes below it that hold nothing; others stay."""
    containers = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
    seen = visibility(nodes).where("visible").select("id")
    leaves = seen.join(containers, "id", "left_anti").join(positions.select("id", "x", "y"), "id").where("x IS NOT NULL AND y IS NOT NULL")
    middle = lambda c: ((F.min(c) + F.max(c)) / 2).alias(f"m{c}")
    inner = ancestors(nodes).join(leaves, "id").groupBy(F.col("ancestor").alias("id")).agg(middle("x"), middle("y")).join(seen, "id", "left_semi")
    rows = positions.select("id", "x", "y").join(inner, "id", "full")
    return rows.select("id", F.coalesce("mx", "x").alias("x"), F.coalesce("my", "y").alias("y"))
