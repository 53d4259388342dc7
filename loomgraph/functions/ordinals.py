"""Dense ordinals over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize


def with_ordinal(df: DataFrame, *order, name: str = "ordinal") -> DataFrame:
    """Adds 0, 1, 2, ... in the given order: ranges are sorted and numbered on their own, and their sizes are added up (one row for each range)."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_k", F.monotonically_increasing_id())
    # The number of a row within its task lies in the lower 33 bits, that of the task above.
    local = materialize(placed.withColumn("_part", F.shiftright("_k", 33)).withColumn("_k", F.col("_k").bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + F.col("_k")).cast("long")).drop("_part", "_k", "_before")


def with_sum_before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "before") -> DataFrame:
    """Adds, within each key, the sum of a column over the rows that come earlier in the given order.

    Rows are dealt by ranges of key and order, so a key with any share of the rows is spread over ranges; the sums of
    whole ranges are broadcast for keys that lie in more than one, of which there are fewer than ranges.
    """
    parts = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    earlier = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = materialize(parts.withColumn("_own", F.coalesce(F.sum(value).over(earlier), F.lit(0))), "sums")
    totals = local.groupBy("_part", *keys).agg(F.sum(value).alias("_sum"))
    ranges = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_carried", F.sum("_sum").over(ranges)).where("_carried IS NOT NULL").drop("_sum")
    return local.join(F.broadcast(carried), ["_part", *keys], "left").withColumn(name, F.col("_own") + F.coalesce("_carried", F.lit(0))).drop("_part", "_own", "_carried")
