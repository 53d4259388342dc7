"""Linked lists as tables: labels of cycles and ranks.

Elements are taken out, a third of those left in each round, until few are left; these double their pointers, and what
was taken out is put back, the last first. So rows moved grow with the elements, not with their logarithm besides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import Rounds, materialize, remove, written

#: Elements from which on doubling is cheaper than further rounds of taking out and putting back.
DIRECT = 1 << 18

LINKED = "at IS NOT NULL AND at <> e"


def _shorter(state: DataFrame, values: list[str], merge: Callable[[Column, Column], Column], seed: int) -> DataFrame:
    """(e, at, values, gone, gone_values): elements of smaller hashes than both neighbours are merged into the one before.

    An element asks to merge the next one if that has the smaller hash, otherwise it may be merged itself. So each goes
    into the join once, and one joined row says what is left and what went.
    """
    order = lambda c: F.xxhash64(F.col(c), F.lit(seed))
    asks = F.col("at").isNotNull() & (order("e") > order("at"))
    a = state.where(F.coalesce(asks, F.lit(False)))
    b = state.where(~F.coalesce(asks, F.lit(False))).select(F.col("e").alias("f"), F.col("at").alias("beyond"), *(F.col(v).alias(f"f_{v}") for v in values))
    both = F.col("e").isNotNull() & F.col("f").isNotNull()
    kept = [F.when(both, merge(F.col(v), F.col(f"f_{v}"))).otherwise(F.coalesce(v, f"f_{v}")).alias(v) for v in values]
    gone = [F.when(both, F.col(f"f_{v}")).alias(f"gone_{v}") for v in values]
    return a.join(b, F.col("at") == F.col("f"), "full_outer").select(F.coalesce("e", "f").alias("e"), F.when(F.col("f").isNotNull(), F.col("beyond")).otherwise(F.col("at")).alias("at"), *kept, F.when(both, F.col("f")).alias("gone"), *gone)


def _solved(start: DataFrame, values: list[str], merge: Callable[[Column, Column], Column], doubled: Callable[[DataFrame], DataFrame], back: Callable[[str, str], Column], direct: int) -> DataFrame:
    """(e, values) for links (e, at, values): `doubled` solves what is left of them, `back` an element from its own and the next one's values."""
    spark = start.sparkSession
    names = ["e", "at", *values]
    wide = start.select(*names, F.lit(None).cast("long").alias("gone"), *(F.lit(None).cast("long").alias(f"gone_{v}") for v in values))
    read = spark.read.schema(wide.schema).parquet
    paths = [written(wide, "list-rounds")]
    left = read(paths[0]).where(LINKED).count()
    while left > direct:
        # A cycle of one element is done and stays behind in its round's table.
        step = _shorter(read(paths[-1]).where("at IS NULL OR at <> e").select(*names), values, merge, len(paths))
        paths.append(written(step, "list-rounds"))
        left = read(paths[-1]).where(LINKED).count()
    rest = doubled(read(paths[-1]).where("at IS NULL OR at <> e").select(*names))
    known = [written(rest.select("e", *values), "list-known")]
    for path in reversed(paths):
        table = read(path)
        alone = table.where("at = e").select("e", *values)
        found = spark.read.schema(rest.select("e", *values).schema).parquet(*known).union(alone)
        gone = table.where("gone IS NOT NULL").select(F.col("gone").alias("e"), "at", *(F.col(f"gone_{v}").alias(v) for v in values))
        put = gone.join(found.select(F.col("e").alias("at"), *(F.col(v).alias(f"next_{v}") for v in values)), "at", "left")
        known.append(written(put.select("e", *(back(v, f"next_{v}").alias(v) for v in values)).union(alone), "list-known"))
        remove(spark, path)
    return spark.read.schema(rest.select("e", *values).schema).parquet(*known)


def cycle_labels(links: DataFrame, direct: int = DIRECT) -> DataFrame:
    """(e, label) of a permutation (e, next): the smallest member of each element's cycle."""

    def doubled(few: DataFrame) -> DataFrame:
        # After k rounds a label is the smallest of 2**k elements, and a round that changes none was not needed.
        rounds, moved = Rounds("cycles"), 1
        state = rounds.put(few.select("e", "at", "label", F.lit(True).alias("moved")))
        while moved:
            beyond = state.select(F.col("e").alias("at"), F.col("at").alias("to"), F.col("label").alias("other"))
            step = state.join(beyond, "at").select("e", F.col("to").alias("at"), F.least("label", "other").alias("label"), (F.col("other") < F.col("label")).alias("moved"))
            state, moved = rounds.counted(step, "moved")
        return state

    start = links.select(F.col("e").cast("long").alias("e"), F.col("next").cast("long").alias("at"), F.col("e").cast("long").alias("label"))
    return _solved(start, ["label"], F.least, doubled, lambda own, after: F.col(after), direct)


def list_ranks(links: DataFrame, *sums: str, direct: int = DIRECT) -> DataFrame:
    """(e, sums) of lists (e, next, sums), where the last one's next is null: for each named column what all elements behind an element have of it."""
    none = F.lit(0).cast("long")
    weights = materialize(links.select(F.col("e").alias("at"), *(F.col(c).cast("long").alias(c) for c in sums)), "list-weights")
    start = links.select(F.col("e").cast("long").alias("e"), F.col("next").cast("long").alias("at")).join(weights, "at", "left").select("e", "at", *(F.coalesce(c, none).alias(c) for c in sums))

    def doubled(few: DataFrame) -> DataFrame:
        rounds = Rounds("ranks")
        state, left = rounds.counted(few, "at IS NOT NULL")
        while left:
            beyond = state.select(F.col("e").alias("at"), F.col("at").alias("to"), *(F.col(c).alias(f"more_{c}") for c in sums))
            step = state.join(beyond, "at", "left").select("e", F.col("to").alias("at"), *((F.col(c) + F.coalesce(f"more_{c}", none)).alias(c) for c in sums))
            state, left = rounds.counted(step, "at IS NOT NULL")
        return state

    return _solved(start, list(sums), lambda a, b: a + b, doubled, lambda own, after: F.col(own) + F.coalesce(F.col(after), none), direct)
