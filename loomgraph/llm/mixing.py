"""Mixing of sources to target weights by Poisson replication, in DataFrame functions only.

The target gives each source a share of the mixture. A source's mean repetition rate is its share of the target size
over its own size. Each document gets a uniform number from a hash of a seed and its id; the inverse of the Poisson
distribution function at that number is its count of copies. Copies are exploded and shuffled globally by a hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources whose rates are broadcast; a table of more sources is joined without a broadcast.
BROADCAST_SOURCES = 10_000
#: Salts over which the documents of one source are dealt in a join that is not broadcast.
SALTS = 32
#: The distribution function is inverted for means up to this; a larger mean is a sum of such draws.
MAX_MEAN = 16.0
#: Terms of the distribution function: at the largest mean, what lies beyond has less than the 1e-14 that doubles resolve.
TERMS = 64
UNIT = float(1 << 52)


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the seed and the parts; a null part counts as empty."""
    key = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / UNIT


def poisson_table(mean: Column) -> Column:
    """The distribution function at 0, 1, 2, ..., by the recursion p(k) = p(k - 1) * mean / k."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["c"])


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, total: Column | None = None) -> DataFrame:
    """(source, rate): mean copies of each source's documents.

    weights: the shares of the mixture, in any unit; sources that it does not name get 0. None: an equal share for every
    source. total: the size of the mixture in documents, an aggregate over the sources' own sizes `n`; by default it is
    as many documents as there are. A null source is a source of its own.
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = F.lit(1.0)
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        share = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(F.col("source"), F.lit(""))), F.lit(0.0)) if pairs else F.lit(0.0)
    weighted = sizes.withColumn("share", share)
    whole = weighted.agg(F.sum("share").alias("shares"), (total if total is not None else F.sum("n")).cast("double").alias("total")).first()
    if not whole["shares"]:
        return weighted.select("source", F.lit(0.0).alias("rate"))
    return weighted.select("source", (F.col("share") / F.lit(whole["shares"]) * F.lit(whole["total"]) / F.col("n")).alias("rate"))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: str = "mix-1", total: Column | None = None) -> DataFrame:
    """The mixture: every column of docs, and n_copies, copy (from 0) and mix_key, dealt out globally at random.

    Rows that are equal in id get the same count each. Null ids and texts are as any other; an empty table gives an
    empty one; a column of docs named n_copies, copy or mix_key is replaced. The order within a partition is by mix_key.
    """
    table = rates(docs, weights, total).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN)).cast("int"))
    table = table.withColumn("cdf", poisson_table(F.col("rate") / F.col("draws"))).select("source", "draws", "cdf")
    few = docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    own = docs.drop("n_copies", "copy", "mix_key")
    # The row travels as one column, so that none of its names meets one of these; many sources are joined over salts.
    packed = own.select(F.struct(*(F.col(f"`{c}`") for c in own.columns)).alias("row"), F.col("source").alias("source"), F.col("doc_id").alias("id"))
    if few:
        matched = packed.join(F.broadcast(table.withColumnRenamed("source", "rated")), F.col("source").eqNullSafe(F.col("rated")))
    else:
        salted = table.withColumnRenamed("source", "rated").withColumn("rated_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        packed = packed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        matched = packed.join(salted, F.col("source").eqNullSafe(F.col("rated")) & (F.col("salt") == F.col("rated_salt")))

    def draw(k: Column) -> Column:
        u = uniform(seed, F.col("id"), k)
        return F.size(F.filter("cdf", lambda c: c <= u))

    counts = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("draws") - 1), draw), F.lit(0), lambda a, b: a + b)
    counted = matched.select("row", "id", counts.alias("n_copies")).where("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("copy"), F.col("copy"))))
    return keyed.select("row.*", "n_copies", "copy", "mix_key").repartition(F.col("mix_key")).sortWithinPartitions("mix_key")
