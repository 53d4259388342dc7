"""Layers for directed graphs with circles: ranks of strong components, bends on long links, and orders with few crossings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ordinals import with_ordinal, with_sum_before
from loomgraph.model import Graph
from loomgraph.operators.order import strong_components, topological_rounds
from loomgraph.session import materialize


def component_ranks(graph: Graph) -> DataFrame:
    """(id, layer): a strong component lies one layer behind its deepest predecessor; its members share the layer."""
    strong = materialize(strong_components(graph), "rank-components")
    a, b = strong.select(F.col("id").alias("src"), F.col("component").alias("a")), strong.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    links = graph.edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("a <> b")
    links = materialize(links.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight")).distinct(), "rank-links")
    rounds = topological_rounds(Graph(strong.select(F.col("component").alias("id")).distinct(), links))
    return materialize(strong.join(rounds.select(F.col("id").alias("component"), F.col("round").alias("layer")), "component").select("id", "layer"), "ranks")


def crossings(hops: DataFrame) -> int:
    """How many pairs of hops (layer, a, b) from place a of a layer to place b of the next one cross.

    Those are pairs with a before a' and b behind b'. Two values of b differ first at one bit: there the hop that comes
    earlier has a one and the later one a zero. So for each bit, the ones before each zero are counted among hops of equal
    higher bits, which is a running sum and never a table of pairs.
    """
    top = hops.agg(F.max("b")).first()[0]
    if not top:
        return 0
    bits = hops.select("layer", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(int(top).bit_length() - 1))).alias("bit"))
    b = F.col("b").cast("long")
    shifted = lambda k: F.call_function("shiftright", b, k)
    rows = bits.select("layer", "bit", shifted(F.col("bit") + 1).alias("high"), "a", "b", shifted(F.col("bit")).bitwiseAND(F.lit(1).cast("long")).alias("one"))
    counted = with_sum_before(rows, ["layer", "bit", "high"], ["a", "b"], "one", "ones")
    return counted.where("one = 0").agg(F.coalesce(F.sum("ones"), F.lit(0))).first()[0]


@dataclass(frozen=True)
class Layers:
    """places: (id, layer, place). bends: (src, dst, layer, place) where links of distinct ends pass a layer between their own. Crossings before and after the sweeps."""

    places: DataFrame
    bends: DataFrame
    crossings_before: int
    crossings_after: int


def layered_order(graph: Graph, sweeps: int = 4) -> Layers:
    """Ranks, and an order in each layer in which fewer links cross than by ids.

    A link over more than one layer gets a bend in each layer between. In a sweep, nodes and bends of all layers are
    ordered by the mean place of what they are linked with above, relative to the width of that layer; those without
    such a link keep their place. All layers are sorted at once by ranges, so a sweep is a few jobs however many layers
    there are, and an order reaches one layer further with each. As long as crossings fall there are further sweeps, at
    most `sweeps`; then the same by what lies below. The order with the fewest crossings is kept, so the sweeps never do
    harm. Links within a layer (on circles) and loops get no bends and count no crossings.
    """
    ranks = component_ranks(graph)
    a, b = ranks.select(F.col("id").alias("src"), F.col("layer").alias("la")), ranks.select(F.col("id").alias("dst"), F.col("layer").alias("lb"))
    links = graph.edges.select("src", "dst").where("src <> dst").distinct().join(a, "src").join(b, "dst").where("la < lb")
    steps = links.select("src", "dst", "la", "lb", F.explode(F.sequence("la", F.col("lb") - 1)).alias("layer"))
    # A point is a node (id, -1) or a bend (src, dst) in its layer.
    point = lambda layer, lo, hi: F.struct(layer.alias("layer"), F.when(layer == F.col("la"), F.col("src")).when(layer == F.col("lb"), F.col("dst")).otherwise(F.col(lo)).alias("p"), F.when((layer == F.col("la")) | (layer == F.col("lb")), F.lit(None).cast("long")).otherwise(F.col(hi)).alias("q"))
    hops = materialize(steps.select(point(F.col("layer"), "src", "dst").alias("up"), point(F.col("layer") + 1, "src", "dst").alias("down")), "layer-hops")
    bends = hops.where("up.q IS NOT NULL").select(F.col("up").alias("point"))
    nodes = ranks.select(F.struct("layer", F.col("id").alias("p"), F.lit(None).cast("long").alias("q")).alias("point"))
    points = nodes.union(bends)

    def placed(rows: DataFrame, *by: Column) -> DataFrame:
        """(point, place, share): places in each layer in the given order, and where in the width of the layer that is."""
        ordered = materialize(with_ordinal(rows.withColumn("layer", F.col("point.layer")), "layer", *by, F.col("point.p"), F.col("point.q").asc_nulls_first()), "layer-order")
        first = ordered.groupBy("layer").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("wide"))
        place = F.col("ordinal") - F.col("first")
        return materialize(ordered.join(first, "layer").select("point", place.alias("place"), ((place + 0.5) / F.col("wide")).alias("share")), "layer-places")

    def crossed(places: DataFrame) -> int:
        up, down = places.select(F.col("point").alias("up"), F.col("place").alias("a")), places.select(F.col("point").alias("down"), F.col("place").alias("b"))
        return crossings(hops.join(up, "up").join(down, "down").select(F.col("up.layer").alias("layer"), "a", "b"))

    best = placed(points)
    before = least = crossed(best)
    for near, far in (("down", "up"), ("up", "down")):
        current, last = best, least
        for _ in range(sweeps if least else 0):
            mean = hops.join(current.select(F.col("point").alias(far), "share"), far).groupBy(F.col(near).alias("point")).agg(F.avg("share").alias("mean"))
            current = placed(current.join(mean, "point", "left").select("point", F.coalesce("mean", "share").alias("mean")), F.col("mean"))
            now = crossed(current)
            if now < least:
                best, least = current, now
            if now >= last or not least:
                break
            last = now
    split = best.select("point.layer", "point.p", "point.q", "place")
    return Layers(
        split.where("q IS NULL").select(F.col("p").alias("id"), "layer", "place"),
        split.where("q IS NOT NULL").select(F.col("p").alias("src"), F.col("q").alias("dst"), "layer", "place"),
        before, least,
    )


def hierarchical(layers: Layers, width: float = 800.0, height: float = 600.0, padding: float = 30.0, size: float = 24.0, direction: str = "down") -> tuple[DataFrame, DataFrame]:
    """(id, x, y) of nodes and (src, dst, layer, x, y) of bends, spread over an area around the origin; layers lead down, up, right or left."""
    if direction not in ("down", "up", "right", "left"):
        raise ValueError(f"layers lead down, up, right or left, not {direction}")
    both = layers.places.select("layer", "place").union(layers.bends.select("layer", "place"))
    wide = materialize(both.groupBy("layer").agg(F.count(F.lit(1)).alias("wide")), "layer-widths")
    deep = wide.agg(F.count(F.lit(1)).alias("deep"))

    def gap(room: float, n: Column) -> Column:
        return F.when(n <= 1, 0.0).otherwise(F.greatest(F.lit(room - 2 * padding - size) / (n - 1), F.lit(size)))

    def spread(rows: DataFrame) -> DataFrame:
        rows = rows.join(wide, "layer").join(F.broadcast(deep))
        across = (F.col("place") + 1 - (F.col("wide") + 1) / 2) * gap(width, F.col("wide"))
        along = (F.col("layer") + 1 - (F.col("deep") + 1) / 2) * gap(height, F.col("deep")) * (-1 if direction in ("up", "left") else 1)
        x, y = (across, along) if direction in ("down", "up") else (along, across)
        return rows.withColumns({"x": x, "y": y})

    return spread(layers.places).select("id", "x", "y"), spread(layers.bends).select("src", "dst", "layer", "x", "y")
