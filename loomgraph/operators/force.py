"""Force-directed places: nodes repel each other, links are springs, and a weak pull leads to the middle.

Repulsion is summed over a hierarchy of grid cells. The square around all nodes is halved again and again; at each level a
node feels the cells that are not next to its own but whose parents are next to its parent, each as its nodes' number at
their middle. At the finest level it feels the nodes of its own and the eight neighbouring cells one by one. So each pair of
nodes is counted exactly once, near ones exactly and far ones by a mean, and no two sides are ever crossed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.model import Graph
from loomgraph.session import Rounds, materialize, remove, written

#: Nodes in a cell of the finest level, at most, and the finest level that there is.
LEAF, DEEPEST = 16, 20
MASS = "struct<id:bigint,n:bigint,x:double,y:double,own:boolean>"


@dataclass(frozen=True)
class Forces:
    """Strengths and cooling; `iterations` rounds at most, each moves a node by the temperature at most."""

    repulsion: float = 2048.0
    overlap: float = 4.0
    ideal_length: float = 48.0
    elasticity: float = 32.0
    gravity: float = 1.0
    iterations: int = 500
    initial_temp: float = 128.0
    cooling: float = 0.99
    min_temp: float = 1.0
    node_size: float = 24.0


def seeded(nodes: DataFrame, known: DataFrame | None, forces: Forces) -> DataFrame:
    """(id, x, y): known places (id, x, y), and for other nodes one on a ring of two rest lengths around the middle of the known, by a hash of the id."""
    angle = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * (2 * 3.141592653589793 / (1 << 30))
    ring = nodes.select("id", (F.cos(angle) * 2 * forces.ideal_length).alias("rx"), (F.sin(angle) * 2 * forces.ideal_length).alias("ry"))
    if known is None:
        return ring.select("id", F.col("rx").alias("x"), F.col("ry").alias("y"))
    known = known.select("id", "x", "y").where("x IS NOT NULL AND y IS NOT NULL")
    middle = known.join(nodes.select("id"), "id", "left_semi").agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("mx"), F.coalesce(F.avg("y"), F.lit(0.0)).alias("my"))
    rows = ring.join(known, "id", "left").join(F.broadcast(middle))
    return rows.select("id", F.coalesce("x", F.col("mx") + F.col("rx")).alias("x"), F.coalesce("y", F.col("my") + F.col("ry")).alias("y"))


def _square(places: DataFrame) -> tuple[float, float, float]:
    """Left and top of the square that holds all places, and its side."""
    box = places.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return box[0], box[1], max(box[2] - box[0], box[3] - box[1], 1e-6) * (1 + 1e-9)


def _cell(axis: Column, low: float, side: float, level: Column) -> Column:
    """The number of the cell of a level that a coordinate lies in."""
    finest = F.least(F.floor((axis - low) / side * (1 << DEEPEST)), F.lit((1 << DEEPEST) - 1)).cast("int")
    return F.call_function("shiftright", finest, F.lit(DEEPEST) - level)


def _push(dx: Column, dy: Column, n: Column, forces: Forces) -> Column:
    """How n nodes at a distance of (dx, dy) push a node, as a factor of (dx, dy): boxes that overlap by how much they do, others by the gap between them."""
    far = F.hypot(dx, dy)
    wide = F.greatest(F.abs(dx), F.abs(dy))
    over = F.hypot(F.lit(forces.node_size) - F.abs(dx), F.lit(forces.node_size) - F.abs(dy))
    gap = F.greatest(far * F.abs(F.lit(1.0) - F.lit(forces.node_size) / wide), F.lit(1.0))
    strength = F.when((wide <= forces.node_size) & (over > 0), over * forces.overlap).otherwise(F.lit(2 * forces.repulsion) / (gap * gap))
    return -n * strength / F.greatest(far, F.lit(0.5))


def repulsion(places: DataFrame, forces: Forces) -> DataFrame:
    """(id, fx, fy) of places (id, x, y): the sum of all other nodes' pushes.

    The finest level is the first whose cells hold at most LEAF nodes. Where more than LEAF nodes lie within a
    2**-20 part of the square, they feel each other as one node at their middle, so nothing grows with such a crowd.
    """
    left, top, side = _square(places)
    levels = F.explode(F.sequence(F.lit(2), F.lit(DEEPEST)))
    at = places.select("id", "x", "y", levels.alias("level"))
    at = at.select("id", "x", "y", "level", _cell(F.col("x"), left, side, F.col("level")).alias("cx"), _cell(F.col("y"), top, side, F.col("level")).alias("cy"))
    path = written(at.groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")), "force-cells")
    cells = places.sparkSession.read.parquet(path)
    fullest = {r[0]: r[1] for r in cells.groupBy("level").agg(F.max("n")).collect()}
    leaf = next((k for k in range(2, DEEPEST) if fullest[k] <= LEAF), DEEPEST)
    cells = cells.where(F.col("level") <= leaf)
    at = at.where(F.col("level") <= leaf)

    # A cell's own mass, or at the finest level its nodes one by one.
    own = F.array(F.struct(F.lit(None).cast("bigint").alias("id"), "n", "x", "y", F.lit(False).alias("own"))).cast(f"array<{MASS}>")
    held = at.where(F.col("level") == leaf).join(cells.where((F.col("level") == leaf) & (F.col("n") <= LEAF)).select("level", "cx", "cy"), ["level", "cx", "cy"], "left_semi")
    held = held.groupBy("level", "cx", "cy").agg(F.collect_list(F.struct("id", F.lit(1).cast("bigint").alias("n"), "x", "y", F.lit(False).alias("own"))).alias("held"))
    near = cells.where(F.col("level") == leaf).join(held, ["level", "cx", "cy"], "left").select("level", "cx", "cy", F.coalesce("held", own).alias("mass"), F.lit(True).alias("near"))
    far = cells.select("level", "cx", "cy", own.alias("mass"), F.lit(False).alias("near"))

    # Each cell goes to the cells that feel it: those whose parents touch its own, next to it only at the finest level.
    span = lambda c: F.sequence(F.shiftright(c, 1) * 2 - 2, F.shiftright(c, 1) * 2 + 3)
    sent = near.union(far).select("level", "mass", "near", F.col("cx").alias("fx"), F.col("cy").alias("fy"), F.explode(span(F.col("cx"))).alias("cx"), "cy")
    sent = sent.select("level", "mass", "near", "fx", "fy", "cx", F.explode(span(F.col("cy"))).alias("cy"))
    beside = (F.abs(F.col("cx") - F.col("fx")) <= 1) & (F.abs(F.col("cy") - F.col("fy")) <= 1)
    here = (F.col("cx") == F.col("fx")) & (F.col("cy") == F.col("fy"))
    marked = F.transform("mass", lambda m: m.withField("own", here))
    sent = sent.where(beside == F.col("near")).select("level", "cx", "cy", marked.alias("mass")).join(cells.select("level", "cx", "cy"), ["level", "cx", "cy"], "left_semi")
    felt = sent.groupBy("level", "cx", "cy").agg(F.flatten(F.collect_list("mass")).alias("mass"))

    def pushed(m: Column) -> Column:
        same = (m["x"] == F.col("x")) & (m["y"] == F.col("y"))
        # Nodes at one place part in a direction that both agree on.
        turn = F.pmod(F.xxhash64(F.least(m["id"], F.col("id")), F.greatest(m["id"], F.col("id"))), F.lit(1 << 20)) * (6.283185307179586 / (1 << 20))
        sign = F.when(F.coalesce(m["id"] < F.col("id"), F.lit(False)), F.lit(-1.0)).otherwise(F.lit(1.0))
        dx, dy = F.when(same, F.cos(turn) * sign).otherwise(m["x"] - F.col("x")), F.when(same, F.sin(turn) * sign).otherwise(m["y"] - F.col("y"))
        n = F.when(m["own"] & m["id"].isNull(), m["n"] - 1).otherwise(m["n"])
        return F.struct(dx.alias("dx"), dy.alias("dy"), n.alias("n"))

    others = F.filter("mass", lambda m: m["id"].isNull() | (m["id"] != F.col("id")))
    pushes = F.transform(F.transform(others, pushed), lambda v: F.struct((_push(v["dx"], v["dy"], v["n"], forces) * v["dx"]).alias("x"), (_push(v["dx"], v["dy"], v["n"], forces) * v["dy"]).alias("y")))
    rows = at.join(felt, ["level", "cx", "cy"]).select("id", pushes.alias("p"))
    total = lambda axis: F.aggregate("p", F.lit(0.0), lambda a, v: a + v[axis])
    out = materialize(rows.select("id", total("x").alias("fx"), total("y").alias("fy")).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy")), "force-pushes")
    remove(places.sparkSession, path)
    return out


def springs(places: DataFrame, edges: DataFrame, forces: Forces) -> DataFrame:
    """(id, fx, fy): the sum of what each node's links do; a link pulls by the square of what its gap lacks of the rest length or has beyond it."""
    a, b = (places.select(F.col("id").alias(k), F.col("x").alias(f"{k}_x"), F.col("y").alias(f"{k}_y")) for k in ("src", "dst"))
    rows = edges.where("src <> dst").select("src", "dst").join(a, "src").join(b, "dst")
    rows = rows.select("src", "dst", (F.col("dst_x") - F.col("src_x")).alias("dx"), (F.col("dst_y") - F.col("src_y")).alias("dy")).where("dx <> 0 OR dy <> 0")
    shrink = F.lit(1.0) - F.lit(forces.node_size) / F.greatest(F.abs("dx"), F.abs("dy"))
    gap = F.hypot("dx", "dy") * F.abs(shrink)
    pull = (F.lit(forces.ideal_length) - gap) * (F.lit(forces.ideal_length) - gap) / forces.elasticity * F.signum(shrink) / F.hypot("dx", "dy")
    rows = rows.withColumn("pull", pull)
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("pull").alias("k")), F.struct(F.col("dst").alias("id"), (-F.col("pull")).alias("k"))))
    rows = rows.select("dx", "dy", ends.alias("e"))
    return rows.groupBy(F.col("e.id").alias("id")).agg(F.sum(F.col("e.k") * F.col("dx")).alias("fx"), F.sum(F.col("e.k") * F.col("dy")).alias("fy"))


def force_layout(graph: Graph, known: DataFrame | None = None, fixed: DataFrame | None = None, forces: Forces = Forces()) -> DataFrame:
    """(id, x, y): places after the rounds, or when it has cooled down; `fixed` nodes (id) stay where they are known or seeded.

    Links to ids that are no nodes do nothing; parallel links pull once each. A graph without nodes has no places. One
    round is a job over nodes and links, written to the shared folder, and the version before it is deleted.
    """
    state = Rounds("force")
    places = state.put(seeded(graph.nodes.select("id").distinct(), known, forces))
    if places.isEmpty():
        return places
    links = materialize(graph.edges.select("src", "dst"), "force-links")
    heat, still = forces.initial_temp, materialize(fixed.select("id").distinct(), "force-fixed").withColumn("still", F.lit(True)) if fixed is not None else None
    for _ in range(forces.iterations):
        if heat < forces.min_temp:
            break
        middle = places.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
        pushes = repulsion(places, forces)
        sums = pushes.union(springs(places, links, forces)).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        rows = places.join(sums, "id", "left").join(F.broadcast(middle))
        away = F.hypot(F.col("mx") - F.col("x"), F.col("my") - F.col("y"))
        inward = F.when(away > 1, F.lit(forces.gravity) / away).otherwise(0.0)
        fx = F.coalesce("fx", F.lit(0.0)) + inward * (F.col("mx") - F.col("x"))
        fy = F.coalesce("fy", F.lit(0.0)) + inward * (F.col("my") - F.col("y"))
        rows = rows.select("id", "x", "y", fx.alias("fx"), fy.alias("fy")).withColumn("long", F.hypot("fx", "fy"))
        scale = F.when(F.col("long") > heat, F.lit(heat) / F.col("long")).otherwise(1.0)
        if still is not None:
            rows = rows.join(still, "id", "left")
            scale = F.when(F.col("still"), 0.0).otherwise(scale)
        places = state.put(rows.select("id", (F.col("x") + scale * F.col("fx")).alias("x"), (F.col("y") + scale * F.col("fy")).alias("y")))
        heat *= forces.cooling
    return places
