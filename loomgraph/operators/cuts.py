"""The least cut of an undirected reading: exact contractions first, then random contractions, many side by side.

The best cut so far is what leaves a single node, merged or not. A pair of nodes that at least this weight holds together
is on one side of every better cut and is merged: by its own link and ways over common neighbours; or by forests, since
a link that K - 1 spanning forests taken out one after the other leave over has K disjoint ways between its ends. What
is left is contracted at random: each trial gives every link an exponential arrival of its weight's rate and merges in
that order. All trials are rows of one table. The last two sides of a trial are each a merged node at some round before
they meet, so looking at what leaves every merged node finds the trial's cut, and others on the way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import Graph
from loomgraph.operators.components import component_labels
from loomgraph.operators.order import component_ids, spanning_forest
from loomgraph.session import Rounds, counted, materialize


@dataclass(frozen=True)
class Cut:
    """weight; side (id): the nodes of one side; proven: whether the contractions alone show that no cut is lighter."""

    weight: float
    side: DataFrame
    proven: bool


def _summed(links: DataFrame, *keys: str) -> DataFrame:
    return links.where("a <> b").groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))


def _degrees(links: DataFrame, *keys: str) -> DataFrame:
    return links.select(*keys, F.col("a").alias("v"), "w").union(links.select(*keys, "b", "w")).groupBy(*keys, "v").agg(F.sum("w").alias("w"))


def _renamed(links: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """Links between what their ends are merged into; names: (keys, v, to)."""
    a, b = names.select(*keys, F.col("v").alias("a"), F.col("to").alias("x")), names.select(*keys, F.col("v").alias("b"), F.col("to").alias("y"))
    moved = links.join(a, [*keys, "a"], "left").join(b, [*keys, "b"], "left").select(*keys, F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"), "w")
    return _summed(moved, *keys)


def _held_by_ways(links: DataFrame, best: float) -> DataFrame:
    both = links.select("a", "b", "w").union(links.select("b", "a", "w"))
    few = both.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= MIDDLE).select("a")
    over = both.join(few, "a").select(F.col("a").alias("m"), F.col("b").alias("x"), F.col("w").alias("p"))
    ways = over.join(over.select("m", F.col("x").alias("y"), F.col("p").alias("q")), "m").where("x < y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum(F.least("p", "q")).alias("more"))
    return ways.join(links, ["a", "b"], "left").where(F.coalesce("w", F.lit(0.0)) + F.col("more") >= best).select("a", "b")


def _held(links: DataFrame, best: float) -> list:
    """What finds pairs that hold together, in the order of what it costs; each is left for what those before it do not find."""
    parts = math.ceil(best / links.agg(F.percentile_approx("w", 0.75)).first()[0])
    if parts > MOST_FORESTS:
        return [_held_by_ways]
    n = F.least("n", F.lit(MIDDLE + 1))
    ends = links.select(F.col("a").alias("v")).union(links.select("b")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    sizes = ends.agg(F.sum("n").alias("links"), F.sum(F.when(n <= MIDDLE, n * (n - 1) / 2).otherwise(0)).alias("ways"), F.max(F.abs("v")).alias("id")).first()
    classes, forests = (partial(held, parts=parts) for held in (_held_by_classes, _held_by_forests))
    found = [_held_by_ways, forests] if sizes.ways <= sizes.links else [forests, _held_by_ways]
    # Classes number the nodes anew, by up to so many times their ids.
    return [classes, *found] if sizes.id < 1 << 56 else found


def _in_units(links: DataFrame, best: float, parts: int) -> DataFrame:
    """(src, dst, units): how often a 1 / parts of the best cut goes into each link, where it does."""
    return links.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.floor(F.col("w") * parts / F.lit(best)).cast("double").alias("units")).where("units >= 1")


def _held_by_classes(links: DataFrame, best: float, parts: int) -> DataFrame:
    """Nodes that each of `parts` classes of links holds together, so that as many ways of a unit lie between them.

    A link's units go to different classes, the first by a hash. All classes are labelled at once: a node has a number in each.
    """
    first = F.pmod(F.xxhash64("src", "dst"), F.lit(parts))
    each = _in_units(links, best, parts).select("src", "dst", F.explode(F.sequence(first, first + F.least("units", F.lit(parts)).cast("long") - 1)).alias("k"))
    number = lambda end: (F.col(end) * parts + F.col("k") % parts).alias(end)
    labels = component_labels(each.select(number("src"), number("dst")))
    slots = F.array_sort(F.collect_list(F.struct(F.pmod("id", F.lit(parts)).alias("k"), "component")))
    groups = labels.groupBy(F.expr(f"(id - pmod(id, {parts})) div {parts}").alias("b")).agg(slots.alias("slots")).where(F.size("slots") == parts)
    groups = materialize(groups.select("b", F.col("slots.component").alias("slots")), "cut-classes")
    low = groups.groupBy("slots").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.join(low, "slots").where("a <> b").select("a", "b")


def _held_by_forests(links: DataFrame, best: float, parts: int) -> DataFrame:
    """Links that are left over when parts - 1 forests are taken, each of a unit of 1 / parts of the best cut from its links."""
    rounds = Rounds("cut-units")
    rest = rounds.put(_in_units(links, best, parts))
    for _ in range(parts - 1):
        forest = spanning_forest(Graph.from_edges(rest.select("src", "dst", (-F.col("units")).alias("weight"))))
        taken = forest.select("src", "dst", F.lit(1.0).alias("taken"))
        rest, n = rounds.counted(rest.join(taken, ["src", "dst"], "left").select("src", "dst", (F.col("units") - F.coalesce("taken", F.lit(0.0))).alias("units")).where("units >= 1"), "true")
        if not n:
            break
    return rest.select(F.col("src").alias("a"), F.col("dst").alias("b"))


def _contracted(links: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, float, DataFrame | None]:
    """Merges pairs that no cut lighter than the best single node parts; what is left, and the best cut so far."""
    best, side = math.inf, None
    while True:
        light = _degrees(links).orderBy("w", "v").first()
        if light is None:
            return links, members, best, side
        if light.w < best:
            best, side = light.w, materialize(members.where(F.col("to") == light.v).select("id"), "cut-side")
        heavy, n = counted(links.where(F.col("w") >= best).select("a", "b"), "cut-heavy")
        if not n:
            for held in _held(links, best):
                heavy, n = counted(held(links, best), "cut-heavy")
                if n:
                    break
        if not n:
            return links, members, best, side
        names = component_labels(heavy, "a", "b").select(F.col("id").alias("v"), F.col("component").alias("to"))
        links = materialize(_renamed(links, names), "cut-links")
        members = materialize(members.withColumnRenamed("to", "v").join(names, "v", "left").select("id", F.coalesce("to", "v").alias("to")), "cut-members")


#: Links of a node over which pairs of its neighbours are looked at as being held together by it.
MIDDLE = 64
#: Forests that are taken at most before the rest is left to chance; they are as fine as the upper quarter of the links asks for.
MOST_FORESTS = 64
#: Rows (trials times links) that are contracted side by side; further trials follow.
ROWS = 20_000_000


def global_min_cut(graph: Graph, trials: int | None = None, seed: int = 1) -> Cut:
    """A cut of least weight into two sides that are not empty; weights of parallel edges add up, loops count for nothing.

    A graph in several parts, or with fewer than two nodes, has a cut of weight 0 (its side is the part of the smallest
    node). Weights have to be positive. With k nodes left after the exact contractions a trial finds a least cut with a
    chance of at least 2 / (k (k - 1)); without `trials` there are k (k - 1) ln(k) / 2 and then some, which leaves a chance
    of 1 / k that there is a lighter one. `proven` is true where nothing was left to chance.
    """
    edges = graph.edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"))
    if edges.where("w IS NULL OR w <= 0").limit(1).count():
        raise ValueError("weights of a cut have to be positive")
    parts = materialize(component_ids(graph), "cut-parts")
    names = parts.select("component").distinct().orderBy("component").limit(2).collect()
    if len(names) != 1 or graph.nodes.limit(2).count() < 2:
        first = names[0].component if names else None
        return Cut(0.0, parts.where(F.col("component") == F.lit(first)).select("id"), True)
    members = materialize(graph.nodes.select("id", F.col("id").alias("to")).distinct(), "cut-members")
    links, members, best, side = _contracted(materialize(_summed(edges), "cut-links"), members)
    k = members.select("to").distinct().count()
    if k <= 2:
        return Cut(float(best), side, True)
    trials = trials or max(8, math.ceil(k * (k - 1) / 2 * math.log(k)) + k)
    step = max(1, ROWS // max(1, links.count()))
    for first in range(0, trials, step):
        found = _trials(links, range(first, min(trials, first + step)), seed, best)
        if found is not None:
            best, inside = found
            side = materialize(members.join(inside, "to", "left_semi").select("id"), "cut-side")
    return Cut(float(best), side, False)


def _trials(links: DataFrame, trials: range, seed: int, best: float) -> tuple[float, DataFrame] | None:
    """The lightest cut below `best` that the trials meet: its weight and the nodes (to) on one side."""
    rows, state = Rounds("cut-trials"), Rounds("cut-merged")
    # A link of weight w arrives after an exponential time of rate w: the order is that of drawing links by weight.
    drawn = F.xxhash64("trial", "a", "b", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5
    arrival = -F.log(drawn / F.lit(float(1 << 52))) / F.col("w")
    each = links.select(F.explode(F.sequence(F.lit(trials.start), F.lit(trials.stop - 1))).alias("trial"), "a", "b", "w")
    ranked = materialize(each.select("trial", "a", "b", F.col("a").alias("p"), F.col("b").alias("q"), "w", arrival.alias("t")), "cut-arrivals")
    ends = ranked.select("trial", F.col("a").alias("v")).union(ranked.select("trial", "b")).distinct()
    merged = state.put(ends.select("trial", "v", F.col("v").alias("to")))
    left, n, winner = ranked, 1, None
    while n:
        light = _degrees(left.select("trial", F.col("p").alias("a"), F.col("q").alias("b"), "w"), "trial").orderBy("w", "trial", "v").first()
        if light.w < best:
            best = light.w
            winner = materialize(merged.where((F.col("trial") == light.trial) & (F.col("to") == light.v)).select(F.col("v").alias("to")), "cut-inside")
        arrived = F.struct("t", "a", "b", "p", "q")
        earliest = left.select("trial", F.col("p").alias("v"), arrived.alias("e")).union(left.select("trial", "q", arrived)).groupBy("trial", "v").agg(F.min("e").alias("e"))
        names = _merged_names(earliest.select("trial", "e.p", "e.q"))
        merged = state.put(merged.join(names.select("trial", F.col("v").alias("to"), F.col("to").alias("new")), ["trial", "to"], "left").select("trial", "v", F.coalesce("new", "to").alias("to")))
        p, q = names.select("trial", F.col("v").alias("p"), F.col("to").alias("x")), names.select("trial", F.col("v").alias("q"), F.col("to").alias("y"))
        moved = left.join(p, ["trial", "p"], "left").join(q, ["trial", "q"], "left")
        left, n = rows.counted(moved.select("trial", "a", "b", F.coalesce("x", "p").alias("p"), F.coalesce("y", "q").alias("q"), "w", "t").where("p <> q"), "true")
    return None if winner is None else (best, winner)


def _merged_names(pairs: DataFrame) -> DataFrame:
    """(trial, v, to): the smallest node that each is linked with within its trial, by jumping labels."""
    both = materialize(pairs.select("trial", F.col("p").alias("a"), F.col("q").alias("b")).union(pairs.select("trial", "q", "p")), "cut-pairs")
    rounds = Rounds("cut-names")
    state, moved = rounds.counted(both.groupBy("trial", F.col("a").alias("v")).agg(F.min("b").alias("m")).select("trial", "v", F.least("v", "m").alias("to")), "true")
    while moved:
        near = both.join(state.select("trial", F.col("v").alias("b"), "to"), ["trial", "b"]).groupBy("trial", F.col("a").alias("v")).agg(F.min("to").alias("m"))
        jump = state.select("trial", F.col("v").alias("to"), F.col("to").alias("beyond"))
        after = state.join(near, ["trial", "v"]).join(jump, ["trial", "to"]).select("trial", "v", F.col("to").alias("old"), F.least("to", "m", "beyond").alias("to"))
        table, moved = rounds.counted(after, "old <> to")
        state = table.select("trial", "v", "to")
    return state


def crossing_edges(graph: Graph, cut: Cut) -> DataFrame:
    """(edge_id, src, dst, weight): the physical edges between the two sides, in either direction."""
    inside = cut.side.select(F.col("id").alias("src"), F.lit(True).alias("x"))
    rows = graph.edges.join(inside, "src", "left").join(inside.withColumnsRenamed({"src": "dst", "x": "y"}), "dst", "left")
    return rows.where(F.coalesce("x", F.lit(False)) != F.coalesce("y", F.lit(False))).select("edge_id", "src", "dst", "weight")
