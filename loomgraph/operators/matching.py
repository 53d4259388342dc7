"""Maximum matching in general graphs: alternating forests grown in rounds, with blossoms, and a proof of the result.

A phase grows alternating trees from all free nodes at once. An even node holds one alternating path from its root. An
edge from an even node to a node outside the forest adds that node and its mate. An edge between even nodes of two trees
gives an augmenting path; a largest set of such that no tree takes part twice is applied, and a new phase begins. An edge
between even nodes of one tree closes a blossom: every node on the one path beyond what both paths share, that was odd
only, becomes even by the other path and back along its own. When nothing grows, no augmenting path is left.

Then the odd nodes are a barrier: as many components of odd size fall apart without them as there are odd nodes and free
nodes together, which no matching can better.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import Graph
from loomgraph.operators.choices import maximal_matching
from loomgraph.session import Rounds, materialize


@dataclass(frozen=True)
class Matching:
    """pairs (src, dst) with src < dst, and barrier (id): the nodes that prove that no matching has more pairs."""

    pairs: DataFrame
    barrier: DataFrame


def _mates(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("src").alias("id"), F.col("dst").alias("mate")).union(pairs.select("dst", "src"))


def _shortest(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: the one of the shortest path, of equal ones the first."""
    return rows.groupBy(*keys).agg(F.min(F.struct(F.size("path").alias("n"), "path", "root")).alias("best")).select(*keys, "best.path", "best.root")


def _grown(links: DataFrame, mates: DataFrame, even: DataFrame, fresh: DataFrame, odd: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of growth: (augmenting paths, new even nodes, new odd nodes)."""
    seen = links.join(fresh.select(F.col("id").alias("src"), F.col("root").alias("root"), F.col("path").alias("path")), "src")
    met = materialize(seen.join(even.select(F.col("id").alias("dst"), F.col("root").alias("other"), F.col("path").alias("way")), "dst", "left"), "match-met")
    between = met.where("other <> root").select(F.least("root", "other").alias("src"), F.greatest("root", "other").alias("dst"), F.concat("path", F.reverse("way")).alias("path"), F.lit(0).alias("root"))
    found = materialize(_shortest(between, "src", "dst"), "match-found")
    # Trees grow over an edge of the matching; of two ways to take one such edge, from either end, one is followed.
    outside = met.where("other IS NULL").select(F.col("dst").alias("id"), "root", "path").join(odd, "id", "left_anti").join(mates, "id")
    steps = outside.select(F.least("id", "mate").alias("pair"), "root", F.concat("path", F.array("id", "mate")).alias("path"))
    taken = materialize(_shortest(steps, "pair"), "match-taken")
    same = met.where("other = root")
    both = same.select("root", "path", "way").union(same.select("root", F.col("way"), F.col("path")))
    shared = F.array_max(F.transform("way", lambda x, k: F.when(F.array_contains("path", x), k).otherwise(-1)))
    beyond = both.select("root", "path", "way", F.posexplode("way").alias("k", "id"), shared.alias("shared")).where("k > shared AND k % 2 = 1")
    turned = beyond.join(even.select("id"), "id", "left_anti").select("id", "root", F.concat("path", F.reverse(F.slice("way", F.col("k") + 1, F.size("way") - F.col("k")))).alias("path"))
    more = taken.select(F.element_at("path", -1).alias("id"), "root", "path").union(turned.select("id", "root", "path"))
    return found, materialize(_shortest(more, "id").select("id", "root", "path"), "match-even"), taken.select(F.element_at("path", -2).alias("id"))


def maximum_matching(graph: Graph, start: DataFrame | None = None) -> Matching:
    """The most pairs of linked nodes without a common end; direction and loops are ignored. start: a matching to begin with.

    Without one it begins with a maximal matching, which has at least half of the pairs. Rows of paths are as many as
    even nodes, and a path is as long as a tree is deep.
    """
    links = materialize(graph.undirected(), "match-links")
    kept = Rounds("match-mates")
    mates = kept.put(_mates(start if start is not None else maximal_matching(graph)))
    while True:
        free = graph.nodes.select("id").distinct().join(mates, "id", "left_anti")
        even = fresh = materialize(free.select("id", F.col("id").alias("root"), F.array("id").alias("path")), "match-even")
        odd = materialize(free.select("id").limit(0), "match-odd")
        paths = None
        while paths is None:
            found, fresh, more = _grown(links, mates, even, fresh, odd)
            if found.limit(1).count():
                trees = maximal_matching(Graph.from_edges(found.select("src", "dst", F.lit(1.0).alias("weight"))))
                paths = materialize(found.join(trees, ["src", "dst"], "left_semi").select("path"), "match-paths")
            elif not fresh.limit(1).count():
                return Matching(mates.where("id < mate").select(F.col("id").alias("src"), F.col("mate").alias("dst")), materialize(odd.join(even.select("id"), "id", "left_anti"), "match-barrier"))
            else:
                even, odd = materialize(even.union(fresh), "match-even"), materialize(odd.union(more), "match-odd")
        # On a path every second edge, the first and the last too, comes into the matching and the others leave it.
        spots = paths.select(F.posexplode("path").alias("k", "id"), "path")
        now = spots.select("id", F.get("path", F.when(F.col("k") % 2 == 0, F.col("k") + 1).otherwise(F.col("k") - 1)).alias("mate"))
        mates = kept.put(mates.join(now.select("id"), "id", "left_anti").union(now))
