"""Scores of nodes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ordinals import with_ordinal
from loomgraph.model import Graph
from loomgraph.session import dealt, materialize


def degree_centrality(graph: Graph) -> DataFrame:
    """(id, score): distinct neighbours other than itself over n - 1; 0 in a graph of fewer than two nodes."""
    n = graph.nodes.agg(F.count(F.lit(1)).alias("n"))
    degrees = graph.undirected().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    joined = graph.nodes.select("id").join(degrees, "id", "left").join(F.broadcast(n))
    return joined.select("id", F.when(F.col("n") > 1, F.coalesce("d", F.lit(0)) / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("score"))


def weighted_degree(graph: Graph, alpha: float, directed: bool) -> DataFrame:
    """(id, score): degree ** (1 - alpha) * strength ** alpha over the largest; alpha outside [0, 1] gives zeros.

    Directed: out-edges, parallel ones counted each. Undirected: distinct neighbours. Strength sums max(weight, 0)
    without loops.
    """
    flows = graph.edges.where("src <> dst").select("src", "dst", F.greatest(F.col("weight"), F.lit(0.0)).alias("w"))
    if not directed:
        flows = dealt(flows.union(flows.select("dst", "src", "w")), 2 * graph.tasks, "src", "dst")
    degree = F.count(F.lit(1)) if directed else F.count_distinct("dst")
    sums = flows.groupBy(F.col("src").alias("id")).agg(degree.alias("d"), F.sum("w").alias("s"))
    ok = 0 <= alpha <= 1
    raw = F.pow(F.coalesce("d", F.lit(0)).cast("double"), F.lit(1 - alpha)) * F.pow(F.coalesce("s", F.lit(0.0)), F.lit(alpha)) if ok else F.lit(0.0)
    rows = graph.nodes.select("id").join(sums, "id", "left").withColumn("raw", F.when(F.coalesce("d", F.lit(0)) > 0, raw).otherwise(F.lit(0.0)))
    top = rows.agg(F.max("raw").alias("top"))
    return rows.join(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(F.lit(0.0)).alias("score"))


#: Nodes whose links lie in one row when links are dealt to the tasks, and sources that are worth a task of their own.
CHUNK, LEAST = 1 << 16, 64
#: Words of 64 sources that closeness follows at once, links that it looks at in a step, and pairs that betweenness holds at once.
WORDS, STEP, HELD = 8, 1 << 19, 1 << 21


def _over_sources(graph: Graph, label: str, work: Callable, names: list[str]) -> DataFrame:
    """(id, names): sums over all tasks of what `work` has for each node from the task's share of the sources.

    Sources are dealt over tasks, and each task is sent the links once, as arrays of ordinals. So what is moved grows
    with the links and the nodes, times the tasks, and no row for a pair of nodes is made; a task holds the links and a
    bounded number of pairs besides. work: (starts, ends, sources) to an array for each name; the links of node k are
    ends[starts[k] : starts[k + 1]].
    """
    spark = graph.nodes.sparkSession
    sources = graph.nodes.select("id").distinct()
    links = materialize(graph.undirected(), f"{label}-links")
    at = materialize(with_ordinal(sources.union(links.select("src")).distinct(), "id").select("ordinal", "id"), f"{label}-ids")
    n, many = at.count(), sources.count()
    a, b = at.select(F.col("ordinal").alias("a"), F.col("id").alias("src")), at.select(F.col("ordinal").alias("b"), F.col("id").alias("dst"))
    # A source is a link to -1.
    rows = links.join(a, "src").join(b, "dst").select("a", "b").union(sources.join(at, "id").select("ordinal", F.lit(-1).cast("long")))
    chunks = rows.groupBy(F.floor(F.col("a") / CHUNK).alias("chunk")).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, many // LEAST))
    sent = materialize(chunks, f"{label}-chunks").crossJoin(F.broadcast(spark.range(tasks).select(F.col("id").alias("task")))).repartition(tasks, "task")

    def summed(key, parts):
        a, b = (np.concatenate([np.asarray(v) for v in parts[c]]) for c in ("a", "b"))
        own, order = np.sort(a[b < 0]), np.argsort(a[b >= 0], kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(a[b >= 0], minlength=n))])
        found = work(starts, b[b >= 0][order], np.array_split(own, tasks)[key[0]])
        return pd.DataFrame({"ordinal": np.arange(n), **dict(zip(names, found, strict=True))})

    each = sent.groupBy("task").applyInPandas(summed, ", ".join(["ordinal long", *(f"{c} double" for c in names)]))
    return each.groupBy("ordinal").agg(*(F.sum(c).alias(c) for c in names)).join(at, "ordinal").select("id", *names)


def _links_of(starts: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many links each of the nodes has, and the places of all of them."""
    size = starts[nodes + 1] - starts[nodes]
    return size, np.repeat(starts[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())


def _come_to(starts: np.ndarray, ends: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many sources come to each node, and the sum of their hops; a bit for each source, many sources at once."""
    n = len(starts) - 1
    reached, hops = np.zeros(n), np.zeros(n)
    for first in range(0, len(sources), 64 * WORDS):
        active = sources[first : first + 64 * WORDS]
        k = np.arange(len(active))
        known, fresh, level = np.zeros((n, WORDS), dtype=np.uint64), np.zeros((n, WORDS), dtype=np.uint64), 0
        known[active, k // 64] = fresh[active, k // 64] = np.uint64(1) << (k % 64).astype(np.uint64)
        while len(active):
            level += 1
            beside = np.zeros(n, dtype=bool)
            beside[ends[_links_of(starts, active)[1]]] = True
            near = np.flatnonzero(beside)
            steps = np.flatnonzero(np.diff(np.cumsum(starts[near + 1] - starts[near]) // STEP, prepend=-1))
            found = []
            for some in np.split(near, steps[1:]):
                size, links = _links_of(starts, some)
                come = np.bitwise_or.reduceat(fresh[ends[links]], np.cumsum(size) - size, axis=0) & ~known[some] if len(some) else known[:0]
                new = np.bitwise_count(come).sum(axis=1, dtype=np.int64)
                found.append((some[new > 0], come[new > 0], new[new > 0]))
            fresh[active] = 0
            for some, come, new in found:
                fresh[some] = come
                known[some] |= come
                reached[some] += new
                hops[some] += new * level
            active = np.concatenate([some for some, _, _ in found])
    return reached, hops


def _between(starts: np.ndarray, ends: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray]:
    """The sum over the sources of each node's dependency: counts of paths go forward level by level, shares of them back."""
    n = len(starts) - 1
    total, step = np.zeros(n), max(1, HELD // n)
    for first in range(0, len(sources), step):
        some = sources[first : first + step]
        size = len(some) * n
        level, paths, share, place = np.full(size, -1, dtype=np.int32), np.zeros(size), np.zeros(size), np.empty(size, dtype=np.int64)
        front = np.arange(len(some)) * n + some
        level[front], paths[front], fronts = 0, 1.0, []
        while len(front):
            fronts.append(front)
            count, links = _links_of(starts, front % n)
            to = ends[links] + np.repeat(front - front % n, count)
            new = level[to] < 0
            to = to[new]
            np.add.at(paths, to, np.repeat(paths[front], count)[new])
            k = np.arange(len(to))
            place[to] = k
            front = to[place[to] == k]
            level[front] = len(fronts)
        for depth in range(len(fronts) - 1, 0, -1):
            front = fronts[depth]
            count, links = _links_of(starts, front % n)
            to = ends[links] + np.repeat(front - front % n, count)
            u = np.add.reduceat(np.where(level[to] == depth + 1, share[to], 0.0), np.cumsum(count) - count)
            # A node's dependency is its paths times u; what it hands on for each path of the level before is (1 + dependency) / paths.
            share[front] = 1.0 / paths[front] + u
            np.add.at(total, front % n, paths[front] * u)
    return (total,)


def closeness(graph: Graph) -> DataFrame:
    """(id, score): r / (n - 1) * r / sum of hops, over the r nodes reached without direction; 0 if there are none.

    Hops are the same both ways, so what comes to a node counts for it. Work is a bit for each pair, times how many
    levels apart the sources of a block come to a node; disk grows with the nodes and the tasks.
    """
    n = graph.nodes.agg(F.count(F.lit(1)).alias("n"))
    sums = _over_sources(graph, "close", _come_to, ["r", "s"])
    return graph.nodes.select("id").join(sums, "id", "left").join(F.broadcast(n)).select("id", F.when(F.col("s") > 0, F.col("r") / (F.col("n") - 1) * F.col("r") / F.col("s")).otherwise(F.lit(0.0)).alias("score"))


def betweenness(graph: Graph) -> DataFrame:
    """(id, score): shares of shortest paths through a node, undirected, over (n - 1)(n - 2); 0 below three nodes.

    Work is the nodes times the links, by nature; disk and memory are not.
    """
    nodes = graph.nodes.count()
    scale = float((nodes - 1) * (nodes - 2)) if nodes > 2 else None
    total = _over_sources(graph, "between", _between, ["d"])
    return graph.nodes.select("id").join(total, "id", "left").select("id", (F.coalesce("d", F.lit(0.0)) / scale if scale else F.lit(0.0)).alias("score"))


def pagerank(graph: Graph, damping: float = 0.85, iterations: int = 20, teleport: str = "leaving") -> DataFrame:
    """(id, score): a fixed number of rounds from 1/n.

    teleport "leaving" (default): a node that leads to v sends d * r / outdegree, a sink d * r / n, and any other
    (1 - d) * r / n; ranks are then scaled to the sum 1. "textbook": (1 - d) / n for each node plus d times what
    arrives, sinks dealt out evenly. Weights are not used; outdegree counts parallel edges.
    """
    nodes = graph.nodes.select("id")
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    out = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    links = materialize(graph.edges.select("src", "dst").distinct() if teleport == "leaving" else graph.edges.select("src", "dst"), "rank-links")
    base = materialize(nodes.join(out, "id", "left").select("id", F.coalesce("out", F.lit(0)).alias("out")), "rank-nodes")
    rank = materialize(base.withColumn("r", F.lit(1.0 / n)), "ranks")
    for _ in range(iterations):
        come = rank.where("out > 0").join(links, rank.id == links.src).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") / F.col("out")).alias("flow"), F.sum("r").alias("near"))
        sums = rank.agg(F.sum(F.when(F.col("out") > 0, F.col("r")).otherwise(0.0)).alias("s"), F.sum(F.when(F.col("out") == 0, F.col("r")).otherwise(0.0)).alias("z"))
        joined = base.join(come, "id", "left").join(F.broadcast(sums))
        flow, near = F.coalesce("flow", F.lit(0.0)), F.coalesce("near", F.lit(0.0))
        if teleport == "leaving":
            value = damping * flow + damping * F.col("z") / n + (1 - damping) / n * (F.col("s") - near)
        else:
            value = (1 - damping) / n + damping * (flow + F.col("z") / n)
        raw = materialize(joined.select("id", "out", value.alias("r")), "ranks")
        rank = raw
        if teleport == "leaving":
            rank = raw.join(F.broadcast(raw.agg(F.sum("r").alias("total")))).select("id", "out", (F.col("r") / F.col("total")).alias("r"))
    return rank.select("id", F.col("r").alias("score"))
