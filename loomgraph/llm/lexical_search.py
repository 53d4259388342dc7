"""Ranked lexical search: MaxScore over shards of postings.

A first pass counts documents, terms and the documents of each query term. A second pass turns the documents of each
task into shards: for each query term its list of (document, score), and the largest score in the shard, the term's upper
bound. For each query, terms in ascending order of bounds are non-essential as long as their bounds together stay below
the lowest score that can still enter the task's best k: no document gets in by these alone. The other, essential lists
are added up; then the non-essential lists are probed, largest bound first, only for documents that the bounds still to
come can lift to that score. Each task sends at most k rows a query, which meet in two steps of top k.

Queries are taken in blocks of a bounded number of terms, so what is broadcast does not grow with the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.arrow_tools import slices, strings
from loomgraph.session import bounded_batches, materialize

#: Scores are whole numbers: weights in thousandths, and this many parts of a term's saturated count.
SCALE, WEIGHT_SCALE = 1_000_000_000, 1000
#: Length normalisation: LEAST % of it is fixed, SHARE % grows with the length; SATURATION thousandths of a count each.
LEAST, SHARE, SATURATION = 10, 90, 8
#: Bytes of terms, with 16 for each and with repeats over queries, that one block of queries holds (or a single query).
BLOCK_BYTES = 8 << 20
#: Bytes of text that make a shard.
SHARD_BYTES = 16 << 20
#: A query's best rows of all tasks meet in so many groups before the last step.
SALTS = 64

#: Every byte that is no ASCII letter or digit and below 0x80 ends a term; A-Z become a-z. Bytes from 0x80 on are kept.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The maximal stretches of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased."""
    return text.translate(_FOLDED).split()


class Queries:
    """A block of queries: their ids, the distinct terms of each as numbers, and the numbers of all terms."""

    def __init__(self, texts: dict[int, set[bytes]]):
        self.ids = sorted(texts)
        self.number = {t: k for k, t in enumerate(sorted(set().union(*texts.values())))}
        self.terms = [np.array(sorted(self.number[t] for t in texts[i]), np.int64) for i in self.ids]


def blocks(items: DataFrame, id_column: str, text_column: str, limit: int = BLOCK_BYTES) -> Iterator[Queries]:
    """The queries in blocks; rows of one id are one query."""
    held: dict[int, set[bytes]] = {}
    n = 0
    for r in items.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).where("i IS NOT NULL").orderBy("i").toLocalIterator():
        found = set(terms((r.t or "").encode()))
        size = sum(len(t) + 16 for t in found)
        if n + size > limit and held and r.i not in held:
            yield Queries(held)
            held, n = {}, 0
        held.setdefault(r.i, set()).update(found)
        n += size
    if held:
        yield Queries(held)


def _numbers(words: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))


_COUNTS = pa.schema([("term", pa.int64()), ("n", pa.int64())])
#: Terms that stand for the number of documents and of all their terms.
DOCUMENTS, ALL_TERMS = -1, -2


def _counted(queries) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = queries.value.number
        held = np.zeros(len(number), np.int64)
        documents = total = 0
        for part in slices(batches):
            for text in strings(part.column("text")):
                words = terms(text)
                documents += bool(words)
                total += len(words)
                held[[number[t] for t in number.keys() & set(words)]] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [DOCUMENTS, ALL_TERMS])), pa.array(np.append(held[at], [documents, total]))], schema=_COUNTS)

    return run


class Shard:
    """The postings of some documents: for each query term, in order of numbers, documents ascending, with their scores."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, found: list[np.ndarray], weights: np.ndarray, documents: int, total: int):
        self.ids = ids
        at = np.concatenate([np.full(len(x), k, np.int64) for k, x in enumerate(found)])
        key, tf = np.unique(np.concatenate(found) * len(ids) + at, return_counts=True)
        term, self.document = key // len(ids), key % len(ids)
        norm = LEAST + SHARE * lengths * documents // max(1, total)
        self.score = weights[term] * (SCALE * tf // (1000 * tf + SATURATION * norm[self.document]))
        self.first = np.searchsorted(term, np.arange(len(weights) + 1))
        self.bound = np.zeros(len(weights), np.int64)
        some = np.flatnonzero(np.diff(self.first))
        self.bound[some] = np.maximum.reduceat(self.score, self.first[some]) if len(some) else 0

    def best(self, query: np.ndarray, k: int, enter: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all documents of the best k of this shard that score `enter`, 1 or more, at least; ties all in."""
        query = query[self.bound[query] > 0]
        query = query[np.argsort(self.bound[query], kind="stable")]
        upto = np.cumsum(self.bound[query])
        essential = int(np.searchsorted(upto, enter, "left"))
        sums = np.zeros(len(self.ids), np.int64)
        for t in query[essential:].tolist():
            a, b = self.first[t], self.first[t + 1]
            sums[self.document[a:b]] += self.score[a:b]
        found = np.flatnonzero(sums)
        for j in range(essential - 1, -1, -1):
            enter = max(enter, _kth(sums[found], k))
            found = found[sums[found] + upto[j] >= enter]
            a, b = self.first[query[j]], self.first[query[j] + 1]
            place = np.minimum(np.searchsorted(self.document[a:b], found), b - a - 1) + a
            hit = self.document[place] == found
            sums[found[hit]] += self.score[place[hit]]
        found = found[sums[found] >= max(enter, _kth(sums[found], k))]
        return found, sums[found]


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th highest score; 1 where there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 1


class _Best:
    """The best k of a query so far: scores descending, equal ones by ascending id."""

    def __init__(self):
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[:k]
        self.ids, self.scores = ids[order], scores[order]


_HITS = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _searched(queries, weights, documents: int, total: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = queries.value, weights.value
        best = [_Best() for _ in block.ids]
        for shard in _shards(batches, block, weight, documents, total):
            for query, top in zip(block.terms, best, strict=True):
                at, scores = shard.best(query, k, int(top.scores[-1]) if len(top.scores) == k else 1)
                if len(at):
                    top.add(shard.ids[at], scores, k)
        sizes = [len(b.ids) for b in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block.ids, sizes)), pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.scores for b in best]))], schema=_HITS)

    return run


def _shards(batches: Iterator[pa.RecordBatch], block: Queries, weight: np.ndarray, documents: int, total: int) -> Iterator[Shard]:
    ids, lengths, found, size = [], [], [], 0
    for part in chain(slices(batches), [None]):
        if part is not None:
            for i, text in zip(part.column("doc_id").to_pylist(), strings(part.column("text")), strict=True):
                words = terms(text)
                numbers = _numbers(words, block.number)
                ids.append(i)
                lengths.append(len(words))
                found.append(numbers[numbers >= 0])
                size += len(text)
        if ids and (part is None or size >= SHARD_BYTES):
            yield Shard(np.array(ids, np.int64), np.array(lengths, np.int64), found, weight, documents, total)
            ids, lengths, found, size = [], [], [], 0


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each query the k documents of highest score above 0, ranked from 1.

    A query is all rows of items with one id; its distinct terms count once. Items without an id or terms give no rows.
    Documents without an id are no documents: they are neither counted nor found. Rows of one doc_id are documents of
    their own, so repeated rows are found as often as they are there. Null and empty texts count for nothing. Equal
    scores are ranked by ascending doc_id. An empty table on either side gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for n, block in enumerate(blocks(items, id_column, text_column)):
        found = _best_of_block(slim, block, k)
        out = materialize(found, "search") if not n else out.union(materialize(found, "search"))
    return out


def _best_of_block(slim: DataFrame, block: Queries, k: int) -> DataFrame:
    context = slim.sparkSession.sparkContext
    queries = context.broadcast(block)
    counts = {r.term: r.n for r in slim.select("text").mapInArrow(_counted(queries), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, total = counts.get(DOCUMENTS, 0), counts.get(ALL_TERMS, 0)
    weights = np.array([math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(block.number))], np.int64)
    hits = slim.mapInArrow(_searched(queries, context.broadcast(weights), documents, total, k), "item_id long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id")]
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
