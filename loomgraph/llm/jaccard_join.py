"""Similarity join of documents by the Jaccard likeness of their word shingles, with several global token orders.

Under any one order of all shingles, two sets of likeness t share one of their first n - ceil(t * n) + 1 shingles. So a
pair has to share a prefix shingle under each of several orders. The first order's prefixes meet in a shuffle (of those
shingles only that a Bloom filter of twice-seen ones holds); the pairs they propose are filtered by sizes and positions,
then by the prefixes under the other orders, and what all filters leave is verified on the whole sets. Orders put
frequent shingles last, by a count sketch of fixed size, so that common passages propose few pairs.

Only components are asked for, so equal sets are one class, and a bucket (of one shingle) is not expanded into its pairs:
each member is compared with a few hubs of its bucket, then with a few hubs of each other component in it, and at last
members of different components with each other. The work of the last step is what no component can settle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow_tools import BASE, mixed, slices, text_bytes
from loomgraph.llm.seen_filters import ROWS, TwiceSeen, log2_bits, sketch_rows
from loomgraph.operators.components import component_labels
from loomgraph.session import bounded_batches, materialize, remove, written

WORDS = 5
#: The likeness as a fraction.
NUMERATOR, DENOMINATOR = 3, 4
#: Counters of the frequency sketch, whatever the corpus, and those of one of its segments.
COUNTERS, SEGMENT = 1 << 20, 1 << 16
#: Bytes of text that are hashed at a time; longer texts go window by window.
WINDOW = 1 << 18
#: The arrays of the documents with most partners are broadcast: at most so many bytes in all, and so many for one document (prefixes, sets).
SENT_BYTES, SENT_PREFIXES, SENT_SET = 32 << 20, 4 << 10, 16 << 10
#: Partners from which on a document's arrays may be broadcast.
PARTNERS = 4
#: Hubs of a bucket: of those members whose ids hash to a slot, the smallest id.
HUBS = 4

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
INVERSE = pow(BASE, -1, 2**64)
#: Odd multipliers for a word's place in its shingle, without a pattern that permuted words could cancel.
PLACE = [np.uint64(x) for x in (mixed(np.arange(1, WORDS + 1, dtype=np.uint64), 97) | np.uint64(1)).tolist()]

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in lower-cased texts that lie between the offsets, and a polynomial of each word's bytes."""
    blank = np.concatenate([SPACE[data], [True]])
    begins = ~blank[:-1]
    if len(data) > 1:
        inner = blank[:-2].copy()
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        inner[cuts - 1] = True
        begins[1:] &= inner
    start = np.flatnonzero(begins)
    # A word ends at white space or at its text's end.
    stops = np.sort(np.concatenate([np.flatnonzero(blank), offsets[1:]]))
    end = stops[np.searchsorted(stops, start, "right")] if len(start) else start
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)))])
    return start, end, (sums[end] - sums[start]) * powers(INVERSE, len(data) + 1)[start]


def _long_words(data: np.ndarray) -> np.ndarray:
    """The hashes of a long text's words. A word that a window cuts is carried on: P(uv) = P(u) + BASE**|u| * P(v)."""
    found, value, length = [], 0, 0
    for at in range(0, len(data), WINDOW):
        piece = LOWER[data[at : at + WINDOW]]
        start, end, sums = _runs(piece, np.array([0, len(piece)]))
        lengths = (end - start).astype(np.uint64)
        if length:
            if len(start) and start[0] == 0:
                sums[0] = np.uint64((value + pow(BASE, length, 2**64) * int(sums[0])) % 2**64)
                lengths[0] += np.uint64(length)
            else:
                sums, lengths = np.append(np.uint64(value), sums), np.append(np.uint64(length), lengths)
            value = length = 0
        if len(end) and end[-1] == len(piece):
            value, length = int(sums[-1]), int(lengths[-1])
            sums, lengths = sums[:-1], lengths[:-1]
        found.append(mixed(sums + lengths))
    if length:
        found.append(mixed(np.array([(value + length) % 2**64], np.uint64)))
    return np.concatenate(found)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; fewer words than a shingle has are one as a whole."""
    data, offsets = text_bytes(column)
    if len(column) == 1 and len(data) > WINDOW:
        hashes = _long_words(data)
        first = np.array([0, len(hashes)])
    else:
        start, end, sums = _runs(LOWER[data], offsets)
        hashes = mixed(sums + (end - start).astype(np.uint64))
        first = np.searchsorted(start, offsets)
    n = len(hashes)
    whole = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        whole += hashes[k : n - words + 1 + k] * PLACE[k % WORDS] + np.uint64(k // WORDS)
    whole = mixed(whole, words)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(whole[a : b - words + 1])
        elif b > a:
            few = hashes[a:b] * np.array(PLACE[: b - a])
            yield mixed(few.sum(keepdims=True, dtype=np.uint64), b - a)
        else:
            yield np.zeros(0, np.uint64)


def prefix_length(n: int) -> int:
    """Shingles of which a set of n has to share one with any set of that likeness."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


class Orders:
    """Global orders of all shingles: rare ones first by the sketch's levels, then by a hash that differs for each order."""

    def __init__(self, levels):
        self.levels = levels

    def keys(self, hashes: np.ndarray, order: int) -> np.ndarray:
        level = self.levels.value[hashes & np.uint64(COUNTERS - 1)].astype(np.uint64)
        return level << np.uint64(58) | mixed(hashes, order) >> np.uint64(6)

    def prefix(self, hashes: np.ndarray, order: int, keys: np.ndarray | None = None) -> np.ndarray:
        """The prefix under an order, in that order; keys: those of the hashes, where they are known."""
        if not len(hashes):
            return hashes
        keys, p = self.keys(hashes, order) if keys is None else keys, prefix_length(len(hashes))
        at = np.argpartition(keys, p - 1)[:p]
        return hashes[at[np.argsort(keys[at])]]


CLASSES = "doc_id long, n_shingles long, digest binary, segment int, counts binary"
_CLASSES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("segment", pa.int32()), ("counts", pa.binary())])


def _classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, with the digest of its set, and at the end the task's counters in segments."""
    counters = np.zeros(COUNTERS, np.int64)
    for part in slices(batches, limit=WINDOW):
        ids, sizes, digests, held = part.column("doc_id").to_pylist(), [], [], []
        for doc_id, own in zip(ids, shingle_sets(part.column("text")), strict=True):
            sizes.append(len(own))
            digests.append(hashlib.blake2b(own.tobytes() if len(own) else b"no words %r" % doc_id, digest_size=16).digest())
            held.append(own)
        counters += np.bincount((np.concatenate(held) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        none = [None] * len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, sizes, digests, none, none), _CLASSES, strict=True)], schema=_CLASSES)
    for k in np.flatnonzero(counters.reshape(-1, SEGMENT).any(axis=1)).tolist():
        packed = zlib.compress(counters[k * SEGMENT : (k + 1) * SEGMENT].astype(np.int32).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, None, None, k, packed), _CLASSES, strict=True)], schema=_CLASSES)


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SEGMENT, np.int64)
    for x in rows["counts"]:
        total += np.frombuffer(zlib.decompress(x), np.int32)
    return pd.DataFrame({"segment": rows["segment"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})


def frequency_levels(rows: DataFrame) -> np.ndarray:
    """A level for each counter: 0 where it is near the mean, and one more for each doubling beyond."""
    counts = np.zeros(COUNTERS)
    for r in rows.groupBy("segment").applyInPandas(_added, "segment int, counts binary").toLocalIterator():
        counts[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
    usual = 4 * counts.mean() + 32
    return np.clip(np.ceil(np.log2(np.maximum(counts, 1) / usual)), 0, 31).astype(np.uint8)


PREFIXES = "part string, rep long, n int, first binary, second binary, third binary"
FIRST, OTHERS = "rep long, n int, first binary", "rep long, n int, second binary, third binary"
_PREFIXES = pa.schema([("part", pa.string()), ("rep", pa.int64()), ("n", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("third", pa.binary())])


def chosen_rows(part: pa.RecordBatch, chosen: Callable, column: str = "doc_id") -> pa.RecordBatch:
    """The rows whose id the filter holds."""
    ids = part.column(column)
    keep = chosen(mixed(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64))) & np.asarray(ids.is_valid())
    return part.filter(pa.array(keep))


def _prefixes(orders: Orders, chosen: Callable) -> Callable:
    """Two rows for each class's document: its first prefix in order, and 16 bits of each shingle of the other two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches, limit=WINDOW):
            part = chosen_rows(whole, chosen)
            sets = list(shingle_sets(part.column("text"))) if part.num_rows else []
            ids = [i for i, s in zip(part.column("doc_id").to_pylist(), sets, strict=True) if len(s)]
            sets = [s for s in sets if len(s)]
            if not sets:
                continue
            flat = np.concatenate(sets)
            keys = [orders.keys(flat, k) for k in (1, 2, 3)]
            firsts, shorts, a = [], ([], []), 0
            for s in sets:
                b = a + len(s)
                firsts.append(orders.prefix(s, 1, keys[0][a:b]).tobytes())
                for k, short in enumerate(shorts, 1):
                    short.append(np.sort((orders.prefix(s, k + 1, keys[k][a:b]) >> np.uint64(48)).astype(np.uint16)).tobytes())
                a = b
            sizes, none = [len(s) for s in sets], [None] * len(sets)
            for columns in ((["first"] * len(sets), ids, sizes, firsts, none, none), (["others"] * len(sets), ids, sizes, none, *shorts)):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _PREFIXES, strict=True)], schema=_PREFIXES)

    return run


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes in a column of packed arrays, end to end, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint64, (at[-1] - at[0]) // 8, at[0]), np.diff(at) // 8


def _prefix_sketch(log2: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketch_rows((_hashes(batch.column(0))[0] for batch in batches if batch.num_rows), log2)

    return run


ROW = "token long, rep long, n int, pos int, band int"
_ROW = pa.schema([("token", pa.int64()), ("rep", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("band", pa.int32())])


def _prefix_rows(seen: Callable) -> Callable:
    """A row for each shingle of a first prefix that some other prefix may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                flat, lengths = _hashes(batch.column("first"))
                at = np.flatnonzero(seen(flat))
                doc = np.repeat(np.arange(batch.num_rows), lengths)[at]
                pos = at - (np.cumsum(lengths) - lengths)[doc] + 1
                rep, n = (batch.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("rep", "n"))
                band = np.floor(np.log(np.maximum(n, 1)) / np.log(DENOMINATOR / NUMERATOR))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((flat[at].view(np.int64), rep, n, pos.astype(np.int32), band.astype(np.int32)), _ROW, strict=True)], schema=_ROW)

    return run


def _held(chosen: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield chosen_rows(batch, chosen, "rep")

    return run


def _sets(chosen: Callable) -> Callable:
    schema = pa.schema([("rep", pa.int64()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches, limit=WINDOW):
            part = chosen_rows(whole, chosen)
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"))], pa.binary())], schema=schema)

    return run


def _member_sketch(log2: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = mixed(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64))
            yield from sketch_rows((ids, ids), log2)

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements of b that a holds; both are sorted."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def _share_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose prefixes leave the likeness possible under both other orders.

    What two sets share lies in both prefixes, or beyond the prefix that ends first in that order. So they share at most
    what their prefixes share and the rest of one of them. Of each shingle 16 bits are compared, so the count of what is
    shared may be too high, never too low.
    """
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        n, m = (batch.column(c).to_pylist() for c in ("n_a", "n_b"))
        for name in ("second", "third"):
            for k, (x, y) in enumerate(zip(batch.column(f"{name}_a").to_pylist(), batch.column(f"{name}_b").to_pylist(), strict=True)):
                if keep[k]:
                    shared = _common(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16))
                    rest = max(n[k] - prefix_length(n[k]), m[k] - prefix_length(m[k]))
                    keep[k] = shared > 0 and (NUMERATOR + DENOMINATOR) * (shared + rest) >= NUMERATOR * (n[k] + m[k])
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            shared = _common(p, q)
            keep.append(DENOMINATOR * shared >= NUMERATOR * (len(p) + len(q) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def ids_filter(ids: DataFrame) -> TwiceSeen:
    """A Bloom filter of the distinct ids of one column."""
    log2 = log2_bits(ids.count(), 16)
    return TwiceSeen(ids.mapInArrow(_member_sketch(log2), ROWS), log2)


def members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()


def with_arrays(pairs: DataFrame, held: DataFrame, each: int) -> DataFrame:
    """The pairs with the arrays of both documents. held: (rep, and arrays in the other columns); each: most bytes of one to be broadcast.

    The documents with most partners are broadcast, as many as fit the bound, so their partners' arrays move once; in other
    pairs one side's arrays travel with the pair.
    """
    names = held.columns[1:]

    def side(table: DataFrame, x: str) -> DataFrame:
        return table.select(F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in names))

    degrees = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("m"))
    most = degrees.where(F.col("m") >= PARTNERS).orderBy(F.desc("m"), "rep").limit(SENT_BYTES // each).select("rep")
    size = sum((F.octet_length(c) for c, kind in held.dtypes if kind == "binary"), F.lit(0))
    # A document that has several rows (of a repeated id) goes the other way, so that the bound holds.
    few = held.join(F.broadcast(most), "rep").withColumn("bytes", size).groupBy("rep").agg(F.count(F.lit(1)).alias("k"), F.max("bytes").alias("bytes"), *(F.first(c).alias(c) for c in names))
    sent = materialize(few.where((F.col("k") == 1) & (F.col("bytes") <= each)).select("rep", *names), "sent-arrays")
    ids = sent.select("rep")
    flagged = pairs.join(F.broadcast(ids.withColumnRenamed("rep", "b").withColumn("sent_b", F.lit(True))), "b", "left").join(F.broadcast(ids.withColumnRenamed("rep", "a").withColumn("sent_a", F.lit(True))), "a", "left")
    to_sent = flagged.where("sent_b OR sent_a").select(F.when(F.col("sent_b"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("sent_b"), F.col("b")).otherwise(F.col("a")).alias("b"))
    others = flagged.where("sent_a IS NULL AND sent_b IS NULL").select("a", "b")
    near = to_sent.join(side(held, "a"), "a").join(F.broadcast(side(sent, "b")), "b")
    return near.unionByName(others.join(side(held, "a"), "a").join(side(held, "b"), "b"))


def verified(pairs: DataFrame, others: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that share prefixes under the other orders and then are alike on their whole sets.

    Prefixes, and then sets, are read for the documents of the pairs only.
    """
    near = others.mapInArrow(_held(ids_filter(members(pairs)).test()), OTHERS)
    left = materialize(with_arrays(pairs, near, SENT_PREFIXES).mapInArrow(_share_prefixes, "a long, b long").distinct(), "filtered-pairs")
    sets = docs.mapInArrow(_sets(ids_filter(members(left)).test()), "rep long, hashes binary")
    return materialize(with_arrays(left, sets, SENT_SET).mapInArrow(_alike, "a long, b long").distinct(), "links")


def _possible(x: str, y: str):
    """Sizes and positions of a shared prefix shingle that leave the likeness possible (of a pair's first shared one)."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    rest = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos")) + 1
    total = NUMERATOR + DENOMINATOR
    return (NUMERATOR * F.greatest(n, m) <= DENOMINATOR * F.least(n, m)) & (rest * total >= NUMERATOR * (n + m))


def _met(x: DataFrame, y: DataFrame, condition) -> DataFrame:
    """The pairs of different documents in a bucket that sizes, positions and the condition leave."""
    rows = x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.rep") != F.col("y.rep")) & condition & _possible("x", "y"))
    return rows.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _hubs(rows: DataFrame, *keys: str) -> DataFrame:
    """For each bucket, range of sizes and slot (and component) the member of the smallest id; m: members that share it."""
    slotted = rows.withColumn("slot", F.pmod(F.xxhash64("rep"), F.lit(HUBS)).cast("int"))
    found = slotted.groupBy("token", "band", "slot", *keys).agg(F.min(F.struct("rep", "n", "pos")).alias("hub"), F.count(F.lit(1)).alias("m"))
    return found.select("token", "band", "slot", *keys, "hub.*", "m")


def _between_components(rest: DataFrame, labels: DataFrame, by_hubs: bool) -> DataFrame | None:
    """Pairs of members whose components differ: with hubs of the other components, or all that are left. None: no bucket has two."""
    known = rest.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = known.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    known = materialize(known.join(several, "token", "left_semi"), "open-prefix-rows")
    if known.isEmpty():
        return None
    apart = F.col("x.component") != F.col("y.component")
    if by_hubs:
        return _met(known, _hubs(known, "component"), apart)
    # A bucket's largest component does not meet itself: smaller ones meet it and each other.
    sizes = known.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("m", "component")).alias("most")).select("token", F.col("most.component").alias("largest"))
    minor = known.join(largest, "token").where("component <> largest").drop("largest")
    return _met(minor, known, apart)


def link_components(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links of likeness 0.75 or more).

    Words are the runs of bytes other than ASCII white space, ASCII lower case. Null and empty texts have no shingle
    and are linked with nothing. Equal sets are linked. Rows of one id are one document, linked where any of them is.
    A row without an id links with nothing and has no component. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select("doc_id", "text")
    first = materialize(slim.mapInArrow(_classes, CLASSES), "shingle-classes")
    orders = Orders(spark.sparkContext.broadcast(frequency_levels(first.where("segment IS NOT NULL").select("segment", "counts"))))
    classes = first.where("segment IS NULL").select("doc_id", "n_shingles", "digest")
    reps = classes.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    placed = materialize(classes.join(reps, "digest").select("doc_id", "n_shingles", "rep"), "placed-rows")

    prefixes = written(slim.mapInArrow(_prefixes(orders, ids_filter(placed.where("rep IS NOT NULL").select("rep").distinct()).test()), PREFIXES), "prefixes", "part")
    table = spark.read.schema(PREFIXES).parquet(prefixes)
    firsts = table.where("part = 'first'").select("rep", "n", "first")
    log2 = log2_bits((firsts.agg(F.sum(F.octet_length("first"))).first()[0] or 0) // 8, 8)
    seen = TwiceSeen(firsts.select("first").mapInArrow(_prefix_sketch(log2), ROWS), log2)
    rows = materialize(firsts.mapInArrow(_prefix_rows(seen.test()), ROW), "prefix-rows")
    remove(spark, f"{prefixes}/part=first")
    others = spark.read.schema(PREFIXES).parquet(prefixes).where("part = 'others'").select("rep", "n", "second", "third")

    hubs = materialize(_hubs(rows), "hubs")
    near = F.abs(F.col("x.band") - F.col("y.band")) <= 1
    tried = materialize(_met(rows, hubs, near), "hub-pairs")
    # Documents whose rows have different sets hold these together.
    split = placed.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("doc_id")
    links = verified(tried, others, slim).union(placed.join(split, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    labels = component_labels(links, "a", "b")

    crowded = hubs.where("m > 1").select("token", "band", "slot", F.col("rep").alias("hub"))
    slotted = rows.withColumn("slot", F.pmod(F.xxhash64("rep"), F.lit(HUBS)).cast("int"))
    rest = materialize(slotted.join(crowded, ["token", "band", "slot"]).where("rep <> hub").drop("slot", "hub"), "rest-rows")
    for by_hubs in (True, False):
        pairs = _between_components(rest, labels, by_hubs)
        if pairs is None:
            break
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "open-pairs")
        tried, links = tried.union(pairs), links.union(verified(pairs, others, slim))
        labels = component_labels(links, "a", "b")

    named = placed.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that have the smallest id of their component, with all their columns; rows without an id stay.

    All rows of a kept id stay. Empty and null texts are linked with nothing, so they stay. An empty table gives an empty one.
    """
    kept = link_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").union(docs.where("doc_id IS NULL"))
