"""Exact substring dedup over suffixes, by a difference-cover suffix sort.

All 200-byte strings of a text belong to anchors: the 64-byte window of least hash within them. Equal strings have equal
anchors at equal places, so the corpus is dealt out by anchors, and strings that share none are never compared. A run of
strings with one anchor is a stretch of a few hundred bytes. Anchors seen once (by two Bloom filters) end there; equal
stretches are repeats as a whole. What is left are stretches that share an anchor and differ somewhere. They are sorted
with the difference-cover algorithm, block by block: sort the triples at positions that are not 0 modulo 3, name them,
recurse on the names, sort and merge the remaining suffixes, and compare the prefixes of suffixes that are adjacent.
Anchors with very many different stretches are counted by digests of their 200-byte strings, which spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow_tools import BASE, mixed, slices, strings, text_bytes
from loomgraph.llm.jaccard_join import INVERSE, powers
from loomgraph.llm.seen_filters import ROWS, TwiceSeen, log2_bits, sketch_rows
from loomgraph.session import materialize

LENGTH, ANCHOR = 200, 64
PLACES = LENGTH - ANCHOR + 1
#: Bytes of a block that one suffix sort takes, and of a slice of texts.
BLOCK_BYTES, SLICE = 1 << 20, 2 << 20
#: An anchor with more different stretches than this is counted by digests.
MANY = 2000
#: Bytes for one anchor, for the filter's size only.
BYTES_PER_ANCHOR = 64


def stretches(column: pa.Array) -> tuple[np.ndarray, ...]:
    """For each run of strings with one anchor: row, first start in the text, number of starts, anchor's hash, its place.

    Starts of 200-byte strings are counted in the text's bytes; a text with fewer bytes has none.
    """
    data, offsets = text_bytes(column)
    n = len(data)
    starts = n - LENGTH + 1
    if starts < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n))])
    hashes = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * powers(INVERSE, n + 1)[: n - ANCHOR + 1], 7)
    del sums
    values = np.full(-(-len(hashes) // PLACES) * PLACES, np.iinfo(np.uint64).max, np.uint64)
    values[: len(hashes)] = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)
    rows = values.reshape(-1, PLACES)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:starts], ahead[PLACES - 1 : PLACES - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    del values, ahead, behind
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    inside = np.arange(starts) + LENGTH <= offsets[row + 1]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new & inside)
    count = np.diff(np.append(np.flatnonzero(new | ~inside), starts))[np.searchsorted(np.flatnonzero(new | ~inside), first)]
    return row[first], first - offsets[row[first]], count, hashes[anchor[first]], anchor[first] - first


def _sketch(log2: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketch_rows((stretches(part.column(0))[3].astype(np.uint64) for part in slices(batches, limit=SLICE)), log2)

    return run


STRETCHES = "anchor long, digest binary, doc_id long, start int, n int"
_STRETCHES = pa.schema([("anchor", pa.int64()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def place_hash(doc_id: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mixed(mixed(doc_id.astype(np.uint64), 3) + start.astype(np.uint64), 5)


def _emitted(keep: Callable, with_bytes: bool) -> Callable:
    """The stretches that `keep` (of anchor hashes, ids and starts) holds, as digests or with their bytes."""
    schema = pa.schema([*_STRETCHES, ("bytes", pa.binary())]) if with_bytes else _STRETCHES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            part = part.filter(part.column("doc_id").is_valid())
            if not part.num_rows:
                continue
            row, start, n, anchor, place = stretches(part.column("text"))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            on = np.flatnonzero(keep(anchor.astype(np.uint64), ids[row], start)) if len(row) else row
            row, start, n, anchor, place = (x[on] for x in (row, start, n, anchor, place))
            texts = strings(part.column("text"))
            pieces = [texts[r][s : s + m - 1 + LENGTH] for r, s, m in zip(row.tolist(), start.tolist(), n.tolist(), strict=True)]
            digests = [hashlib.blake2b(p, digest_size=16, salt=b"%d" % q).digest() for p, q in zip(pieces, place.tolist(), strict=True)]
            columns = [anchor.astype(np.uint64).view(np.int64), digests, ids[row], start, n, *([pieces] if with_bytes else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


class _SeenAnchor:
    def __init__(self, test: Callable):
        self.test = test

    def __call__(self, anchor: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        return self.test(anchor)


class _WantedPlace:
    def __init__(self, test: Callable):
        self.test = test

    def __call__(self, anchor: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        return self.test(place_hash(ids, start))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes; symbols are positive integers below 2**21.

    Difference cover modulo 3: triples at positions 1 and 2 modulo 3 are sorted and named; where names are not unique,
    the string of names is sorted in the same way; then positions 0 modulo 3 are sorted by their first symbol and the
    rank after it, and merged.
    """
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda k: symbols[k:].tolist()), np.int64)
    s = np.concatenate([symbols.astype(np.uint64), np.zeros(3, np.uint64)])
    cover = np.flatnonzero(np.arange(n) % 3)
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    keys = s[cover] << np.uint64(42) | s[cover + 1] << np.uint64(21) | s[cover + 2]
    order = np.argsort(keys, kind="stable")
    names = np.empty(len(cover), np.int64)
    names[order] = np.cumsum(np.concatenate([[1], np.diff(keys[order]) != 0]))
    rank = np.zeros(n + 3, np.int64)
    rank[cover] = names
    if names.max() < len(cover):
        reduced = np.concatenate([rank[one], [0], rank[two]]) + 1
        inner = suffix_array(reduced)
        at = np.concatenate([one, [-1], two])[inner]
        sorted_cover = at[at >= 0]
        rank[sorted_cover] = np.arange(1, len(cover) + 1)
    else:
        sorted_cover = cover[order]
    zero = np.arange(0, n, 3)
    first = s[zero] << np.uint64(32) | rank[zero + 1].astype(np.uint64)
    zero = zero[np.argsort(first, kind="stable")]
    ranks = rank.astype(np.uint64)
    by_one = sorted_cover[sorted_cover % 3 == 1]
    by_two = sorted_cover[sorted_cover % 3 == 2]
    less = np.searchsorted(s[by_one] << np.uint64(32) | ranks[by_one + 1], s[zero] << np.uint64(32) | ranks[zero + 1])
    pair = lambda k: s[k] << np.uint64(42) | s[k + 1] << np.uint64(21) | ranks[k + 2]
    less += np.searchsorted(pair(by_two), pair(zero))
    out, placed = np.empty(n, np.int64), np.zeros(n, bool)
    at = np.arange(len(zero)) + less
    out[at] = zero
    placed[at] = True
    out[~placed] = sorted_cover
    return out


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each byte string, which of its starts begin a string of `length` that begins elsewhere among them too."""
    joined = np.concatenate([np.concatenate([np.frombuffer(p, np.uint8).astype(np.uint16) + 1, [0]]) for p in pieces]).astype(np.int64)
    sizes = np.array([len(p) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    left = np.concatenate([np.arange(m, -1, -1) for m in sizes])
    order = suffix_array(joined + 1)
    order = order[left[order] >= length]
    view = np.lib.stride_tricks.sliding_window_view(joined.astype(np.int16), length) if len(joined) >= length else None
    flags = np.zeros(len(joined), bool)
    for k in range(0, len(order) - 1, 8192):
        a, b = order[k : k + 8192], order[k + 1 : k + 8193]
        a = a[: len(b)]
        same = np.flatnonzero((joined[a] == joined[b]) & (joined[a + length - 1] == joined[b + length - 1]))
        same = same[(view[a[same]] == view[b[same]]).all(axis=1)]
        flags[a[same]] = True
        flags[b[same]] = True
    return [flags[s : s + max(0, m - length + 1)] for s, m in zip(starts.tolist(), sizes.tolist(), strict=True)]


SPANS = "doc_id long, start int, n int"
_SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts that repeat, of stretches in the order of their anchors; only of those seen once as a whole."""
    held: list[tuple] = []
    size = 0

    def done() -> pa.RecordBatch:
        rows: tuple[list, list, list] = ([], [], [])
        for (_, _, doc_id, start, single), flags in zip(held, repeated_starts([h[1] for h in held]), strict=True):
            if single:
                a, n = _runs(flags)
                rows[0].extend([doc_id] * len(a))
                rows[1].extend((a + start).tolist())
                rows[2].extend(n.tolist())
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, _SPANS, strict=True)], schema=_SPANS)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "bytes", "doc_id", "start", "single")), strict=True):
            if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                yield done()
                held, size = [], 0
            held.append(row)
            size += len(row[1]) + 1
    if held:
        yield done()


def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("window", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int32()), ("single", pa.bool_())])
    for batch in batches:
        rows: tuple[list, list, list, list] = ([], [], [], [])
        for data, doc_id, start, single in zip(*(batch.column(c).to_pylist() for c in ("bytes", "doc_id", "start", "single")), strict=True):
            for k in range(len(data) - LENGTH + 1):
                rows[0].append(hashlib.blake2b(data[k : k + LENGTH], digest_size=16).digest())
                rows[1].append(doc_id)
                rows[2].append(start + k)
                rows[3].append(single)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)


def _places_sketch(log2: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place_hash(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
            yield from sketch_rows((at, at), log2)

    return run


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n): runs of starts in a text's bytes at which a 200-byte string begins that begins elsewhere too."""
    slim = docs.select("doc_id", "text")
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log2 = log2_bits(size // BYTES_PER_ANCHOR, 12)
    seen = TwiceSeen(slim.where("doc_id IS NOT NULL").select("text").mapInArrow(_sketch(log2), ROWS), log2)
    rows = materialize(slim.mapInArrow(_emitted(_SeenAnchor(seen.test()), False), STRETCHES), "anchored-stretches")
    kinds = rows.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "start")).alias("at"))
    kinds = materialize(kinds.select("anchor", "digest", "c", "at.doc_id", "at.start"), "stretch-kinds")
    whole = rows.join(kinds.where("c > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select("doc_id", "start", "n")

    groups = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("c").alias("least")).where("kinds > 1 AND least = 1")
    open_ = kinds.join(groups.select("anchor", "kinds"), "anchor").select("digest", "doc_id", "start", (F.col("c") == 1).alias("single"), "kinds")
    open_ = materialize(open_, "open-stretches")
    log2 = log2_bits(open_.count(), 16)
    wanted = TwiceSeen(open_.select("doc_id", "start").mapInArrow(_places_sketch(log2), ROWS), log2)
    found = slim.mapInArrow(_emitted(_WantedPlace(wanted.test()), True), STRETCHES + ", bytes binary").select("anchor", "digest", "doc_id", "start", "bytes")
    found = materialize(found.join(open_, ["digest", "doc_id", "start"]).select("anchor", "bytes", "doc_id", "start", "single", "kinds"), "open-bytes")
    few = found.where(F.col("kinds") <= MANY).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_blocks, SPANS)
    windows = found.where(F.col("kinds") > MANY).mapInArrow(_window_digests, "window binary, doc_id long, start int, single boolean")
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("c"), F.collect_list(F.when(F.col("single"), F.struct("doc_id", "start"))).alias("at")).where("c > 1")
    many = twice.select(F.explode("at").alias("at")).select("at.doc_id", "at.start", F.lit(1).alias("n"))
    return whole.unionByName(few).unionByName(many)


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(text: bytes, spans: list) -> tuple[bytes, int, int]:
    """What stays of a text, the bytes that go and the runs that they form."""
    if not spans:
        return text, 0, 0
    change = np.zeros(len(text) + 1, np.int32)
    at = np.array([(s["start"], min(len(text), s["start"] + s["n"] - 1 + LENGTH)) for s in spans], np.int64)
    at = at[at[:, 0] < len(text)]
    np.add.at(change, at[:, 0], 1)
    np.add.at(change, at[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), len(_runs(gone)[0])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for part in slices(batches):
        rows = []
        for text, spans in zip(strings(part.column("text")), part.column("spans").to_pylist(), strict=True):
            kept, removed, runs = _cut(text, spans or [])
            rows.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[k] for r in rows], schema[k + 1].type) for k in range(4))], schema=schema)


def substring_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a 200-byte string that also begins elsewhere (in any text, the same included) covers it. Null
    texts are empty. Repeated rows repeat each other's strings. Rows without an id lose nothing and repeat nothing; an
    empty table gives an empty one; other columns are ignored.
    """
    spans = repeated_spans(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return docs.select("doc_id", "text").join(spans, "doc_id", "left").mapInArrow(_report, REPORT)
