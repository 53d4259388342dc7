"""Periodic runs of words by divide and conquer.

Each text's words are interned as ids. A run of at least three periods that lies in a node of the recursion and crosses
its midpoint is seen in the Z-values at that midpoint: how far the words from the midpoint on (and those before it,
backwards) agree with the words a period away. All nodes of a level of all texts of a slice are worked on at once, so a
level is a few passes over arrays. The first words are compared one by one; only where that many agree are the exact
Z-values taken, by names of the blocks of 1, 2, 4, ... words (equal blocks, equal names), which keeps a text of one
repeated word at n log n. What is found is extended over the node's ends by the same names, deduplicated by interval,
and keeps its smallest period. Rows never leave their task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.arrow_tools import slices, strings
from loomgraph.session import bounded_batches

MIN_LENGTH, MIN_PERIODS = 24, 3
#: Words compared one by one before exact Z-values are taken; at most half of what a run's equal pairs must span.
FIRST = 8
#: Periods (of all nodes of a level) that are looked at in one step.
PART = 1 << 19


class _Intern(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def interned(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The word ids of all texts in one array, and where each text starts (with the end)."""
    ids = _Intern()
    starts = np.concatenate([[0], np.cumsum([len(w) for w in texts], dtype=np.int64)])
    return np.fromiter(map(ids.__getitem__, chain.from_iterable(texts)), np.int32, int(starts[-1])), starts


class Blocks:
    """Exact lengths of common prefixes and suffixes within texts, by names of blocks of powers of two of words.

    names[k][i] is the name of the 2**k words from i on; blocks that pass the end of a text have a name of their own.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.n = len(words)
        self.names = [words]
        room, size = np.repeat(starts[1:], np.diff(starts)) - np.arange(self.n), 1
        while size * 2 <= (int(room.max()) if self.n else 0):
            last = self.names[-1]
            fits = np.flatnonzero(room >= size * 2)
            key = last[fits].astype(np.int64) * (int(last.max()) + 1) + last[fits + size]
            _, name = np.unique(key, return_inverse=True)
            out = np.full(self.n, -1, np.int32)
            out[fits] = name
            self.names.append(out)
            size *= 2

    def forward(self, a: np.ndarray, b: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
        """For a < b: how many words from a and from b on agree, b not going beyond ceiling, the end of the text."""
        a, b, first = a.copy(), b.copy(), b
        for k in range(len(self.names) - 1, -1, -1):
            size = 1 << k
            at = np.flatnonzero(b + size <= ceiling)
            hit = at[self.names[k][a[at]] == self.names[k][b[at]]]
            a[hit] += size
            b[hit] += size
        return b - first

    def backward(self, a: np.ndarray, b: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """For a < b: how many words before a and before b agree, not going below floor, the start of the text."""
        a, b, first = a.copy(), b.copy(), a
        for k in range(len(self.names) - 1, -1, -1):
            size = 1 << k
            at = np.flatnonzero(a - size >= floor)
            hit = at[self.names[k][a[at] - size] == self.names[k][b[at] - size]]
            a[hit] -= size
            b[hit] -= size
        return first - a


def _far_enough(words: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which pairs a < b agree over FIRST words onwards, or over FIRST words backwards, within low and high."""
    good = np.zeros(len(a), bool)
    left = np.flatnonzero(b + FIRST <= high)
    for step in range(FIRST):
        left = left[words[a[left] + step] == words[b[left] + step]]
    good[left] = True
    left = np.flatnonzero(~good & (a - FIRST >= low))
    for step in range(1, FIRST + 1):
        left = left[words[a[left] - step] == words[b[left] - step]]
    good[left] = True
    return good


def crossing(words: np.ndarray, starts: np.ndarray, min_length: int, min_periods: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, period): places at the midpoints of all levels where a run of that period may cross, PART periods at a time."""
    wide = np.flatnonzero(np.diff(starts) >= min_length)
    low, high = starts[wide], starts[wide + 1]
    text_low, text_high = low, high
    while len(low):
        mid = (low + high) // 2
        reach = np.concatenate([[0], np.cumsum((high - low) // min_periods)])
        for first in range(0, int(reach[-1]), PART):
            # One entry for each period of each node; the run's equal pairs lie around the midpoint or a period before it.
            entry = np.arange(first, min(first + PART, int(reach[-1])))
            node = np.searchsorted(reach, entry, "right") - 1
            period = entry - reach[node] + 1
            at, lo, hi = mid[node], text_low[node], text_high[node]
            for a in (at, at - period):
                b = a + period
                same = np.flatnonzero((words[a] == words[np.minimum(b, len(words) - 1)]) | (words[a - 1] == words[b - 1]))
                same = same[_far_enough(words, a[same], b[same], lo[same], hi[same])]
                if len(same):
                    yield a[same], period[same]
        low, high = np.concatenate([low, mid]), np.concatenate([mid, high])
        text_low, text_high = np.tile(text_low, 2), np.tile(text_high, 2)
        deep = high - low >= min_length
        low, high, text_low, text_high = low[deep], high[deep], text_low[deep], text_high[deep]


def _extended(words: np.ndarray, starts: np.ndarray, a: np.ndarray, q: np.ndarray, min_length: int, min_periods: int) -> np.ndarray:
    """The distinct runs (text, start, length, period) at these places, each with its smallest period among these."""
    text = np.searchsorted(starts, a, "right") - 1
    chosen, text = np.unique(text, return_inverse=True)
    size = starts[chosen + 1] - starts[chosen]
    new = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(new[-1]) - np.repeat(new[:-1], size) + np.repeat(starts[chosen], size)
    blocks = Blocks(words[take], new)  # names only for texts in which something was found
    a = a - starts[chosen][text] + new[text]
    begin = a - blocks.backward(a, a + q, new[text])
    end = a + q + blocks.forward(a, a + q, new[text + 1])
    long_enough = end - begin >= np.maximum(min_length, min_periods * q)
    return _smallest_periods(np.stack([chosen[text], begin - new[text], end - begin, q], 1)[long_enough])


def _smallest_periods(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    return rows[first]


def runs(words: np.ndarray, starts: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """All runs of all texts: rows (text, start in the text, length, smallest period), by text, start and period.

    A run is a stretch of at least min_length words and min_periods periods, 3 or more, that no neighbouring word extends.
    """
    if min_periods < 3 or min_length < 3 * FIRST:
        raise ValueError("runs have at least 3 periods and 24 words")
    rows, held, n = np.zeros((0, 4), np.int64), [], 0
    for a, q in chain(crossing(words, starts, min_length, min_periods), [(None, None)]):
        if a is not None:
            held.append((a, q))
            n += len(a)
        if held and (a is None or n >= 4 * PART):
            a, q = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = _smallest_periods(np.concatenate([rows, _extended(words, starts, a, q, min_length, min_periods)]))
            held, n = [], 0
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run (start, length, period) contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def most_periodic(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run (start, length, period) of greatest length / period, exactly; ties: smallest start, then period."""
    best = None
    for start, length, period in found.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def repeated_tail(doc_id: int, words: list[bytes]) -> list[bytes]:
    """The words of the query's test: one id in ten repeats some of its words to its end, as its checksum says."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
FOUND = "doc_id long, start long, length long, period long, words string"
_REPORT = pa.schema([(c, pa.string() if c.endswith("256") else pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")])
_FOUND = pa.schema([(c, pa.string() if c == "words" else pa.int64()) for c in ("doc_id", "start", "length", "period", "words")])


def _each(batches: Iterator[pa.RecordBatch], prepare: Callable | None, min_length: int, min_periods: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[np.ndarray]]]:
    """For each slice: its rows, their words, and the runs (start, length, period) of each."""
    for part in slices(batches):
        words = [t.split() for t in strings(part.column("text"))]
        if prepare:
            words = [w if i is None else prepare(i, w) for i, w in zip(part.column("doc_id").to_pylist(), words, strict=True)]
        ids, starts = interned(words)
        rows = runs(ids, starts, min_length, min_periods)
        cut = np.searchsorted(rows[:, 0], np.arange(1, len(words)))
        yield part, words, np.split(rows[:, 1:], cut)


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """(doc_id, start, length, period, words): a row for each run of each text, with the words of its first period.

    Null, empty and short texts have none; repeated rows and rows without an id each have their own. Overlapping runs
    are all there. An empty table gives an empty one, and other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, found in _each(batches, None, min_length, min_periods):
            rows = [(i, s, n, q, b" ".join(w[s : s + q]).decode()) for i, w, f in zip(part.column("doc_id").to_pylist(), words, found, strict=True) for s, n, q in f.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 5, _FOUND, strict=True)], schema=_FOUND)

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def without_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """The documents with all their columns; texts with runs keep the first period of each, their words joined by one space.

    Texts without runs stay as they are, nulls too. Repeated rows lose the same words. No name of a column is reserved.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(docs.sparkSession)
    schema = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = [t.split() for t in strings(part.column("text"))]
            rows = runs(*interned(words), min_length, min_periods)
            texts = part.column("text").to_pylist() if len(rows) else None
            for k in np.unique(rows[:, 0]).tolist():
                keep = kept_words(len(words[k]), rows[rows[:, 0] == k, 1:])
                texts[k] = b" ".join(w for w, x in zip(words[k], keep.tolist(), strict=True) if x).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, f.type) if f.name == "text" and texts is not None else part.column(f.name).cast(f.type) for f in schema], schema=schema)

    return docs.mapInArrow(run, docs.schema)


def run_report(docs: DataFrame, prepare: Callable | None = repeated_tail) -> DataFrame:
    """Per row: doc_id, n_runs, the most periodic run (start, length, period, exponent_milli), and two digests.

    runs_sha256 is of a line `start,length,period` for each run, collapsed_sha256 of the words that stay. prepare maps
    (doc_id, words) to words before that; rows without an id are left as they are. Null and empty texts have no words.
    Repeated rows each get a row; an empty table gives an empty one; other columns are ignored. A text is worked on
    whole, in memory that grows with its length (some 200 bytes a word).
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, found in _each(batches, prepare, MIN_LENGTH, MIN_PERIODS):
            out: list[list] = [[] for _ in range(7)]
            for w, f in zip(words, found, strict=True):
                best = most_periodic(f) if len(f) else None
                stay = kept_words(len(w), f).tolist() if len(f) else None
                kept = b" ".join(w if stay is None else [x for x, k in zip(w, stay, strict=True) if k])
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in f.tolist())
                values = (len(f), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(out, list(_REPORT)[1:], strict=True))], schema=_REPORT)

    return docs.select("doc_id", "text").mapInArrow(run, REPORT)
