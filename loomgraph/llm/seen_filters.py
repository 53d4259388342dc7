"""Once-seen and twice-seen Bloom filters, built on the executors in segments.

Two filters over 64-bit hashes: the first holds what was seen, the second what was seen when the first already held it.
Every hash that occurs at least twice is in the second (no false negatives), so only hashes found there need a shuffle.
Map tasks send the positions of their bits, segment by segment; one task merges a segment, whose bitmap has a fixed size.
False positives only make more rows shuffle: what follows is exact at any load of the filter.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

SEGMENT_LOG2 = 22
#: A filter never has more bits than this (128 MB); more keys raise the share of false positives, not the size.
MAX_LOG2 = 30
MIN_LOG2 = 22
#: Hashes that a map task holds before it sends their positions.
FLUSH = 1 << 20

ROWS = "segment int, once binary, twice binary"
ROWS_ARROW = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def log2_bits(keys: int, bits_per_key: int = 12) -> int:
    """The size for so many keys, as a power of two within fixed bounds."""
    return int(min(MAX_LOG2, max(MIN_LOG2, np.ceil(np.log2(max(1, keys * bits_per_key))))))


def positions(hashes: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bit positions of each hash."""
    return hashes >> np.uint64(64 - log2), (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - log2)


def _packed(at: np.ndarray) -> bytes:
    return zlib.compress(np.diff(at.astype(np.uint32), prepend=np.uint32(0)).tobytes(), 1) if len(at) else b""


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint32), dtype=np.int64) if data else np.zeros(0, np.int64)


def sketch_rows(groups: Iterable[np.ndarray], log2: int) -> Iterator[pa.RecordBatch]:
    """groups: for each document (or other unit) its distinct hashes; a hash that two units hold is seen twice."""
    held, n = [], 0

    def sent() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        out = {}
        for k, part in enumerate((values, values[counts > 1])):
            if not len(part):
                continue
            at = np.unique(np.concatenate(positions(part, log2)))
            low = at & np.uint64((1 << SEGMENT_LOG2) - 1)
            segment = (at >> np.uint64(SEGMENT_LOG2)).astype(np.int64)
            starts = np.flatnonzero(np.diff(segment, prepend=-1))
            for a, b in zip(starts, np.append(starts[1:], len(at)), strict=True):
                out.setdefault(int(segment[a]), [b"", b""])[k] = _packed(low[a:b])
        return pa.RecordBatch.from_pydict({"segment": list(out), "once": [x[0] for x in out.values()], "twice": [x[1] for x in out.values()]}, schema=ROWS_ARROW)

    for hashes in groups:
        held.append(hashes)
        n += len(hashes)
        if n >= FLUSH:
            yield sent()
            held, n = [], 0
    if n:
        yield sent()


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    once, twice = np.zeros(1 << SEGMENT_LOG2, bool), np.zeros(1 << SEGMENT_LOG2, bool)
    for a, b in zip(rows["once"], rows["twice"], strict=True):
        at = _unpacked(a)
        twice[at[once[at]]] = True
        once[at] = True
        twice[_unpacked(b)] = True
    return pd.DataFrame({"segment": rows["segment"].iloc[:1], "bits": [zlib.compress(np.packbits(twice).tobytes(), 1)]})


class TwiceSeen:
    """The second filter, broadcast; its size is 2**log2 bits, at most 2**MAX_LOG2."""

    def __init__(self, rows: DataFrame, log2: int):
        bitmap = np.zeros(1 << max(0, log2 - 3), np.uint8)
        size = 1 << (SEGMENT_LOG2 - 3)
        for row in rows.groupBy("segment").applyInPandas(_merge, "segment int, bits binary").toLocalIterator():
            part = np.frombuffer(zlib.decompress(bytes(row.bits)), np.uint8)
            bitmap[row.segment * size : (row.segment + 1) * size] = part
        self.log2 = log2
        self.bits: Broadcast = rows.sparkSession.sparkContext.broadcast(bitmap)

    def test(self) -> Callable[[np.ndarray], np.ndarray]:
        return _Test(self.bits, self.log2)


class _Test:
    """True for each hash that the filter holds; what a task gets of it is the broadcast's id and the size."""

    def __init__(self, bits: Broadcast, log2: int):
        self.bits, self.log2 = bits, log2

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        bitmap = self.bits.value
        found = np.ones(len(hashes), bool)
        for at in positions(hashes, self.log2):
            found &= (bitmap[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
        return found
