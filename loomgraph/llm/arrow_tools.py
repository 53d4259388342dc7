"""Small helpers for functions that run inside mapInArrow tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step holds at a time; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20

#: Fixed odd multipliers for hashing.
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) in one array, and the offsets of its rows, from 0."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of text, so that temporaries stay small whatever a batch holds."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h + np.uint64((seed * BASE) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def strings(column: pa.Array) -> list[bytes]:
    """The rows of a string column as UTF-8 bytes; null: empty."""
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores after it as no column has."""
    return next(x for k in range(len(taken) + 1) if (x := name + "_" * k) not in taken)
