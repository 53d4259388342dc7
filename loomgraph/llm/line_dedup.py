"""Line dedup with two Bloom filters.

A first pass fills a once-seen and a twice-seen filter with the hashes of all lines. A second pass tests every line
against the twice-seen filter; only suspected repeats, as 128-bit digests, are shuffled, counted exactly and given the
document that keeps them. Lines seen once never leave their task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow_tools import free_name, slices, strings
from loomgraph.llm.seen_filters import ROWS, TwiceSeen, log2_bits, sketch_rows

BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCUMENTS = 20, 3
#: Rows of one frequent line are dealt over so many salts when they meet that line's keeper.
SALTS = 16
#: Characters of text for one line, for the filters' size only.
CHARS_PER_LINE = 100

SUSPECTS = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("line_numbers", pa.list_(pa.int32()))])


def keyed_lines(text: bytes, min_chars: int) -> dict[bytes, list[int]]:
    """The keys of a text that are long enough, with the numbers of their lines."""
    found: dict[bytes, list[int]] = {}
    for k, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(BLANKS).lower()
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                found.setdefault(key, []).append(k)
    return found


def _sketched(min_chars: int, log2: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[np.ndarray]:
            for part in slices(batches):
                for text in strings(part.column(0)):
                    if keys := keyed_lines(text, min_chars):
                        yield np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)

        yield from sketch_rows(groups(), log2)

    return run


def _suspected(min_chars: int, seen: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: tuple[list, list, list] = ([], [], [])
            for doc_id, text in zip(part.column("doc_id").to_pylist(), strings(part.column("text")), strict=True):
                keys = keyed_lines(text, min_chars)
                if not keys or doc_id is None:
                    continue
                hit = seen(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64))
                for (key, numbers), suspect in zip(keys.items(), hit.tolist(), strict=True):
                    if suspect:
                        out[0].append(hashlib.blake2b(key, digest_size=16).digest())
                        out[1].append(doc_id)
                        out[2].append(numbers)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, SUSPECTS, strict=True)], schema=SUSPECTS)

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc_id, line_numbers): the lines that each document loses, numbered from 0; documents that lose none have no row.

    A key held by at least `min_documents` documents stays in the largest doc_id that holds it, with all its lines
    there. Rows with the same doc_id are one document. Null ids and null or empty texts lose nothing and do not count.
    """
    slim = docs.select("doc_id", "text")
    chars = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log2 = log2_bits(chars // CHARS_PER_LINE)
    seen = TwiceSeen(slim.select("text").mapInArrow(_sketched(min_chars, log2), ROWS), log2)
    rows = slim.mapInArrow(_suspected(min_chars, seen.test()), "digest binary, doc_id long, line_numbers array<int>")
    keepers = rows.groupBy("digest").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_documents)
    salted = keepers.select("digest", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    lost = rows.withColumn("salt", F.pmod(F.col("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"]).where(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("line_numbers"))).alias("line_numbers"))


def _kept(digest_only: bool, schema: pa.Schema, found: str = "line_numbers") -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, dropped, digests, texts = [], [], [], []
            for text, numbers in zip(strings(part.column("text")), part.column(found).to_pylist(), strict=True):
                lines = text.split(b"\n")
                gone = set(numbers or ())
                kept = b"\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text
                counts.append(len(lines))
                dropped.append(len(gone))
                if digest_only:
                    digests.append(hashlib.sha256(kept).hexdigest())
                else:
                    texts.append(kept.decode())
            if digest_only:
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_lines": counts, "n_dropped": dropped, "kept_sha256": digests}, schema=schema)
            else:
                own = {f.name: part.column(f.name) for f in schema}
                keep_null = [t if d or s.is_valid else None for t, d, s in zip(texts, dropped, part.column("text"), strict=True)]
                yield pa.RecordBatch.from_pydict(own | {"text": pa.array(keep_null, schema.field("text").type)}, schema=schema)

    return run


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 (of the text that stays).

    Null and empty texts are one empty line. Repeated rows each get a row. An empty table gives an empty one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
    slim = docs.select("doc_id", "text")
    return slim.join(dropped_lines(slim, min_chars, min_documents), "doc_id", "left").mapInArrow(_kept(True, schema), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents with all their columns, `text` without the dropped lines; a null text stays null.

    Which lines go does not depend on the order of rows: a key's keeper is the largest doc_id. Repeated rows lose the
    same lines each, rows without an id none. An empty table gives an empty one. No name of a column is reserved.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spare = free_name("line_numbers", docs.columns)
    found = docs.join(dropped_lines(docs, min_chars, min_documents).withColumnRenamed("line_numbers", spare), "doc_id", "left").select(*(f"`{c}`" for c in docs.columns), F.col(spare))
    kept = _kept(False, to_arrow_schema(docs.schema), spare)
    return found.mapInArrow(kept, docs.schema)
