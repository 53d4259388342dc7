"""Token counts of whole texts by a two-tier lookup, without a shuffle.

A byte-level BPE works on each pre-token alone, and a space before a non-space always begins a pre-token. So a text's
count is the sum over its pieces that begin at such spaces (a piece: one pre-token, or a few, as a word and its comma).
The first tier is a broadcast table of the token counts of frequent pieces; a piece that misses it is encoded by the
library once and kept in the worker's own bounded cache. Both are only caches: counts are exact whatever they hold.
Pieces of any characters go these ways; texts with special strings, and tokenizers of another split, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow_tools import slices
from loomgraph.session import bounded_batches

#: Size of the broadcast table and of the text sample that fills it (a cache only), and of each worker's cache.
TABLE_ROWS, SAMPLE_ROWS, SAMPLE_BYTES, CACHE_ROWS = 1 << 16, 1024, 1 << 16, 700_000
#: Longer pieces are not kept.
LONGEST_PIECE = 64

#: Pieces of other characters than these are counted by the library, not by the split below.
NOT_PLAIN = re.compile("[^\\t-\\r -~À-ÖØ-öø-ÿ]")
#: Where a text has white space beyond single spaces between words and line ends after them, it is cut by CUT.
NOT_SINGLE = re.compile(" [ \\t-\\r]| $")
#: A space that begins a pre-token whatever stands before it.
CUT = re.compile(" (?=[!-~À-ÖØ-öø-ÿ])")
#: How a tokenizer has to split its input for texts to be cut at spaces.
BYTE_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

#: The split into pre-tokens, for texts of the characters above.
PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
#: Byte-level BPE names printable bytes by themselves and the others by the characters from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LEVEL = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_worker: dict = {}


def byte_level(text: str) -> str:
    """A text's bytes in the alphabet that byte-level models take."""
    if text.isascii() and text.isprintable() and " " not in text:
        return text
    return text.encode().decode("latin-1").translate(BYTE_LEVEL)


class Encoder:
    """A tokenizer in a worker; kept while the worker lives."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path) as f:
            self.parts = json.load(f)
        specials = [x["content"] for x in self.parts["added_tokens"]]
        del self.parts["model"]
        self.cut = not self.parts["normalizer"] and BYTE_SPLIT.items() <= (self.parts["pre_tokenizer"] or {}).items()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = re.compile("|".join(map(re.escape, specials)) or "(?!)")
        self.cache: dict = {}

    @staticmethod
    def of(path: str, use: str) -> Encoder:
        if (path, use) not in _worker:
            _worker[path, use] = Encoder(path)
        return _worker[path, use]

    def pack_ids(self, pre_token: str) -> bytes:
        """The ids of one pre-token as little-endian 32-bit bytes, by the library's model alone."""
        found = self.model.tokenize(byte_level(pre_token))
        return struct.pack(f"<{len(found)}I", *(t.id for t in found))

    def count(self, piece: str) -> int:
        """Tokens of a piece: a space and a word mostly."""
        if NOT_PLAIN.search(piece):
            return len(self.library.encode(piece, add_special_tokens=False).ids)
        if piece[1:].isalpha() and piece.isascii() and piece[0] == " ":
            return len(self.model.tokenize("\u0120" + piece[1:]))
        return sum(len(self.model.tokenize(byte_level(p))) for p in PRE_TOKENS.findall(piece))

    def encode(self, texts: list[str]) -> list:
        return self.library.encode_batch_fast(texts, add_special_tokens=False) if texts else []


def counter(path: str, table: dict[str, int]) -> Callable[[list[str]], list[int]]:
    """Counts of a list of texts, as the library gives them without begin, end or added special tokens."""
    own = Encoder.of(path, "counts")
    if not own.cache:
        own.cache.update(table)

    def counted(texts: list[str]) -> list[int]:
        split = [pieces(own, t) for t in texts]
        missing = set().union(*(x[1:] for x in split if x)) - own.cache.keys()
        long = {x: own.count(" " + x) for x in missing if len(x) > LONGEST_PIECE}
        missing -= long.keys()
        if len(own.cache) + len(missing) > CACHE_ROWS:
            own.cache.clear()
            own.cache.update(table)
            missing = set().union(*(x[1:] for x in split if x)) - own.cache.keys() - long.keys()
        own.cache.update((x, own.count(" " + x)) for x in missing)
        get = own.cache.__getitem__ if not long else lambda x: long[x] if x in long else own.cache[x]
        # The first piece of a text has no space before it; the other ones have one.
        whole = iter(own.encode([t for t, x in zip(texts, split, strict=True) if x is None]))
        return [len(next(whole)) if x is None else own.count(x[0]) + sum(map(get, x[1:])) for x in split]

    return counted


def pieces(own: Encoder, text: str) -> list[str] | None:
    """The pieces of a text without the spaces that begin them, or None where the library has to take it whole."""
    if not own.cut or own.special.search(text):
        return None
    return CUT.split(text) if NOT_SINGLE.search(text) or NOT_PLAIN.search(text) else text.split(" ")


def frequent_lengths(docs: DataFrame, path: str, rows: int = TABLE_ROWS, sample: int = SAMPLE_ROWS) -> dict[str, int]:
    """Token counts of the most frequent pieces of some texts of at most SAMPLE_BYTES from all over the table: at most `rows` entries.

    The texts are those of the `sample` ids with the smallest hashes; ids are chosen first, so texts are read once and none is shuffled.
    """
    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES)
    chosen = short.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    own = Encoder.of(path, "counts")
    seen: Counter = Counter()
    for r in short.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").limit(2 * sample).toLocalIterator():
        seen.update(x for x in (pieces(own, r.text) or ())[1:] if len(x) <= LONGEST_PIECE)
    return {x: own.count(" " + x) for x, _ in seen.most_common(rows)}


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts count 0 and 0. Special strings inside a text are special tokens, as the library's default has
    it. Rows with null or equal ids each get a row; an empty table gives an empty one; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = counter(path, table.value)
        for part in slices(batches):
            texts = pc.fill_null(part.column("text"), "")
            n = counted(texts.to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_tokens": n, "over_limit": [x > limit for x in n]}, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
