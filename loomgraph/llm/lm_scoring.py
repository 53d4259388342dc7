"""Language-model scores by a probabilistic suffix tree over words.

A text is its words (ASCII lower case) and an end. The tree's symbols are the frequent words and one more, `other`, for
all the rest; its contexts are up to DEPTH symbols long. A context stays if its next-symbol distribution diverges from
that of its longest suffix that stays; distributions are smoothed towards that suffix's. A token is scored in the longest
such suffix of what precedes it. A rare word then has its share of all rare words, and a word that training does not
have is spelled by a second tree of the same kind over the bytes of the rare words, so a text's score is the probability
of its words as they are written.

Every count is a Spark aggregation over the whole corpus. A gram of the tree has at least the share LEAST of all tokens,
so a level has at most 1 / LEAST of them, as sorted arrays; the counts of rare words grow with the corpus and stay tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow_tools import slices, strings
from loomgraph.session import bounded_batches, materialize, remove, written

DEPTH = 3
#: A gram (context and symbol) of the tree is at least this share of all symbols, and occurs at least twice.
LEAST = 1e-6
#: A context stays if n * divergence (in nats) is over this for each symbol that is kept after it.
GAIN = 2.0
#: Words of at least this share of all tokens are symbols: 1 / FREQUENT of them at most, fewer than 2**BITS.
FREQUENT = 1e-6
#: Entries that a map task holds before it sends its counts.
HELD = 2_000_000
ALPHA = 0.1

BITS = 20
#: The symbol that stands before a text; the rare words' symbol; the end of a spelling.
START, OTHER, SPELLED = (1 << BITS) - 1, 0, 256
BLANK = re.compile(rb"[\t-\r ]")
#: Bytes of a text that are split into words at a time.
STRETCH = 1 << 20


def in_training(doc_id: Column) -> Column:
    """Whether a row is learned from: crc32(doc_id as text) mod 10 is not 0; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 != 0, F.lit(True))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a stretch at a time."""
    start = 0
    while start < len(text):
        cut = BLANK.search(text, start + STRETCH) if len(text) - start > STRETCH else None
        stop = cut.start() if cut else len(text)
        yield text[start:stop].lower().split()
        start = stop


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): token counts within a task; the end is the empty word."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    counts: Counter = Counter()

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())}, schema=schema)

    for part in slices(batches):
        for t in strings(part.column(0)):
            counts[b""] += 1
            for words in words_of(t):
                counts.update(words)
        if len(counts) > HELD // 8:
            yield sent()
            counts.clear()
    yield sent()


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in one array, and the offsets of its rows, from 0."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _places(offsets: np.ndarray) -> np.ndarray:
    """Of each symbol, its place in its row."""
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


def id_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of rows of 32-bit symbols, and the offsets of the rows."""
    raw, offsets = _cells(column)
    return np.frombuffer(raw.tobytes(), "<i4").astype(np.int64), offsets // 4


def spelled_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each word and an end, and the offsets of the words."""
    raw, offsets = _cells(column)
    offsets = offsets + np.arange(len(offsets))
    out = np.full(len(raw) + len(column), SPELLED, np.int64)
    inside = np.ones(len(out), bool)
    inside[offsets[1:] - 1] = False
    out[inside] = raw
    return out, offsets


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in a sorted table, and whether it does."""
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _before(symbols: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The symbol k places before each; START right before a row, and -1 further out."""
    out = np.full(len(symbols), -1, np.int64)
    out[k:] = symbols[:-k]
    out[places < k] = -1
    out[places == k - 1] = START
    return out


class Level:
    """The contexts of one length. A context's number is its place in `contexts`, whose keys are the number of its suffix
    and its first symbol; `grams` are a context's number and the symbol after it, with their probability."""

    def __init__(self, contexts: np.ndarray, stays: np.ndarray, rest: np.ndarray, grams: np.ndarray, p: np.ndarray):
        self.contexts, self.stays, self.rest, self.grams, self.p = contexts, stays, rest, grams, p

    def smoothed(self, nodes: np.ndarray, symbols: np.ndarray, below: np.ndarray) -> np.ndarray:
        """The probabilities of symbols after contexts, given those after the contexts' suffixes."""
        at, known = _find(self.grams, nodes << BITS | symbols)
        return np.where(self.stays[nodes], np.where(known, self.p[at], self.rest[nodes] * below), below)


class SuffixTree:
    """A suffix tree that grows level by level: `first` are the probabilities of its symbols without a context."""

    def __init__(self, first: np.ndarray):
        self.first, self.levels = first, []

    def _walk(self, symbols: np.ndarray, places: np.ndarray) -> Iterator[tuple[Level, np.ndarray, np.ndarray]]:
        """For each level, the places whose context of that length is in the tree, and the numbers of those contexts."""
        live, nodes = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
        for depth, level in enumerate(self.levels, 1):
            before = _before(symbols, places, depth)[live]
            at, known = _find(level.contexts, nodes << BITS | before)
            known &= before >= 0
            live, nodes = live[known], at[known]
            yield level, live, nodes

    def keys(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The grams of the next level: the number of the context's suffix, the context's first symbol, the symbol after it.

        A context is itself a gram of the level before, so where that level does not hold it, no gram after it is frequent.
        """
        live, nodes = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
        frequent = np.ones(len(symbols), bool)
        for level, live, nodes in self._walk(symbols, places):
            frequent = np.zeros(len(symbols), bool)
            frequent[live] = _find(level.grams, nodes << BITS | symbols[live])[1]
        before = _before(symbols, places, len(self.levels) + 1)[live]
        inside = before >= 0
        if self.levels:
            inside &= frequent[live - 1]
        return nodes[inside] << 2 * BITS | before[inside] << BITS | symbols[live[inside]]

    def probabilities(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of each symbol, after the longest context that stays."""
        p = self.first[symbols]
        for level, live, nodes in self._walk(symbols, places):
            p[live] = level.smoothed(nodes, symbols[live], p[live])
        return p

    def _after(self, depth: int, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The probabilities of symbols after contexts of that length."""
        if not depth:
            return self.first[symbols]
        level = self.levels[depth - 1]
        return level.smoothed(nodes, symbols, self._after(depth - 1, level.contexts[nodes] >> BITS, symbols))

    def add(self, keys: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray, gain: float) -> None:
        """The next level, of sorted gram keys, their counts, and of their contexts the symbols after them, all and different."""
        contexts, first, nodes = np.unique(keys >> BITS, return_index=True, return_inverse=True)
        symbols = keys & ((1 << BITS) - 1)
        below = self._after(len(self.levels), keys >> 2 * BITS, symbols)
        p = (n + kinds * below) / (total + kinds)
        kept = np.bincount(nodes)

        def over(x: np.ndarray) -> np.ndarray:
            return np.bincount(nodes, x)

        left, left_below = np.maximum(1 - over(p), 1e-12), np.maximum(1 - over(below), 1e-12)
        all_ = total[first]
        rest = all_ - over(n)
        divergence = over(n * np.log(n / total / below)) + rest * np.log(np.maximum(rest, 1) / all_ / left_below)
        self.levels.append(Level(contexts, divergence >= gain * kept, left / left_below, nodes << BITS | symbols, p))


def key_rows(tree: Broadcast, read: Callable) -> Callable:
    """A function for mapInArrow: (key, n) of the next level's grams, counted within a task."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices([batch], batch.schema.names[0], 1 << 20):
                symbols, offsets = read(part.column(0))
                held.append(tree.value.keys(symbols, _places(offsets)))
                size += len(held[-1])
                if size > HELD:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    return run


def grow(tree: SuffixTree, rows: DataFrame, read: Callable, least: float, depth: int = DEPTH, gain: float = GAIN) -> SuffixTree:
    """Adds levels to a tree from rows of one column of symbols. Only contexts that extend a context of the tree are counted.

    `least` is a share of all symbols, so that the grams that come to the driver are bounded.
    """
    spark = rows.sparkSession
    for _ in range(depth):
        shared = spark.sparkContext.broadcast(tree)
        path = written(rows.mapInArrow(key_rows(shared, read), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "suffix-grams")
        level = spark.read.schema("key long, n long").parquet(path).withColumn("context", F.shiftrightunsigned("key", BITS))
        sums = level.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        found = level.where(F.col("n") >= least).join(sums, "context").select("key", "n", "total", "kinds").toArrow()
        remove(spark, path)
        shared.unpersist()
        if not found.num_rows:
            break
        keys, n, total, kinds = (found.column(k).to_numpy() for k in range(4))
        order = np.argsort(keys)
        tree.add(keys[order], n[order], total[order], kinds[order], gain)
    return tree


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, frequent_base double, symbols binary, rare array<struct<word:binary,n:long,spelled:double>>"
_RARE = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64()), ("spelled", pa.float64())]))
_ENCODED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_frequent", pa.int64()), ("frequent_base", pa.float64()), ("symbols", pa.binary()), ("rare", _RARE)])


def encoded(vocabulary: Broadcast, spelling: Broadcast) -> Callable:
    """A function for mapInArrow: the symbols of each text, the base score of its frequent words, and its rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base = vocabulary.value
        row = TaskContext.get().partitionId() << 33
        for part in slices(batches, limit=1 << 20):
            rows, rare = [], []
            for doc_id, held_out, text in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), strings(part.column("text")), strict=True):
                own: Counter = Counter()
                symbols = []
                for words in words_of(text):
                    ids = [known.get(w, OTHER) for w in words]
                    symbols.append(np.array(ids, "<i4"))
                    if OTHER in ids:
                        own.update(w for w, k in zip(words, ids, strict=True) if not k)
                symbols.append(np.array([known.get(b"", OTHER)], "<i4"))
                if b"" not in known:
                    own[b""] += 1
                ids = np.concatenate(symbols)
                rows.append((row, doc_id, held_out, len(ids), int((ids != OTHER).sum()), float(base[ids].sum()), ids.tobytes()))
                rare.append(own)
                row += 1
            new = list(set().union(*rare))
            how = dict(zip(new, spelled(spelling.value, new).tolist(), strict=True))
            lists = [[{"word": w, "n": n, "spelled": how[w]} for w, n in own.items()] for own in rare]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([*zip(*rows, strict=True), lists], _ENCODED, strict=True)], schema=_ENCODED)

    return run


def spelled(tree: SuffixTree, words: list[bytes]) -> np.ndarray:
    """The log10 probability of each word's bytes and its end."""
    if not words:
        return np.zeros(0)
    symbols, offsets = spelled_symbols(pa.array(words, pa.large_binary()))
    return np.add.reduceat(np.log10(tree.probabilities(symbols, _places(offsets))), offsets[:-1])


def scored(tree: Broadcast) -> Callable:
    """A function for mapInArrow: the log10 probability of each row's symbols."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_frequent", pa.int64()), ("frequent_base", pa.float64()), ("tree_score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "symbols", 1 << 20):
            symbols, offsets = id_symbols(part.column("symbols"))
            score = np.add.reduceat(np.log10(tree.value.probabilities(symbols, _places(offsets))), offsets[:-1])
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in list(schema)[:-1]), pa.array(score)], schema=schema)

    return run


def byte_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(symbol, n): how often each byte, and the end, is in the words of a task."""
    counts = np.zeros(SPELLED + 1, np.int64)
    for batch in batches:
        counts += np.bincount(spelled_symbols(batch.column(0))[0], minlength=SPELLED + 1)
    yield pa.RecordBatch.from_pydict({"symbol": np.arange(SPELLED + 1), "n": counts})


def spelling_tree(words: DataFrame, least: float = LEAST, gain: float = GAIN) -> SuffixTree:
    """The tree over the bytes of the words in a table's one column."""
    counts = np.ones(SPELLED + 1)
    for r in words.mapInArrow(byte_rows, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        counts[r.symbol] += r.n
    return grow(SuffixTree(counts / counts.sum()), words, spelled_symbols, max(2.0, least * (counts.sum() - len(counts))), gain=gain)


def lm_scores(docs: DataFrame, least: float = LEAST, gain: float = GAIN, frequent: float = FREQUENT) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id as text) mod 10 is not 0. base_score is the unigram log10 probability with 0.1
    added to each count; score is the log10 probability of the text by the trees. Words of at least the share `frequent`
    of all tokens, and at least two of them, are symbols of the tree. Null and empty texts are one token, the end. Without
    training rows every word is spelled, with all bytes equally likely. Repeated rows each get a row and each count; other
    columns are ignored. A long text is split into words a stretch at a time; its symbols, four bytes a word, are one cell.
    """
    if not 1e-6 <= min(least, frequent) <= max(least, frequent) <= 1:
        raise ValueError(f"shares have to lie between 1e-6 and 1, so that the tree stays bounded: {least}, {frequent}")
    spark = docs.sparkSession
    bounded_batches(spark)
    context = spark.sparkContext
    slim = docs.select("doc_id", "text", (~in_training(F.col("doc_id"))).alias("held_out"))
    counts = materialize(slim.where(~F.col("held_out")).select("text").mapInArrow(word_rows, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    known = counts.where("n > 0")
    size = known.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, kinds = size.n or 0, size.v or 0
    below = float(np.log10(total + ALPHA * (kinds + 1)) if total else np.log10(ALPHA))
    often = F.col("n") >= max(2.0, frequent * total)
    vocabulary = known.where(often).orderBy("word").toArrow()
    words, own = vocabulary.column(0).to_pylist(), vocabulary.column(1).to_numpy().astype(np.float64)
    rare, n_rare, kinds_rare = known.where(~often), total - int(own.sum()), max(1, kinds - len(words))

    spelling = context.broadcast(spelling_tree(rare.select("word"), least, gain))
    base = np.concatenate([[0.0], np.log10(own + ALPHA) - below])
    rows = materialize(slim.mapInArrow(encoded(context.broadcast((dict(zip(words, range(1, len(words) + 1), strict=True)), base)), spelling), ENCODED), "suffix-symbols")
    first = np.concatenate([[n_rare + 1.0], own]) / (total + 1.0)
    tree = grow(SuffixTree(first), rows.where(~F.col("held_out")).select("symbols"), id_symbols, max(2.0, least * total), gain=gain)
    by_tree = rows.drop("rare").mapInArrow(scored(context.broadcast(tree)), "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, frequent_base double, tree_score double")

    # A rare word has its share of the rare tokens; as much as there are rare words is left for those never seen.
    each = rows.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("tf"), F.col("r.spelled").alias("spelled")).join(rare, "word", "left")
    plain = F.log10(F.coalesce("n", F.lit(0)) + F.lit(ALPHA)) - F.lit(below)
    share = F.log10(F.coalesce("n", F.lit(kinds_rare)) / F.lit(float(n_rare + kinds_rare))) + F.when(F.col("n").isNull(), F.col("spelled")).otherwise(F.lit(0.0))
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(F.lit(0))).alias("n_rare"), F.sum(F.col("tf") * plain).alias("rare_base"), F.sum(F.col("tf") * share).alias("rare_score"))
    return by_tree.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("frequent_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("tree_score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
