"""Toxicity scores of restored text: a noisy channel undoes disguised words, then a lexicon learned from labels scores.

The channel model says how a letter may be written (as a look-alike sign, doubled, or with separators around it); the
source model is a character four-gram model of all documents. A disguised span is a lattice of letters, and Viterbi's
algorithm picks the likeliest word. Only spans that look disguised are decoded; a worker keeps what it has decoded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrow_tools import free_name, mixed, slices, strings, text_bytes
from loomgraph.session import bounded_batches, materialize

#: Labelled rows that the classifier learns from, at most (those of the smallest hashes).
SAMPLE_ROWS = 24_000
#: Lengths of the word beginnings that are features, beside whole words.
PREFIXES = (4, 5, 6)
#: A feature is in at least so many distinct toxic texts, and its lower confidence bound of precision is this at least.
MIN_TOXIC, MIN_PRECISION = 3, 0.4
#: Nats by which a feature's log likelihood ratio has to pass what chance over all tried features allows.
MARGIN = 5.0
THRESHOLD = 0.7
#: Longest span that a worker keeps with its decoding, and how many it keeps.
MAX_SPAN, CACHE_SPANS = 48, 100_000

#: Signs and the letters that they stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "2": "z",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou", "(": "c", "<": "c", "€": "e", "£": "l",
}
SEPARATORS = " .-_*~'"
#: Characters whose four-grams are counted at once.
STRETCH = 1 << 18

#: Character codes of the source model: 0 for what is no letter, 1 to 26, and 27 for any byte of other letters.
CODES = 28
CODE_OF = np.zeros(256, np.int64)
CODE_OF[np.arange(65, 91)] = CODE_OF[np.arange(97, 123)] = np.arange(1, 27)
CODE_OF[128:] = 27
LETTER = CODE_OF > 0
SEPARATOR = np.isin(np.arange(256), np.frombuffer(SEPARATORS.encode(), np.uint8))

SIGNS = re.escape("".join(k for k in LOOKALIKES if k.isascii()))
DISGUISED = re.compile(rf"[a-z]+[{SIGNS}]+[a-z{SIGNS}]*[a-z]|(?<![a-z{SIGNS}])[{SIGNS}]+[a-z][a-z{SIGNS}]*[a-z]|(?<![a-z])[a-z{SIGNS}]*[a-z][a-z{SIGNS}]*[0-9@$+](?![a-z0-9{SIGNS}])|[a-z]*([a-z])\1\1[a-z]*")
SINGLE_SPACED = re.compile(rf"(?<![a-z0-9])(?:[a-z{SIGNS}][{re.escape(SEPARATORS)}]{{1,3}}){{3,}}[a-z{SIGNS}](?![a-z0-9])")
HAS_SIGN = re.compile(rf"[a-z][{SIGNS}]|[{SIGNS}][a-z]")
REPEATED = re.compile(r"(.)\1{2,}", re.DOTALL)
NOT_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def add_four_grams(data: np.ndarray, total: np.ndarray) -> None:
    """Counts the four-grams of some bytes, in stretches that share three characters, so that temporaries stay small beside them."""
    edge, small = np.zeros(3, np.int32), CODE_OF.astype(np.int32)
    for start in range(0, len(data) + 1, STRETCH):
        before = small[data[start - 3 : start]] if start else edge
        after = edge[: int(start + STRETCH > len(data))]
        codes = np.concatenate([before, small[data[start : start + STRETCH]], after])
        grams = ((codes[:-3] * CODES + codes[1:-2]) * CODES + codes[2:-1]) * CODES + codes[3:]
        total += np.bincount(grams, minlength=CODES**4)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): counts of character four-grams over all documents, as codes in base CODES."""
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES**4, np.int64)
        for part in slices(batches):
            add_four_grams(text_bytes(part.column(0))[0], total)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": some, "n": total[some]}, schema=schema)

    return docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def source_model(docs: DataFrame) -> np.ndarray:
    """log10 P(character | the three before it), interpolated down to the uniform; CODES**4 numbers whatever the corpus."""
    counts = np.zeros(CODES**4)
    for row in gram_counts(docs).toLocalIterator():
        counts[row.gram] = row.n
    counts = counts.reshape(CODES, CODES, CODES, CODES)
    p = np.full((1, CODES), 1 / CODES)
    for level in (counts.sum((0, 1, 2))[None], counts.sum((0, 1)), counts.sum(0).reshape(-1, CODES), counts.reshape(-1, CODES)):
        kinds = (level > 0).sum(1, keepdims=True)
        n = level.sum(1, keepdims=True)
        lower = np.tile(p, (len(level) // len(p), 1))
        p = np.where(n > 0, (level + kinds * lower) / np.maximum(n + kinds, 1), lower)
    return np.log10(p).astype(np.float32).reshape(-1)


class Decoder:
    """Viterbi decoding of one span at a time."""

    SUBSTITUTE, REPEAT, DROP = -0.3, -0.15, -0.1

    def __init__(self, model: np.ndarray):
        self.model = model
        self.cache: dict[str, str] = {}

    def __call__(self, span: str) -> str:
        if len(span) > MAX_SPAN:
            return self._decoded(span)
        if span not in self.cache:
            if len(self.cache) >= CACHE_SPANS:
                self.cache.clear()
            self.cache[span] = self._decoded(span)
        return self.cache[span]

    def _decoded(self, span: str) -> str:
        """States are the last three codes written; each keeps its best score and words. A separator may end a word."""
        states: dict[tuple[int, int, int], tuple[float, str]] = {(0, 0, 0): (0.0, "")}
        for k, sign in enumerate(span):
            options = [(c, self.SUBSTITUTE) for c in LOOKALIKES.get(sign, "")]
            if "a" <= sign <= "z":
                options.append((sign, 0.0))
            inner = 0 < k < len(span) - 1
            following: dict[tuple[int, int, int], tuple[float, str]] = {}

            def reached(state: tuple, score: float, word: str, into: dict = following) -> None:
                if state not in into or into[state][0] < score:
                    into[state] = score, word

            for (a, b, c), (score, word) in states.items():
                if (sign in SEPARATORS and inner) or not options:
                    reached((a, b, c), score + self.DROP, word)
                    if sign in SEPARATORS and word and c:
                        p = float(self.model[((a * CODES + b) * CODES + c) * CODES])
                        reached((b, c, 0), score + self.DROP + p, word + " ")
                for letter, cost in options:
                    if word and word[-1] == letter and k and (span[k - 1] == sign or span[k - 1] in SEPARATORS):
                        reached((a, b, c), score + self.REPEAT, word)
                    d = ord(letter) - 96
                    p = float(self.model[((a * CODES + b) * CODES + c) * CODES + d])
                    reached((b, c, d), score + cost + p, word + letter)
            states = following
        return max(((s + float(self.model[((a * CODES + b) * CODES + c) * CODES]), w) for (a, b, c), (s, w) in states.items()), default=(0.0, ""))[1]


def suspicious(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, whether it has a letter three times in a row or single letters with separators between them."""
    if len(data) < 7:
        return np.ones(len(offsets) - 1, bool)
    letter = LETTER[data]
    lower = data | np.uint8(32)
    triple = letter[2:] & (lower[2:] == lower[1:-1]) & (lower[1:-1] == lower[:-2])
    gap = SEPARATOR[data]
    # Single signs between separators, the next one after one to three separators; an asterisk may be either.
    single = np.flatnonzero((~gap | (data == ord("*")))[1:-1] & gap[:-2] & gap[2:]) + 1
    near = single[:-1][(np.diff(single) >= 2) & (np.diff(single) <= 4)]
    at = np.concatenate([np.flatnonzero(triple), near])
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, at, "right") - 1] = True
    return out


def restored(text: str, flagged: bool, decode: Decoder) -> set[str]:
    """The words that a lower-case text's disguised spans stand for."""
    found = set()
    if flagged or HAS_SIGN.search(text):
        spans = {m.group() for m in DISGUISED.finditer(text)}
        if flagged:
            spans |= {m.group() for m in SINGLE_SPACED.finditer(text)}
        for span in spans:
            span = REPEATED.sub(r"\1\1", span)
            if len(span) >= 3:
                found.update(decode(span).split())
                if span[1] in SEPARATORS:
                    found.update((decode(span[2:]) + " " + decode(span[:-2])).split())  # a neighbouring one-letter word may stand before or after
    return found


def words_of(part: pa.RecordBatch, decode: Decoder) -> Iterator[set[bytes]]:
    """The distinct words of each text, disguised ones restored as well."""
    column = part.column(part.schema.get_field_index("text"))
    data, offsets = text_bytes(column)
    for raw, flagged in zip(strings(column), suspicious(data, offsets).tolist(), strict=True):
        text = raw.decode().lower()
        words = set(text.encode().translate(NOT_LETTERS).split())
        words.update(w.encode() for w in restored(text, flagged, decode))
        yield words


def features(words: Iterable[bytes]) -> set[bytes]:
    """A word as itself and by its beginnings, which are marked by an asterisk."""
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + b"*" for w in words if len(w) >= n])
    return out


def _clustered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the sample, one row for each group of near copies with the same label.

    Held-out rows (crc32(doc_id as text) mod 3 is 1) are never in it; rows without a label neither.
    """
    crc = F.crc32(F.col("doc_id").cast("string"))
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic_")).where(crc % 3 != 1)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32()), ("cluster", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            groups = []
            for text in strings(part.column("text")):
                w = text.lower().split()
                hashes = np.array([xxhash.xxh3_64_intdigest(b" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))], np.uint64)
                groups.append(mixed(hashes).min())
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text": part.column("text"), "toxic": part.column("toxic_"), "cluster": np.array(groups, np.uint64).view(np.int64)}, schema=schema)

    found = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", F.col("toxic_").cast("int").alias("toxic_"))), "doc_id")
    rows = materialize(found.mapInArrow(run, "doc_id long, text string, toxic int, cluster long"), "toxicity-sample")
    first = rows.groupBy("cluster", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return rows.join(F.broadcast(first), ["cluster", "toxic", "doc_id"], "left_semi").select("doc_id", "text", "toxic")


def _feature_rows(model, chosen=None) -> Callable:
    """Counts of features by label within a task; chosen: a broadcast set of those that count."""
    schema = pa.schema([("feature", pa.binary()), ("toxic", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(model.value)
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for part in slices(batches):
            for words, toxic in zip(words_of(part, decode), part.column("toxic").to_pylist(), strict=True):
                own = features(words)
                counts[bool(toxic)].update(own if chosen is None else own & chosen.value)
        for toxic in (0, 1):
            yield pa.RecordBatch.from_pydict({"feature": list(counts[toxic]), "toxic": [toxic] * len(counts[toxic]), "n": list(counts[toxic].values())}, schema=schema)

    return run


def lexicon(docs: DataFrame, labels: DataFrame, model) -> tuple[dict[bytes, float], float]:
    """Features and how sure they make a text toxic, and the score of a text without any; learned from the sample.

    The certainty is the lower bound (Wilson, 1.64 deviations) of the share of toxic texts among those with the feature.
    A feature also has to be likelier in toxic texts than chance over all tried features allows.
    """
    rows = _clustered(docs, labels)
    sizes = {bool(r.toxic): r.n for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    base = toxic / max(1, toxic + clean)
    if not toxic:
        return {}, 0.0
    tried = rows.where("toxic > 0").mapInArrow(_feature_rows(model), "feature binary, toxic int, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TOXIC)
    ones = {bytes(r.feature): r.n for r in tried.collect()}
    spark = docs.sparkSession
    chosen = spark.sparkContext.broadcast(set(ones))
    zeros = {bytes(r.feature): r.n for r in rows.where("toxic <= 0").mapInArrow(_feature_rows(model, chosen), "feature binary, toxic int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    chance = np.log(len(ones) + 1.0) + MARGIN
    out = {}
    for f, n in ones.items():
        m = n + zeros.get(f, 0)
        p, z = n / m, 1.64
        low = (p + z * z / (2 * m) - z * np.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        gain = n * np.log(max(p / base, 1e-9)) + (m - n) * np.log(max(1 - p, 1e-9) / (1 - base)) if base < 1 else n
        if low >= MIN_PRECISION and (gain > chance or len(ones) < 2):
            out[f] = float(low)
    return out, base / 8


SCORES = "doc_id long, held_out boolean, score double, predicted int"


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep: bool = False) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.7); keep: the columns of docs and predicted.

    A text's score is the chance that any of its features tells the truth: 1 - (1 - base) * product of (1 - certainty)
    over its three surest words, each by its surest feature. Null and empty texts get the base score. Rows without an id are not held out.
    Without labelled toxic texts every score is 0. Equal texts have equal scores and repeated rows each get a row. An
    empty table gives an empty one. With keep, predicted takes another name where docs has that one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(source_model(docs))
    weights, base = lexicon(docs, labels, model)
    terms = spark.sparkContext.broadcast(weights)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructType

    held = (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0)) == 1).alias("held_out")
    ready = docs if keep else docs.select("doc_id", "text", held)
    mark = free_name("predicted", docs.columns) if keep else "predicted"
    schema = StructType([*docs.schema.fields]) if keep else StructType().add("doc_id", LongType()).add("held_out", BooleanType()).add("score", DoubleType())
    schema = schema.add(mark, IntegerType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(model.value)
        certain = terms.value
        whole = {k: v for k, v in certain.items() if not k.endswith(b"*")}
        begin = [(n, {k[:-1]: v for k, v in certain.items() if k.endswith(b"*") and len(k) == n + 1}) for n in PREFIXES]
        for part in slices(batches):
            scores = []
            for words in words_of(part, decode):
                best = {w: whole[w] for w in words & whole.keys()}
                for n, known in begin:
                    for w in words if known else ():
                        if (v := known.get(w[:n])) is not None and v > best.get(w, 0.0):
                            best[w] = v
                rest = 1 - base
                for h in sorted(best.values())[-3:]:
                    rest *= 1 - h
                scores.append(1 - rest)
            made = ({} if keep else {"score": pa.array(scores, pa.float64())}) | {mark: pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else part.column(f.name) for f in arrow], schema=arrow)

    return ready.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns.

    Null and empty texts stay, and so do rows without an id that are not toxic; repeated rows stay or go together. An
    empty table gives an empty one. No name of a column is reserved.
    """
    mark = free_name("predicted", docs.columns)
    return toxicity_scores(docs, labels, keep=True).where(F.col(mark) == 0).select(*(f"`{c}`" for c in docs.columns))
