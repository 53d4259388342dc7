"""Language identification by rank-order profiles.

A language's profile is the ranking of the most frequent letter n-grams (1 to 3 letters within words) of all training
texts of that language; a text is given the language whose profile its own ranking is least out of place in. Counts are
added up in each task before they shuffle, so a language that holds most rows sends no more than any other.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.arrow_tools import slices, strings
from loomgraph.session import bounded_batches

#: Ranks of a profile. An n-gram that a profile lacks is so many places out.
RANKS = 300
LONGEST = 3
FOLDS = 5
UNKNOWN = "und"
#: Letters of a text that are counted in one step.
WINDOW = 1 << 20
#: Distinct n-grams of all languages that a training task holds before it sends them.
FLUSH = 1 << 21
#: The profiles are broadcast (RANKS rows a language); a lang column with more values than this is no list of languages.
MAX_LANGUAGES = 10_000

_BITS = np.int64(21)
_letters: np.ndarray | None = None


def folded_letters() -> np.ndarray:
    """For each code point of a lower-cased text: itself for a letter, itself plus 2**21 for a mark, a space otherwise."""
    global _letters
    if _letters is None:
        kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
        _letters = np.array([c if k == "L" else c + (1 << 21) if k == "M" else 32 for c, k in enumerate(kinds)], np.int32)
    return _letters


def word_letters(text: bytes) -> np.ndarray:
    """The letters and marks of the lower-cased text, with one space around and between words; empty without a letter."""
    points = folded_letters()[np.frombuffer(text.decode().lower().encode("utf-32-le"), np.uint32)]
    if not ((points != 32) & (points < 1 << 21)).any():
        return np.zeros(0, np.int64)
    points = np.concatenate([[32], points & ((1 << 21) - 1), [32]])
    return points[(points != 32) | np.append(points[1:] != 32, True)].astype(np.int64)


def gram_counts(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of 1 to 3 letters, with the spaces around a word, as numbers in ascending order, and how often each occurs.

    A number holds 21 bits a letter, so shorter n-grams come first and equally long ones in the order of code points.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, max(1, len(letters)), WINDOW):
        x = letters[start : start + WINDOW + LONGEST - 1]
        own = min(WINDOW, len(letters) - start)
        two = (x[:-1] << _BITS | x[1:])[:own]
        three = (x[:-2] << 2 * _BITS | x[1:-1] << _BITS | x[2:])[: min(own, max(0, len(x) - 2))]
        one = x[:own]
        held.append(np.unique(np.concatenate([one[one != 32], two, three[x[1 : len(three) + 1] != 32]]), return_counts=True))
    return held[0] if len(held) == 1 else summed(held)


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same numbers added up."""
    keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in held])).astype(np.int64)


def ranking(text: bytes, ranks: int) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first, equal ones by number."""
    letters = word_letters(text)
    if not len(letters):
        return letters
    grams, counts = gram_counts(letters)
    return grams[np.argsort(-counts, kind="stable")[:ranks]]


_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, counts = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], schema=_GRAMS)

    for part in slices(batches):
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), strings(part.column("text")), strict=True):
            by_lang.setdefault(lang, []).append(word_letters(text))
        for lang, letters in by_lang.items():
            # Texts start and end with a space; the two between neighbours are a pair of their own that no text holds.
            grams, counts = gram_counts(np.concatenate(letters))
            real = grams != (32 << 21 | 32)
            parts = held.setdefault(lang, [])
            parts.append((grams[real], counts[real]))
            size += len(grams)
            if len(parts) > 8:
                size -= sum(len(k) for k, _ in parts)
                held[lang] = [summed(parts)]
                size += len(held[lang][0][0])
        if size > FLUSH:
            yield from sent()
            held, size = {}, 0
    yield from sent()


def profiles(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(lang, gram, rank): each language's most frequent n-grams over all rows with a lang and a text, ranks from 0."""
    counts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    placed = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))).where(F.col("rank") <= ranks)
    return placed.select("lang", "gram", (F.col("rank") - 1).cast("int").alias("rank"))


class Profiles:
    """All profiles as sorted arrays: the place of each known n-gram in each language, `ranks` where it has none."""

    def __init__(self, rows: list, ranks: int):
        self.ranks = ranks
        self.langs = sorted({r.lang for r in rows})
        if len(self.langs) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        self.grams = np.unique(np.array([r.gram for r in rows], np.int64))
        self.places = np.full((len(self.grams), len(self.langs)), ranks, np.int32)
        column = {x: k for k, x in enumerate(self.langs)}
        self.places[np.searchsorted(self.grams, [r.gram for r in rows]), [column[r.lang] for r in rows]] = [r.rank for r in rows]

    def nearest(self, text: bytes) -> tuple[str, float]:
        """The language of least out-of-place distance (ties: the first by name), and 1 - distance / largest distance."""
        own = ranking(text, self.ranks)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        places = self.places[at[known]]
        out = np.where(places == self.ranks, self.ranks, np.abs(places - np.flatnonzero(known)[:, None]))
        distance = out.sum(0) + self.ranks * (len(own) - len(at[known]))
        best = int(np.argmin(distance))
        return self.langs[best], 1.0 - float(distance[best]) / (self.ranks * len(own))


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predicted(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for part in slices(batches):
            found = [known.nearest(text) for text in strings(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], schema=_PREDICTED)

    return run


def language_report(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Learns from text and lang of rows whose crc32(doc_id as text) mod 5 is not 0. score is 1 where the text's ranking is
    the profile itself and 0 where it shares nothing with it. Texts that are null or have no letter are `und` with score
    0, and so is every text where nothing could be learned. Rows without an id teach nothing and are not held out.
    Repeated rows each count and each get a row, equal texts the same prediction. An empty table gives an empty one;
    other columns are ignored. Texts are counted whole, a window of letters at a time.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    learned = Profiles(profiles(docs.where(fold != 0), ranks).collect(), ranks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_predicted(spark.sparkContext.broadcast(learned)), "doc_id long, held_out boolean, lang_pred string, score double")
