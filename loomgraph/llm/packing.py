"""Packing of documents into training sequences: vector bin packing by the dot-product heuristic.

Every sequence has limits on tokens, on segments (pieces) and on loss-bearing tokens. A map task tokenizes its rows and
packs them as they come, so no token is shuffled and a task holds a bounded window of pieces: long documents fill whole
sequences, and the rest goes where the dot product of what it needs and what a bin has left is largest. A bin that
nothing fits is filled by cutting pieces, loss-free tokens where the limit on loss is reached; a bin that a limit still
leaves short is padded. Only a task's last bin is cut into lengths that need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomgraph.llm.arrow_tools import slices
from loomgraph.llm.token_counts import NOT_PLAIN, Encoder
from loomgraph.session import bounded_batches

TOKENS, SEGMENTS, LOSS_TOKENS = 4096, 256, 3840
#: Pieces that wait in a task, and bins that it fills side by side.
WINDOW, OPEN_BINS = 1024, 16
#: Words whose ids a worker keeps.
CACHE_WORDS = 500_000

#: White space that no word of a text holds, whatever its other characters.
BLANK = re.compile(r"[ \t-\r]+")
#: How a tokenizer has to normalise and split its input for texts to be cut at white space.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: That split into words, for plain texts.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class IdEncoder:
    """Ids of texts as little-endian 32-bit bytes, by a lower-case tokenizer that drops white space."""

    def __init__(self, path: str):
        self.own = Encoder.of(path, "ids")
        steps = (self.own.parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.cut = (self.own.parts["normalizer"] or {}).get("normalizers") == NORMAL and steps[0].get("pattern") == {"Regex": SPLIT}

    def _word(self, word: str) -> bytes:
        if NOT_PLAIN.search(word):
            return np.array(self.own.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return self.own.pack_ids(word) if word.isalpha() else b"".join(map(self.own.pack_ids, WORDS.findall(word)))

    def _words(self, text: str) -> list[str] | None:
        """The words between white space (lower-case where plain), or None where the library has to take the text whole."""
        if not self.cut or self.own.special.search(text):
            return None
        if not NOT_PLAIN.search(text):
            return text.lower().split()
        return [w if NOT_PLAIN.search(w) else w.lower() for w in BLANK.split(text) if w]

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [ids for ids, _ in self.with_prompts(texts, None)]

    def with_prompts(self, texts: list[str], mark: str | None) -> list[tuple[bytes, int]]:
        """The ids of each text, and how many of them stand before the mark (a line end, or other white space); 0 without one."""
        cache = self.own.cache
        split = [self._words(t) for t in texts]
        missing = set().union(*(x for x in split if x)) - cache.keys()
        if len(cache) + len(missing) > CACHE_WORDS:
            cache.clear()
            missing = set().union(*(x for x in split if x))
        cache.update((w, self._word(w)) for w in missing)
        whole = iter(self.own.encode([t for t, x in zip(texts, split, strict=True) if x is None]))
        heads = [t[: max(0, t.find(mark))] if mark else "" for t in texts]
        apart = iter(self.own.encode([h for h, x in zip(heads, split, strict=True) if x is None]))
        out = []
        for head, x in zip(heads, split, strict=True):
            if x is None:
                out.append((np.array(next(whole).ids, "<u4").tobytes(), len(next(apart).ids)))
            else:
                prompt = sum(map(len, map(cache.__getitem__, x[: len(self._words(head))]))) // 4 if head else 0
                out.append((b"".join(map(cache.__getitem__, x)), prompt))
        return out


class Packer:
    """Places pieces (key, start, length, loss) into bins; `done` gets each finished bin as a list of pieces.

    Limits are a vector (tokens, segments, loss-bearing tokens). A piece can be cut, and its loss tokens are taken to
    be its last ones. The pieces that wait number at most `window`.
    """

    def __init__(self, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS_TOKENS), window: int = WINDOW, bins: int = OPEN_BINS):
        if min(limits) < 1:
            raise ValueError(f"each limit must be at least 1: {limits}")
        self.limits = np.array(limits, np.int64)
        self.window, self.bins = window, bins
        self.waiting: list[tuple] = []
        self.done: list[list[tuple]] = []

    def add(self, key, length: int, loss: int) -> None:
        start = 0
        while length > 0:
            take = min(length, int(self.limits[0]))
            first_loss = length - loss
            if loss and take - first_loss > self.limits[2]:
                take = first_loss + int(self.limits[2])
            here = max(0, take - first_loss)
            piece = (key, start, take, here)
            if take == self.limits[0]:
                self.done.append([piece])
            else:
                self.waiting.append(piece)
            start, length, loss = start + take, length - take, loss - here
        if len(self.waiting) >= self.window:
            self._pack(self.window // 2)

    def finish(self) -> None:
        self._pack(0)

    def _pack(self, until: int) -> None:
        """Fills bins until at most `until` pieces wait."""
        sizes = np.array([[p[2], 1, p[3]] for p in self.waiting], np.int64).reshape(-1, 3)
        free = np.ones(len(sizes), bool)
        pieces = list(self.waiting)
        while (left := int(free.sum())) > until:
            room, chosen = self.limits.copy(), []
            while True:
                fits = free & (sizes <= room).all(axis=1)
                if fits.any():
                    need = (sizes / self.limits) @ (room / self.limits)
                    k = int(np.argmax(np.where(fits, need, -1)))
                    chosen.append(pieces[k])
                    free[k] = False
                    room -= sizes[k]
                    if room[0] and room[1]:
                        continue
                elif free.any():
                    # What a cut gives: the tokens before a piece's loss, then as many with loss as are left.
                    usable = np.where(free, np.minimum(np.minimum(room[0], sizes[:, 0] - 1), sizes[:, 0] - sizes[:, 2] + room[2]), 0)
                    k = int(np.argmax(usable))
                    take = int(usable[k])
                    if take:
                        key, start, length, loss = pieces[k]
                        here = max(0, take - (length - loss))
                        chosen.append((key, start, take, here))
                        pieces[k] = (key, start + take, length - take, loss - here)
                        sizes[k] = (length - take, 1, loss - here)
                        room -= (take, 1, here)
                        if room[0] and room[1]:
                            continue
                break
            self.done.extend(self._unpadded(chosen) if not until and not free.any() else [chosen])
            if int(free.sum()) == left and not chosen:
                raise AssertionError("a bin stayed empty")
        self.waiting = [p for p, f in zip(pieces, free.tolist(), strict=True) if f]

    def _unpadded(self, chosen: list[tuple]) -> list[list[tuple]]:
        """A last, partly filled bin as sequences whose lengths are powers of two, cut so that none needs padding."""
        total = sum(p[2] for p in chosen)
        if total == self.limits[0] or total & (total - 1) == 0:
            return [chosen]
        out, rest = [], list(reversed(chosen))
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            need, own = 1 << bit, []
            while need:
                key, start, length, loss = rest.pop()
                take = min(need, length)
                here = max(0, take - (length - loss))
                own.append((key, start, take, here))
                if take < length:
                    rest.append((key, start + take, length - take, loss - here))
                need -= take
            out.append(own)
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


def _packed(path: str, end_id: int, limits: tuple[int, int, int], loss: str | None, prompt_end: str | None) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = IdEncoder(path), Packer(limits)
        end = np.array([end_id], "<u4").tobytes()
        held: dict[int, list] = {}
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        rows = 0

        def sent() -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for bin_ in packer.done:
                offset = 0
                for key, start, length, lossy in bin_:
                    doc = held[key]
                    crc = zlib.crc32(memoryview(doc[1])[4 * start : 4 * (start + length)])
                    out.append((doc[0], start, length, crc, len(doc[1]) // 4, sequence, offset, lossy))
                    offset += length
                    doc[2] -= length
                    if not doc[2]:
                        del held[key]
                sequence += 1
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(_ARROW), schema=_ARROW)

        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            share = part.column(loss).to_pylist() if loss else [None] * len(texts)
            for doc_id, (ids, prompt), bearing in zip(part.column("doc_id").to_pylist(), encode.with_prompts(texts, prompt_end), share, strict=True):
                ids += end
                n = len(ids) // 4
                held[rows] = [doc_id, ids, n]
                packer.add(rows, n, n - prompt if bearing is None else max(0, min(n, bearing)))
                rows += 1
            yield sent()
        packer.finish()
        yield sent()

    return run


def pack(
    docs: DataFrame, path: str, end_id: int = 2, tokens: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int = LOSS_TOKENS, loss_column: str | None = None, prompt_end: str | None = "\n"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A document is its ids and then `end_id`. Its last `loss_column` tokens bear loss; without that column, or where it is
    null, those after the first `prompt_end` (white space, by default a line end) do, so that its first line is a prompt;
    all do where the text or the call has none. No sequence has more than `tokens` tokens, `segments` pieces or
    `loss_tokens` loss-bearing tokens. Null and empty texts are one token. Equal rows are packed each for itself. Where
    rows share an id, so do their pieces. An empty table gives an empty one; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    columns = ["doc_id", "text", *([loss_column] if loss_column else [])]
    return docs.select(*columns).mapInArrow(_packed(path, end_id, (tokens, segments, loss_tokens), loss_column, prompt_end), PIECES)
