"""Media columns: AVI files of motion-JPEG frames, their decoding, and shots as timed clip rows.

The writer stores 8-bit samples losslessly as the format's own unit, quantised DCT coefficients: a block of 64 samples
is the 64 coefficients (sample + 1) in zigzag order, with quantisation by 1. Its Huffman tables give every coefficient
ten bits, code and magnitude together, so a block is 80 bytes and whole batches are coded by array operations. The files
are plain baseline JPEG frames in a plain AVI with an index. The reader follows the RIFF index, decodes the frames'
coefficients and pixels (its own frames by array operations, those of other writers by loomgraph.llm.jpeg), and cuts
shots where the histogram difference of two frames stands out from those before it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm.arrow_tools import slices, strings
from loomgraph.llm.jpeg import luma

BLOCK, CODED, FRAME_BLOCKS, RATE = 64, 80, 64, 25
BINS = 16
#: A cut: a difference over the mean of the last WINDOW ones in its shot by so many deviations, and over a floor.
WINDOW, DEVIATIONS, FLOOR = 8, 3.0, 0.15


def _zigzag() -> list[int]:
    """Raster places of the 64 coefficients in zigzag order."""
    return [8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))]


def _basis() -> np.ndarray:
    """The matrix that turns coefficients in zigzag order into the pixels of a block, before the shift by 128."""
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    d = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.einsum("ur,vc->uvrc", d, d).reshape(64, 64)[_zigzag()].astype(np.float32)


def _word(value: int) -> int:
    """Ten bits: the code of the magnitude's size (10 - size ones, the last a zero), then the magnitude bits."""
    size = abs(value).bit_length()
    return ((1 << (10 - size)) - 2) << size | (value if value >= 0 else value + (1 << size) - 1)


BASIS = _basis()
AC_WORDS = np.array([_word(b + 1) for b in range(256)], np.uint64)
DC_WORDS = np.array([_word(d) for d in range(-256, 257)], np.uint64)
VALUES = np.zeros(1024, np.int32)
for _v in range(-511, 512):
    VALUES[_word(_v)] = _v


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _tables() -> bytes:
    """Quantisation by 1 and the two Huffman tables: a code of 10 - s bits for size s."""
    dc = bytes([1] * 10 + [0] * 6) + bytes(reversed(range(10)))
    ac = bytes([1] * 9 + [0] * 7) + bytes(reversed(range(1, 10)))
    return _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\0" + dc) + _segment(0xC4, b"\x10" + ac)


TABLES = _tables()


def jpeg_frame(coded: bytes, width: int, height: int) -> bytes:
    """A baseline grey JPEG around entropy-coded data."""
    head = _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
    return b"\xff\xd8" + TABLES + head + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + coded.replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi_file(frames: list[bytes], width: int, height: int, samples: int) -> bytes:
    """An AVI of one motion-JPEG stream; the number of stored samples is its comment."""
    n = len(frames)
    avih = struct.pack("<10I4I", 1_000_000 // RATE, 0, 0, 0x10, n, 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, 1, RATE, 0, n, 0, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"%d\0" % samples))
    chunks = [_chunk(b"00dc", f) for f in frames]
    at, index = 4, []
    for f, c in zip(frames, chunks, strict=True):
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(c)
    movi = _chunk(b"LIST", b"movi" + b"".join(chunks))
    return _chunk(b"RIFF", b"AVI " + hdrl + info + movi + _chunk(b"idx1", b"".join(index)))


def encode(payloads: list[bytes]) -> list[bytes]:
    """One AVI for each payload; a payload's length is a positive multiple of 64."""
    if not payloads:
        return []
    if any(not p or len(p) % BLOCK for p in payloads):
        raise ValueError("a payload is a positive multiple of 64 samples")
    blocks = np.array([len(p) // BLOCK for p in payloads])
    shape = np.minimum(blocks, FRAME_BLOCKS)
    frames = -(-blocks // shape)
    data = np.frombuffer(b"".join(p + bytes(BLOCK * int(f * s - b)) for p, f, s, b in zip(payloads, frames, shape, blocks, strict=True)), np.uint8).reshape(-1, BLOCK)
    words = AC_WORDS[data]
    level = data[:, 0].astype(np.int32) + 1
    before = np.concatenate([[0], level[:-1]])
    starts = np.concatenate([[0], np.cumsum(np.repeat(shape, frames))])
    before[starts[:-1]] = 0
    words[:, 0] = DC_WORDS[level - before + 256]
    four = words.reshape(-1, 4)
    joined = four[:, 0] << np.uint64(30) | four[:, 1] << np.uint64(20) | four[:, 2] << np.uint64(10) | four[:, 3]
    coded = joined.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    out, k = [], 0
    for payload, f, s in zip(payloads, frames.tolist(), shape.tolist(), strict=True):
        width, height = (8 * s, 8) if s < FRAME_BLOCKS else (64, 64)
        out.append(avi_file([jpeg_frame(coded[CODED * (k + j * s) : CODED * (k + (j + 1) * s)], width, height) for j in range(f)], width, height, len(payload)))
        k += f * s
    return out


def indexed_frames(avi: bytes) -> tuple[list[bytes], float, int]:
    """The frames that the file's index names, in order, its frame rate, and the number of samples in its comment (or -1)."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, entries, rate, samples = 0, b"", float(RATE), -1
    stack = [(12, min(len(avi), 8 + struct.unpack_from("<I", avi, 4)[0]))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
            if name == b"LIST":
                kind = avi[at + 8 : at + 12]
                if kind == b"movi":
                    movi = at + 8
                else:
                    stack.append((at + 12, at + 8 + size))
            elif name == b"strh":
                scale, per = struct.unpack_from("<II", avi, at + 28)
                rate = per / scale if scale else rate
            elif name == b"ICMT":
                text = avi[at + 8 : at + 8 + size].rstrip(b"\0")
                samples = int(text) if text.isdigit() else -1
            elif name == b"idx1":
                entries = avi[at + 8 : at + 8 + size]
            at += 8 + size + (size & 1)
    if not movi or not entries:
        raise ValueError("the AVI has no frames or no index")
    rows = [struct.unpack_from("<4sIII", entries, k) for k in range(0, len(entries), 16)]
    rows = [r for r in rows if r[0][2:] in (b"dc", b"db")]
    base = movi if avi[movi + rows[0][2] : movi + rows[0][2] + 4] == rows[0][0] else 0
    return [avi[base + at + 8 : base + at + 8 + size] for _, _, at, size in rows], rate, samples


def entropy_data(frame: bytes) -> tuple[bytes, int, int] | None:
    """The entropy-coded bytes of one of the writer's frames, without stuffing, and its width and height; None for any other frame."""
    at, tables, size = 2, b"", (0, 0)
    while frame[at + 1] != 0xDA:
        marker, length = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        if marker in (0xDB, 0xC4):
            tables += frame[at : at + 2 + length]
        elif marker == 0xC0:
            size = struct.unpack_from(">HH", frame, at + 5)
        at += 2 + length
        if at + 4 > len(frame):
            return None
    if tables != TABLES:
        return None
    at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    return frame[at : frame.rindex(b"\xff\xd9")].replace(b"\xff\0", b"\xff"), size[1], size[0]


def decode(files: list[bytes]) -> list[tuple[bytes, float, np.ndarray]]:
    """For each AVI its stored samples (none where another writer made its frames), its frame rate, and a luma histogram for each frame (rows sum to 1)."""
    parsed = [indexed_frames(f) for f in files]
    found = [entropy_data(f) for frames, _, _ in parsed for f in frames]
    data = [x[0] for x in found if x]
    histograms = np.zeros((len(found), BINS))
    own = np.array([x is not None for x in found], bool)
    samples, starts = b"", np.zeros(1, np.int64)
    if data:
        sizes = np.array([len(d) // CODED for d in data])
        groups = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 5).astype(np.uint64)
        joined = groups[:, 0] << np.uint64(32) | groups[:, 1] << np.uint64(24) | groups[:, 2] << np.uint64(16) | groups[:, 3] << np.uint64(8) | groups[:, 4]
        words = np.stack([joined >> np.uint64(30), joined >> np.uint64(20) & np.uint64(1023), joined >> np.uint64(10) & np.uint64(1023), joined & np.uint64(1023)], 1)
        values = VALUES[words.reshape(-1, BLOCK)]
        del groups, joined, words
        starts = np.concatenate([[0], np.cumsum(sizes)])
        total = np.cumsum(values[:, 0])
        values[:, 0] = total - np.repeat(np.where(starts[:-1] > 0, total[starts[:-1] - 1], 0), sizes)
        samples = (values - 1).astype(np.uint8).tobytes()
        pixels = np.clip(values.astype(np.float32) @ BASIS + 128, 0, 255).astype(np.uint8)
        frame_of = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.bincount((frame_of[:, None] * BINS + pixels // (256 // BINS)).ravel(), minlength=len(sizes) * BINS).reshape(-1, BINS)
        histograms[own] = counts / counts.sum(1, keepdims=True)
    every = [f for frames, _, _ in parsed for f in frames]
    for k in np.flatnonzero(~own).tolist():
        plane = luma(every[k], BASIS)
        histograms[k] = np.bincount(plane.ravel() // (256 // BINS), minlength=BINS) / plane.size
    out, k = [], 0
    before = np.concatenate([[0], np.cumsum(own)])
    for frames, rate, stored in parsed:
        end = k + len(frames)
        held = samples[BLOCK * starts[before[k]] : BLOCK * starts[before[end]]] if own[k:end].all() else b""
        out.append((held[:stored] if stored >= 0 else held, rate, histograms[k:end]))
        k = end
    return out


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, number of frames) of each shot."""
    steps = np.abs(np.diff(histograms, axis=0)).sum(1) / 2
    cuts = [0]
    for k, d in enumerate(steps.tolist()):
        past = steps[max(cuts[-1], k - WINDOW) : k]
        if d > FLOOR and (not len(past) or d > past.mean() + DEVIATIONS * past.std() + FLOOR / 2):
            cuts.append(k + 1)
    return [(a, b - a) for a, b in zip(cuts, [*cuts[1:], len(histograms)], strict=True)]


def padded(text: bytes) -> bytes:
    """A text's bytes, with zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


FILES = "doc_id long, media binary"
CLIPS = "doc_id long, clip int, first_frame int, n_frames int, start_s double, end_s double, luma double"


def encode_files(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text (null: empty) as an AVI."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "media": encode([padded(t) for t in strings(part.column("text"))])}, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, FILES)


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of (doc_id, media) rows of any writer's baseline frames.

    A null file has none, and one that is no motion-JPEG AVI, or holds frames that are not baseline, raises an error.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("luma", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = (np.arange(BINS) + 0.5) * 256 / BINS
        for part in slices(batches, "media", 1 << 20):
            rows = []
            pairs = [x for x in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist(), strict=True) if x[1] is not None]
            for (doc_id, _), (_, rate, histograms) in zip(pairs, decode([f for _, f in pairs]), strict=True):
                for k, (a, n) in enumerate(shots(histograms)):
                    rows.append((doc_id, k, a, n, a / rate, (a + n) / rate, float(histograms[a : a + n].mean(0) @ middle)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return media.select("doc_id", "media").mapInArrow(run, CLIPS)


REPORT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_REPORT = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in REPORT.split(", ")])


def media_report(docs: DataFrame) -> DataFrame:
    """Per document: sizes and digests of its AVI and of the samples read back from it, and its shots as a string.

    Null and empty texts are 64 zero bytes. Equal texts give equal values; repeated rows each get a row; an empty table
    gives an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            texts = strings(part.column("text"))
            files = encode([padded(t) for t in texts])
            rows = []
            for doc_id, text, avi, (samples, rate, histograms) in zip(part.column("doc_id").to_pylist(), texts, files, decode(files), strict=True):
                found = shots(histograms)
                feature = f"frames={len(histograms)} rate={rate:g} shots=" + ",".join(f"{a}+{n}" for a, n in found) + " luma=" + ",".join(f"{x:.4f}" for x in histograms.mean(0))
                rows.append((doc_id, len(text), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_REPORT)], schema=_REPORT)

    return docs.select("doc_id", "text").mapInArrow(run, REPORT)
