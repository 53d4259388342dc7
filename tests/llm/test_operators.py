"""Each corpus operator on small tables with nulls, empty texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import fingerprints, jaccard_join, line_dedup, lm_scoring, media, mixing, packing, substring_dedup, token_counts, toxicity
from loomgraph.llm.registry import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
WORDS = ["alpha", "beta", "gamma", "delta", "Über", "epsilon", "zeta", "eta", "iota", "kappa"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def corpus():
    """Texts with copies, near copies, shared lines and passages, nulls, empty and one-word texts."""
    rng = random.Random(7)
    base = prose(rng, 120)
    near = base.split()
    near[3] = "changed"
    shared = "a line that many documents have in common"
    texts = [base, base, " ".join(near), prose(rng, 300), "", None, "word", "two words", prose(rng, 40) + "\n" + shared, "x\n  " + shared.upper() + "\t\n" + prose(rng, 30), shared + "\n" + shared, prose(rng, 50) + " " + base[:400], "<|endoftext|> in a text", "é ß 東京   end"]
    return [(k, t, "en", f"s{k % 3}", len(t or ""), 0.5) for k, t in enumerate(texts)] + [(0, base, "en", "s0", 1, 0.5), (None, "no id at all", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_join(spark, docs, none):
    found = [r for r in jaccard_join.link_components(docs).collect()]
    assert len(found) == docs.count()
    by_id = defaultdict(set)
    for r in corpus():
        if r[0] is not None:
            by_id[r[0]] |= shingles(r[1])
    label = {k: k for k in by_id}
    for _ in by_id:
        for a in by_id:
            for b in by_id:
                x, y = by_id[a], by_id[b]
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    for r in found:
        assert r.component_id == (label[r.doc_id] if r.doc_id is not None else None)
        if r.doc_id is not None:
            assert r.n_shingles == len(by_id[r.doc_id])
    assert jaccard_join.link_components(none).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None} | {k for k in by_id if label[k] == k}


def components(rows):
    """Brute force: the smallest id that links lead to."""
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a == b or (x and y and 4 * len(x & y) >= 3 * len(x | y)):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}


def test_jaccard_join_of_repeated_ids(spark):
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(5, a), (5, b), (3, b), (9, a), (7, None), (7, ""), (8, prose(rng, 20))]
    found = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3), (5, 3), (5, 3), (7, 7), (7, 7), (8, 8), (9, 3)]


def test_jaccard_join_of_a_large_group(spark):
    """Some hundred versions of one text about as alike as the limit, another such group that shares a passage with it, and chains."""
    rng = random.Random(11)

    def edited(text, share):
        return " ".join(f"w{rng.randint(0, 10**6)}" if rng.random() < share else w for w in text.split())

    a, b = prose(rng, 150), prose(rng, 150)
    b = b + " " + a[-300:]
    texts = [edited(a, 0.025) for _ in range(120)] + [edited(b, 0.03) for _ in range(120)]
    for _ in range(40):
        texts.append(edited(texts[-1], 0.02))
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    found = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r.doc_id: r.component_id for r in found.collect()} == components(rows)


def test_shingles_of_long_texts(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "bb", "Ccc", "x" * 40, "é"]) for _ in range(300)) + rng.choice(["", " ", "\n"]) for _ in range(20)] + ["y" * 500, " " * 300, "z" * 64, "z" * 64 + " " + "q" * 64]
    whole = [next(jaccard_join.shingle_sets(pa.array([t]))) for t in texts]
    monkeypatch.setattr(jaccard_join, "WINDOW", 64)
    for t, own in zip(texts, whole, strict=True):
        assert np.array_equal(next(jaccard_join.shingle_sets(pa.array([t]))), own) and len(own) == len(shingles(t))


def test_prefixes_of_linked_sets_meet():
    class Levels:
        value = np.zeros(jaccard_join.COUNTERS, np.uint8)

    orders, rng = jaccard_join.Orders(Levels), np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(4, 60))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(np.ceil(0.9 * len(x)))], rng.integers(0, 2**63, 1).astype(np.uint64)]))
        if 4 * len(np.intersect1d(x, y)) >= 3 * len(np.union1d(x, y)):
            for k in (1, 2, 3):
                assert len(np.intersect1d(orders.prefix(x, k), orders.prefix(y, k)))


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path, 100).collect())
    wanted = Counter()
    for r in corpus():
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        wanted[r[0], len((r[1] or "").encode()), n, n > 100] += 1
    assert found == wanted
    assert token_counts.token_counts(none, path).count() == 0


def test_token_counts_of_odd_texts():
    from tokenizers import Tokenizer

    path, rng = tokenizer_file("byte_bpe_50k.json"), random.Random(3)
    texts = ["".join(rng.choice("ab'sS tT\n\t 12.,!éß \r  ll ") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert token_counts.counter(path, {})(texts) == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_texts_of_any_characters_as_the_library_gives_them():
    from tokenizers import Tokenizer

    rng = random.Random(21)
    atoms = ["word", "Ünder", "“quoted”", "東京", "Привет", "e\u0301", "\u0301", "ſ", "İi", "ΣΑΣ", "a\u00a0b", "\u2003", "\u200b", "\u0085", "don't", "’s", "12", "٣٤", "🙂", "—", "...", "\x1c", "x" * 90]
    gaps = [" ", " ", " ", "  ", "\n", " \n ", "\t", "", "\u3000", "\r\n"]
    texts = ["".join(rng.choice(atoms) + rng.choice(gaps) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert token_counts.Encoder.of(path, "counts").cut
    assert token_counts.counter(path, {})(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    path = tokenizer_file("word_bpe_49k.json")
    library, encode = Tokenizer.from_file(path), packing.IdEncoder(path)
    assert encode.cut
    for t, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    other = token_counts.Encoder(path)
    assert not other.cut  # another split: whole texts go to the library


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path).collect()
    bins = defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append(p)
    for own in bins.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and len(own) <= packing.SEGMENTS
    wanted = Counter()
    for r in corpus():
        if r[0] != 0:
            wanted[r[0]] += len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1
    lengths = Counter()
    for p in pieces:
        if p.doc_id != 0:
            lengths[p.doc_id] += p.length
    assert lengths == wanted
    one = [p for p in pieces if p.doc_id == 7]
    ids = np.array([*library.encode("two words", add_special_tokens=False).ids, 2], "<u4")
    assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in one)
    assert packing.pack(none, path).count() == 0


def test_packer_limits():
    rng = random.Random(5)
    packer = packing.Packer((100, 4, 60), window=50)
    sizes = [(k, rng.randint(1, 250)) for k in range(400)]
    for k, n in sizes:
        packer.add(k, n, rng.randint(0, n))
    packer.finish()
    got = Counter()
    for own in packer.done:
        assert sum(p[2] for p in own) <= 100 and sum(p[3] for p in own) <= 60
        for p in own:
            got[p[0]] += p[2]
    assert got == dict(sizes)


def test_bins_that_loss_leaves_short():
    """Prompts fill what the limit on loss leaves; without any, bins stay short and are not cut into fragments."""
    for prompt, least in ((0.1, 0.0), (0.0, 0.1)):
        packer = packing.Packer((1000, 64, 900), window=100)
        for k in range(600):
            packer.add(k, 100, 100 - int(100 * prompt))
        packer.finish()
        totals = [sum(p[2] for p in own) for own in packer.done]
        assert sum(totals) == 60_000
        assert len(totals) <= max(60_000 / 1000, 600 * (100 - int(100 * prompt)) / 900) + 7
        assert sum(t < 900 for t in totals) <= 7 and all(1 - t / 1000 <= least + 1e-9 for t in totals if t & (t - 1))


def test_media_round_trip(docs, none):
    rng = np.random.default_rng(2)
    payloads = [bytes(rng.integers(0, 256, 64 * int(n), dtype=np.uint8)) for n in (1, 2, 63, 64, 65, 300)] + [b"\xff" * 640, bytes(128)]
    assert [d[0] for d in media.decode(media.encode(payloads))] == payloads
    for r in media.media_report(docs).collect():
        texts = [(t or "").encode() for k, t, *_ in corpus() if k == r.doc_id]
        p = media.padded(texts[0])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[0]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert media.media_report(none).count() == 0


def other_jpeg(planes, factors, quant, restart=0, with_tables=True):
    """A baseline encoder with the standard tables: planes of whole blocks, in MCUs of the given sampling factors."""
    from loomgraph.llm import jpeg

    inverse = [{s: (n, c) for (n, c), s in jpeg.codes(*t).items()} for t in (jpeg.DC_LUMA, jpeg.AC_LUMA, jpeg.DC_CHROMA, jpeg.AC_CHROMA)]
    bits, out, last = "", b"", [0] * len(planes)

    def size_bits(v):
        n = abs(v).bit_length()
        return n, format(v if v >= 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def flushed():
        return int(bits.ljust(-(-len(bits) // 8) * 8, "1") or "0", 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\0")

    rows, columns = planes[0].shape[0] // (8 * factors[0][1]), planes[0].shape[1] // (8 * factors[0][0])
    for unit in range(rows * columns):
        if restart and unit and unit % restart == 0:
            out += flushed() + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
            bits, last = "", [0] * len(planes)
        for k, (plane, (h, v)) in enumerate(zip(planes, factors, strict=True)):
            dc, ac = inverse[2 * (k > 0)], inverse[2 * (k > 0) + 1]
            for block in range(h * v):
                y, x = (unit // columns * v + block // h) * 8, (unit % columns * h + block % h) * 8
                # The basis is orthonormal, so its transpose takes pixels to coefficients.
                c = np.rint((plane[y : y + 8, x : x + 8].reshape(64) - 128.0) @ media.BASIS.T / quant).astype(int).tolist()
                n, b = size_bits(c[0] - last[k])
                last[k] = c[0]
                bits += format(dc[n][1], f"0{dc[n][0]}b") + b
                run = 0
                for j in range(1, 64):
                    if not any(c[j:]):
                        bits += format(ac[0][1], f"0{ac[0][0]}b")
                        break
                    if not c[j]:
                        run += 1
                        continue
                    while run > 15:
                        bits += format(ac[0xF0][1], f"0{ac[0xF0][0]}b")
                        run -= 16
                    n, b = size_bits(c[j])
                    bits += format(ac[run << 4 | n][1], f"0{ac[run << 4 | n][0]}b") + b
                    run = 0
    out += flushed()
    seg = media._segment
    head = b"\xff\xd8" + seg(0xE0, b"AVI1") + seg(0xDB, b"\0" + bytes(quant.astype(np.uint8)))
    if with_tables:
        for name, t in ((0, jpeg.DC_LUMA), (0x10, jpeg.AC_LUMA), (1, jpeg.DC_CHROMA), (0x11, jpeg.AC_CHROMA)):
            head += seg(0xC4, bytes([name]) + t[0] + t[1])
    height, width = planes[0].shape
    head += seg(0xC0, bytes([8, height >> 8, height & 255, width >> 8, width & 255, len(planes)]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(factors)))
    if restart:
        head += seg(0xDD, bytes([0, restart]))
    return head + seg(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, 0x11 * (k > 0)]) for k in range(len(planes))) + bytes([0, 63, 0])) + out + b"\xff\xd9"


def test_frames_of_another_writer(spark):
    from loomgraph.llm import jpeg

    assert all(sum(t[0]) == len(t[1]) == len(set(t[1])) for t in (jpeg.DC_LUMA, jpeg.DC_CHROMA, jpeg.AC_LUMA, jpeg.AC_CHROMA))
    rng = np.random.default_rng(4)
    y, x = np.mgrid[0:32, 0:48]
    plane = np.clip(128 + 90 * np.sin(x / 7) * np.cos(y / 5) + rng.normal(0, 6, (32, 48)), 0, 255)
    quant = np.concatenate([[3], np.full(63, 2)]).astype(float)
    chroma = [np.full((16, 24), 90.0), np.full((16, 24), 160.0) + rng.normal(0, 3, (16, 24))]
    colour = [plane, *chroma], [(2, 2), (1, 1), (1, 1)]
    for planes, factors, restart, tables in (([plane], [(1, 1)], 0, True), (*colour, 0, True), (*colour, 0, False), (*colour, 2, True)):
        got = jpeg.luma(other_jpeg(planes, factors, quant, restart, tables), media.BASIS)
        assert got.shape == plane.shape and np.abs(got - plane).max() < 12 and np.abs(got - plane).mean() < 2
    dark, light = plane / 4, 255 - plane / 4
    frames = [other_jpeg([p, *chroma], colour[1], quant) for p in [dark] * 4 + [light] * 3]
    rows = [(1, bytearray(media.avi_file(frames, 48, 32, -1))), (2, bytearray(media.encode([bytes(64)])[0])), (3, None)]
    clips = media.clips(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert sorted((c.doc_id, c.first_frame, c.n_frames) for c in clips) == [(1, 0, 4), (1, 4, 3), (2, 0, 1)]
    with pytest.raises(ValueError):
        jpeg.luma(b"\xff\xd8\xff\xc2\x00\x04\x08\x00", media.BASIS)


def test_shots():
    flat, other = np.eye(16)[0], np.eye(16)[9]
    assert media.shots(np.array([flat] * 5 + [other] * 4 + [flat])) == [(0, 5), (5, 4), (9, 1)]
    assert media.shots(np.array([flat])) == [(0, 1)]


def test_clips(docs):
    clips = media.clips(media.encode_files(docs)).collect()
    spans = defaultdict(list)
    for c in clips:
        spans[c.doc_id].append((c.clip, c.first_frame, c.n_frames))
    assert set(spans) == {r[0] for r in corpus()}


def test_lm_scores(docs, none):
    found = lm_scoring.lm_scores(docs).collect()
    assert len(found) == len(corpus())
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 10 == 0
    counts = Counter()
    for r in corpus():
        if not held(r[0]):
            counts.update([*(r[1] or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    base = {}
    for r in corpus():
        t = [*(r[1] or "").encode().lower().split(), b""]
        base[r[0]] = len(t), sum(counts[w] > 0 for w in t), sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
    for r in found:
        tokens, known, score = base[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), tokens, known, n)
        assert abs(r.base_score - score) < 1e-6 and r.score < 0
    assert lm_scoring.lm_scores(none).count() == 0


class PlainTree:
    """A suffix tree by its definition, with dictionaries, from sequences of symbols and their probabilities without context."""

    def __init__(self, sequences, first, least, gain):
        self.first, self.seen, self.kept, self.stays = first, defaultdict(Counter), {}, {}
        for seq in sequences:
            for at, symbol in enumerate(seq):
                for context in self.contexts(seq, at):
                    self.seen[context][symbol] += 1
        for context in sorted(self.seen, key=len):
            counts = self.seen[context]
            kept = {x: n for x, n in counts.items() if n >= least}
            if not kept:
                continue
            n, k = sum(counts.values()), len(counts)
            below = {x: self.p(context[1:], x) for x in kept}
            left, left_below = n - sum(kept.values()), 1 - sum(below.values())
            divergence = sum(c * np.log(c / n / below[x]) for x, c in kept.items()) + (left * np.log(left / n / left_below) if left else 0)
            if divergence >= gain * len(kept):
                self.kept[context] = {x: (c + k * below[x]) / (n + k) for x, c in kept.items()}
                self.stays[context] = max(1e-12, 1 - sum(self.kept[context].values())) / max(1e-12, left_below)

    @staticmethod
    def contexts(seq, at):
        before = ["start", *seq[:at]]
        return [tuple(before[-d:]) for d in range(1, min(lm_scoring.DEPTH, len(before)) + 1)]

    def p(self, context, symbol):
        if not context:
            return self.first[symbol]
        below = self.p(context[1:], symbol)
        if context not in self.kept:
            return below
        return self.kept[context].get(symbol, self.stays[context] * below)

    def score(self, seq):
        return sum(np.log10(self.p((self.contexts(seq, at) or [()])[-1], x)) for at, x in enumerate(seq))


def plain_tree_scores(rows, least, gain, frequent):
    """The model by its definition: score by id."""
    held = lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    words = {k: [*(t or "").encode().lower().split(), b""] for k, t in rows}
    counts = Counter(w for k in words if not held(k) for w in words[k])
    total = sum(counts.values())
    often = {w: n for w, n in counts.items() if n >= max(2, frequent * total)}
    rare = {w: n for w, n in counts.items() if w not in often}
    n_rare, kinds = sum(rare.values()), max(1, len(rare))
    symbols = {k: [w if w in often else None for w in x] for k, x in words.items()}
    tree = PlainTree([x for k, x in symbols.items() if not held(k)], {None: (n_rare + 1) / (total + 1), **{w: n / (total + 1) for w, n in often.items()}}, max(2, least * total), gain)
    spell = lambda w: [*w, 256]
    letters = Counter(x for w in rare for x in spell(w))
    size = sum(letters.values())
    spelling = PlainTree([spell(w) for w in rare], {x: (letters[x] + 1) / (size + 257) for x in range(257)}, max(2, least * size), gain)
    scores = {}
    for k, x in words.items():
        new = [w for w in x if w not in often]
        scores[k] = tree.score(symbols[k]) + sum(np.log10(rare.get(w, kinds) / (n_rare + kinds)) + (0 if w in rare else spelling.score(spell(w))) for w in new)
    return scores


def test_scores_are_those_of_the_tree(spark):
    rng = random.Random(17)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate([*texts, *texts[:5], "", None, "never seen words", "\u00e9t\u00e9 \u6f22\u5b57"])]
    for least, gain, frequent in ((1e-6, 0.5, 1e-6), (2e-3, 1.0, 4e-3)):
        found = {r.doc_id: r.score for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least, gain, frequent).collect()}
        wanted = plain_tree_scores(rows, least, gain, frequent)
        assert all(abs(found[k] - wanted[k]) < 1e-6 * (1 + abs(wanted[k])) for k in wanted), max((abs(found[k] - wanted[k]), k) for k in wanted)


def test_suffix_tree_is_a_distribution():
    rng = random.Random(5)
    seq = [rng.choice("aab" if k % 3 else "bcd") for k in range(400)]
    tree = PlainTree([seq], {x: 0.25 for x in "abcd"}, 2, 0.5)
    assert len({len(c) for c in tree.kept}) > 1
    assert all(abs(sum(tree.p(c, x) for x in "abcd") - 1) < 1e-9 for c in tree.seen)


def test_words_of_long_texts():
    text = b"one  Two\tthree\x0bfour " * 50 + b"x" * 300 + b"\xc2\xa0y z"
    whole = text.lower().split()
    lm_scoring.STRETCH, kept = 40, lm_scoring.STRETCH
    try:
        assert [w for part in lm_scoring.words_of(text) for w in part] == whole
    finally:
        lm_scoring.STRETCH = kept
    assert list(lm_scoring.words_of(b"")) == []


@pytest.fixture(scope="module")
def clashing(docs):
    """The same rows with columns named like what operators use inside or return."""
    names = ["cdf", "draws", "rate_source", "source_", "rated", "salt", "row", "id", "line_numbers", "line_numbers_", "score_own", "held_out", "predicted", "predicted_", "token", "rep", "digest", "component_id", "n_shingles", "sequence_id", "length", "offset"]
    return docs.selectExpr("*", *(f"doc_id + {k} AS {x}" for k, x in enumerate(names)))


def test_clashing_names(spark, docs, clashing, none):
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(14)], "doc_id long, toxic int")
    path = tokenizer_file("word_bpe_49k.json")
    sent = sorted(map(str, clashing.collect()))
    mixing_rows = mixing.mixed(clashing)
    assert mixing_rows.columns == [*clashing.columns, "n_copies", "copy", "mix_key"]
    assert set(map(str, mixing_rows.select(*clashing.columns).collect())) <= set(sent)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.copy) for r in mixing_rows.collect()) == sorted((r.doc_id is None, r.doc_id or 0, r.copy) for r in mixing.mixed(docs).collect())
    lines = line_dedup.without_repeated_lines(clashing)
    assert lines.columns == clashing.columns and sorted(map(str, lines.select(*docs.columns).collect())) == sorted(map(str, line_dedup.without_repeated_lines(docs).collect()))
    clean = toxicity.without_toxic(clashing, labels)
    assert clean.columns == clashing.columns and set(map(str, clean.collect())) <= set(sent)
    kept = jaccard_join.one_of_each(clashing)
    assert kept.columns == clashing.columns and set(map(str, kept.collect())) <= set(sent)
    assert packing.pack(clashing, path).columns == packing.pack(docs, path).columns
    for empty in (line_dedup.without_repeated_lines(none), toxicity.without_toxic(none, labels), jaccard_join.one_of_each(none)):
        assert empty.columns == none.columns and not empty.count()


def test_mixing_over_salts(monkeypatch, docs):
    few = sorted((str(r.doc_id), r.copy) for r in mixing.mixed(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((str(r.doc_id), r.copy) for r in mixing.mixed(docs).collect()) == few


def test_loss_limit_binds():
    """Prompts bear no loss: with that limit, bins hold other pieces than by tokens alone, and none is over it."""
    rng = random.Random(8)
    sizes = {k: (n := rng.randint(5, 90), rng.choice([0, n // 3, n])) for k in range(500)}
    bins = {}
    for name, limits in (("loss", (100, 8, 60)), ("tokens", (100, 8, 100))):
        packer = packing.Packer(limits, window=64)
        for k, (n, loss) in sizes.items():
            packer.add(k, n, loss)
        packer.finish()
        bins[name] = packer.done
        for own in packer.done:
            total = sum(p[2] for p in own)
            assert len(own) <= 8 and sum(p[3] for p in own) <= limits[2] and (total == 100 or len(own) == 8 or total & (total - 1) == 0)
        got = Counter()
        for own in packer.done:
            for p in own:
                got[p[0]] += p[2]
        assert got == {k: n for k, (n, _) in sizes.items()}
    assert any(sum(p[3] for p in own) > 60 for own in bins["tokens"])


def test_prompts_bear_no_loss(docs):
    path = tokenizer_file("word_bpe_49k.json")
    encode = packing.IdEncoder(path)
    texts = ["first line\nand the rest of it", "only one line", "", "\nno prompt", "Ünïcode “quoted”\nrest — here"]
    for t, (ids, prompt) in zip(texts, encode.with_prompts(texts, "\n"), strict=True):
        assert ids == encode([t])[0] and prompt * 4 == len(encode([t.split("\n")[0]])[0] if "\n" in t else b"")
    pieces = packing.pack(docs, path).collect()
    per, loss = defaultdict(int), defaultdict(int)
    for p in pieces:
        per[p.sequence_id] += p.loss_tokens
        loss[p.doc_id] += p.loss_tokens
    assert max(per.values()) <= packing.LOSS_TOKENS
    text = next(t for k, t, *_ in corpus() if k == 8)
    assert loss[8] == len(encode([text.split("\n", 1)[1]])[0]) // 4 + 1


def test_mixing_is_native(docs):
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup(docs, none):
    holders = defaultdict(set)
    strip = b" \t\n\x0b\x0c\r"
    key = lambda line: line.strip(strip).lower()
    for r in corpus():
        if r[0] is not None:
            for line in (r[1] or "").encode().split(b"\n"):
                if len(key(line).decode()) >= 20:
                    holders[key(line)].add(r[0])
    wanted = Counter()
    for r in corpus():
        lines = (r[1] or "").encode().split(b"\n")
        stay = [x for x in lines if r[0] is None or len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == r[0]]
        wanted[r[0], len(lines), len(lines) - len(stay), hashlib.sha256(b"\n".join(stay)).hexdigest()] += 1
    assert Counter(tuple(r) for r in line_dedup.line_report(docs).collect()) == wanted
    assert any(k[2] for k in wanted)
    assert line_dedup.line_report(none).count() == 0
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() and kept.where("text IS NULL").count() == 1


def brute_spans(texts):
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("many", [2000, 0])
def test_substring_dedup(spark, none, monkeypatch, many):
    monkeypatch.setattr(substring_dedup, "MANY", many)
    rng = random.Random(11)
    passage = prose(rng, 60)
    texts = [t or "" for _, t, *_ in corpus()[:14]] + ["ab" * 300, "a" * 199, "a" * 200, "a" * 201] + [prose(rng, 20) + passage + prose(rng, 20) for _ in range(6)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {r.doc_id: tuple(r)[1:] for r in substring_dedup.substring_report(docs).collect()}
    assert found == dict(enumerate(brute_spans([t.encode() for t in texts])))
    assert substring_dedup.substring_report(none).count() == 0


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        s = np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 50))], np.int64)
        assert substring_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda k: s[k:].tolist())


def test_fingerprints(docs, none):
    found = fingerprints.fingerprint_report(docs).collect()
    order = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    wanted = Counter()
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        wanted[r[0], len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == wanted
    prints = defaultdict(set)
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints[next(t or "" for k, t, *_ in corpus() if k == r.doc_id)].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    copy = next(r for r in found if r.doc_id == 0)
    assert copy.near_next == 1.0
    assert fingerprints.fingerprint_report(none).count() == 0


def test_peeling_recovers_the_difference(spark):
    from pyspark.sql import functions as F

    lines = [f"line number {k} of this text" for k in range(60)]
    other = lines[:50] + [f"another line {k}" for k in range(10)]
    docs = spark.createDataFrame([(0, "\n".join(lines)), (1, "\n".join(other))], "doc_id long, text string")
    near = {r.doc_id: r.near_next for r in fingerprints.fingerprint_report(docs).select("doc_id", F.col("near_next")).collect()}
    assert near[0] == near[1] and abs(near[0] - (1 - 20 / 120)) < 0.03


def test_digests_are_recovered_whatever_differs(spark):
    from pyspark.sql import functions as F

    texts = ["\n".join(f"{name} {k}" for k in range(n)) for name, n in (("one", 900), ("two", 700), ("three", 5))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r.doc_id: set(r.keys) for r in docs.select("doc_id", fingerprints.paragraph_keys(F.col("text")).alias("keys")).collect()}
    for r in fingerprints.fingerprint_report(docs).collect():
        a, b = keys[r.doc_id], keys[(r.doc_id + 1) % 3]
        assert sorted((x.digest, x.version) for x in r.next_digests) == sorted([(k, 0) for k in a - b] + [(k, 1) for k in b - a])
        assert r.near_next == 1 - len(a ^ b) / (len(a) + len(b))


def test_an_inserted_character_changes_one_paragraph(spark):
    rng = random.Random(9)
    texts = [". ".join(prose(rng, 9) for _ in range(30)), prose(rng, 400), "\n".join(prose(rng, 12) for _ in range(40))]
    pairs = [(text, text[:at] + "Z" + text[at:]) for text in texts for at in (0, len(text) // 2)]
    rows = [(2 * k + j, pair[j]) for k, pair in enumerate(pairs) for j in (0, 1)]
    found = fingerprints.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 2 = 0").collect()
    assert len(found) == len(pairs) and all(r.n_chars > 2000 and r.near_next >= 0.9 for r in found)


def test_paragraphs_do_not_depend_on_the_length(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    for limit in (1024, 4096, 16384):
        shorter = ". ".join(prose(rng, 9) for _ in range(limit))[: limit - 20]
        longer = shorter + " and then forty more characters at the end"
        keys = spark.createDataFrame([(0, shorter), (1, longer)], "id int, text string").select("id", fingerprints.paragraph_keys(F.col("text")).alias("keys"))
        a, b = (set(r.keys) for r in keys.orderBy("id").collect())
        assert len(a & b) >= len(a) - 1


def toxic_table(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for k in range(600):
        bad = k % 6 == 0
        text = prose(rng, 30) + (" what an idiot and moron " if bad else " ") + prose(rng, 30)
        rows.append((k, text))
        labels.append((k, int(bad)))
    plain = [(1000, prose(rng, 40)), (1001, "you 1d10t there"), (1002, "an i d i o t here"), (1003, "such a m0r0n"), (1004, None), (1005, "idiiiiot")]
    docs = spark.createDataFrame(rows + plain + [(None, "")], "doc_id long, text string").withColumnRenamed("x", "x")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, none):
    docs, labels = toxic_table(spark)
    found = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(found[k].held_out for k in held)
    assert sum(found[k].predicted == truth[k] for k in held) / len(held) > 0.98
    assert [found[k].predicted for k in (1000, 1001, 1002, 1003, 1004, 1005)] == [0, 1, 1, 1, 0, 1]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())
    assert toxicity.toxicity_scores(none, labels).count() == 0
    kept = toxicity.without_toxic(docs.withColumn("score", docs.doc_id), labels)
    assert kept.columns == ["doc_id", "text", "score"] and 1001 not in {r.doc_id for r in kept.collect()}


def test_long_and_spaced_disguises_are_restored(spark):
    docs, labels = toxic_table(spark)
    plain = spark.createDataFrame([(2000 + k, "you are an idiot and you are a moron") for k in range(300)], "doc_id long, text string")
    odd = ["you " + 50 * "i" + "diot there", "i - d - i - o - t", "so y o u a r e a n i d i o t there"]
    rows = spark.createDataFrame([(1100 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    found = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs.union(plain).union(rows), labels).collect()}
    assert [found[1100 + k] for k in range(3)] == [1, 1, 1]


def test_words_are_hashed_as_bytes():
    texts = ["a b c d e f", "A  B c\td e F", " x y ", "", None, "é ß z q w e"]
    assert [len(s) for s in jaccard_join.shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]
