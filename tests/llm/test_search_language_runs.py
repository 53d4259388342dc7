"""Language identification, lexical search and periodic runs on small tables, against brute force."""

import hashlib
import math
import random
import re
import resource
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import language_id, lexical_search, periodic_runs

SCHEMA = "doc_id long, text string, lang string, source string, score double, rank int, term long"
EN = "the quick brown fox jumps over the lazy dog and then the dog thinks that this thing is not worth the trouble of running with them"
DE = "der schnelle braune Fuchs springt über den faulen Hund und dann denkt der Hund daß dieses Ding nicht die Mühe wert ist zu laufen"


def rows():
    rng = random.Random(5)
    out = []
    for k in range(60):
        words = (EN if k % 2 else DE).split()
        rng.shuffle(words)
        out.append((k, " ".join(words * (1 + k % 3)), "en" if k % 2 else "de", f"s{k % 3}", 0.5, 1, 2))
    extra = [None, "", " 12 345 !!", "a", "word " * 40, "x y z " * 30 + "end", "東京 都 東京", "é Ä", "\x00 \x7f control"]
    out += [(60 + k, t, None, None, None, None, None) for k, t in enumerate(extra)]
    return out + [(0, out[0][1], "de", "s0", 0.5, 1, 2), (None, EN, "en", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def slow_runs(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 60])) for _ in range(rng.choice([0, 1, 23, 24, 25, 70, 250]))]
    for _ in range(rng.randrange(4)):
        if len(words) > 30:
            a, p = rng.randrange(len(words)), rng.randrange(1, 12)
            for i in range(a + p, min(len(words), a + rng.randrange(1, 150))):
                words[i] = words[i - p]
    return [b"%d" % w for w in words]


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        texts = [planted(rng) for _ in range(6)]
        found = periodic_runs.runs(*periodic_runs.interned(texts))
        for k, words in enumerate(texts):
            assert [tuple(r[1:]) for r in found.tolist() if r[0] == k] == slow_runs(words)


def test_runs_of_one_repeated_word_and_of_alternating_blocks():
    word = [b"a"] * 50_000
    thue = [b"ab"[k.bit_count() % 2 :][:1] for k in range(3000)]  # no run of three periods anywhere
    found = periodic_runs.runs(*periodic_runs.interned([word, thue]))
    assert found.tolist() == [[0, 0, 50_000, 1]]


def test_runs_with_small_steps(monkeypatch):
    rng = random.Random(4)
    texts = [planted(rng) for _ in range(40)]
    whole = periodic_runs.runs(*periodic_runs.interned(texts))
    monkeypatch.setattr(periodic_runs, "PART", 7)
    assert (periodic_runs.runs(*periodic_runs.interned(texts)) == whole).all()


def test_run_report(docs, none):
    expected = []
    for i, text, *_ in rows():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        words = words if i is None else periodic_runs.repeated_tail(i, words)
        found = slow_runs(words)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        expected.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in periodic_runs.run_report(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert periodic_runs.run_report(none).count() == 0


def test_periodic_runs_and_texts_without_them(docs, none):
    found = {(r.doc_id, r.start, r.length, r.period, r.words) for r in periodic_runs.periodic_runs(docs).collect()}
    assert (64, 0, 40, 1, "word") in found and (65, 0, 90, 3, "x y z") in found
    kept = periodic_runs.without_runs(docs)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert texts[64] == "word" and texts[65] == "x y z end" and texts[60] is None and texts[66] == "東京 都 東京" and texts[62] == " 12 345 !!"
    assert periodic_runs.without_runs(none).count() == 0


def slow_search(docs, items, k=10):
    split = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(i, Counter(split((t or "").translate(fold)))) for i, t in docs if i is not None]
    words = [(i, c) for i, c in words if c]
    total = sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, terms in items.items():
        scored = []
        for i, c in words:
            m = 10 + 90 * sum(c.values()) * len(words) // total
            score = sum(math.floor(1000 * math.log((2 * len(words) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_search(spark, docs, none, monkeypatch):
    texts = [(0, "Fuchs Hund the thinks"), (1, EN), (2, DE + " TOKYO 東京"), (3, None), (4, "!!"), (5, "absent"), (6, "fox fox FOX"), (6, "dog"), (None, "fox"), (7, "word x y z end")]
    items = spark.createDataFrame([(i, t, 1.0) for i, t in texts], "item_id long, text string, score double")
    asked = {}
    for i, t in texts:
        if i is not None:
            asked.setdefault(i, set()).update(x.decode() for x in lexical_search.terms((t or "").encode()))
    expected = slow_search([(r[0], r[1]) for r in rows()], asked)
    assert sorted(map(tuple, lexical_search.search(docs, items).collect())) == expected
    assert sorted(map(tuple, lexical_search.search(docs, items, k=2).collect())) == [r for r in expected if r[1] <= 2]
    monkeypatch.setattr(lexical_search, "blocks", lambda *a, f=lexical_search.blocks: f(*a, limit=60))
    assert sorted(map(tuple, lexical_search.search(docs, items).collect())) == expected
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(docs, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]


def test_a_shard_gives_its_best_whatever_can_already_be_said_of_them():
    rng = np.random.default_rng(1)
    ids, found = np.arange(300), [rng.integers(0, 12, rng.integers(0, 9)) ** 2 // 12 for _ in range(300)]
    lengths = np.array([len(x) + 1 for x in found])
    shard = lexical_search.Shard(ids, lengths, found, rng.integers(0, 4000, 12), 300, int(lengths.sum()))
    for query in (np.arange(12), np.array([0, 3]), np.array([11])):
        sums = np.zeros(300, np.int64)
        for t in query:
            a, b = shard.first[t], shard.first[t + 1]
            sums[shard.document[a:b]] += shard.score[a:b]
        for k in (1, 5, 50):
            for enter in (1, int(sums.max() * 0.7) + 1, int(sums.max()), int(sums.max()) + 1):
                at, scores = shard.best(query, k, enter)
                least = max(enter, np.sort(sums)[-k], 1)
                assert dict(zip(at.tolist(), scores.tolist(), strict=True)) == {i: s for i, s in enumerate(sums.tolist()) if s >= least}


def slow_grams(text):
    import unicodedata

    plain = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    if not any(unicodedata.category(c)[0] == "L" for c in plain):
        return Counter()
    s = " " + " ".join(plain.split()) + " "
    return Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n].strip() and not (n == 3 and s[i + 1] == " "))


def ranked(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:300]]


def test_language_report(docs, none):
    import zlib

    learned = {}
    for i, t, lang, *_ in rows():
        if i is not None and lang and t is not None and zlib.crc32(str(i).encode()) % 5:
            learned.setdefault(lang, Counter()).update(slow_grams(t))
    profile = {x: {g: k for k, g in enumerate(ranked(c))} for x, c in learned.items()}
    expected = []
    for i, t, *_ in rows():
        own = ranked(slow_grams(t))
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        if not own:
            expected.append((i, held, "und", 0.0))
            continue
        distance, lang = min((sum(abs(k - p[g]) if g in p else 300 for k, g in enumerate(own)), x) for x, p in profile.items())
        expected.append((i, held, lang, 1 - distance / (300 * len(own))))
    got = [tuple(r) for r in language_id.language_report(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert all(r[2] == ("en" if r[0] % 2 else "de") for r in got if r[0] is not None and r[0] < 60)
    assert language_id.language_report(none).count() == 0
    assert {r.lang_pred for r in language_id.language_report(docs.where("lang IS NULL")).collect()} == {"und"}


def test_grams_in_windows(monkeypatch):
    letters = language_id.word_letters((EN + DE).encode() * 3)
    whole = language_id.gram_counts(letters)
    monkeypatch.setattr(language_id, "WINDOW", 11)
    assert all((a == b).all() for a, b in zip(language_id.gram_counts(letters), whole, strict=True))


def test_long_texts_stay_within_bounds():
    """A text of 6 MB: some hundred MB each."""
    text = " ".join(f"{w}{k % 977}" for k in range(45_000) for w in EN.split()[:22]).encode()[: 6 << 20]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert periodic_runs.runs(*periodic_runs.interned([text.split()]))[:, [1, 3]].tolist() == [[0, 977 * 22]]
    assert 100 < len(language_id.ranking(text, 300)) <= 300
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1e3 < 700
