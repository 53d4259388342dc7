"""The stages in order over the smallest tables."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from tokenizers import Tokenizer

from loomgraph.llm import toxicity
from loomgraph.llm.registry import tokenizer_file

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k == len(corpus_pipeline.STAGES) - 1:
            break
        assert docs.columns == columns, name
        docs = corpus_pipeline.materialize(docs, "test")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before and ids, name
        before = ids
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == before


def plain_lines(rows):
    """(id, text) rows without the lines that three documents share, but for those of the largest id."""
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if c.isascii() else c for c in k)

    held = defaultdict(set)
    for i, t in rows:
        for line in t.split("\n"):
            held[key(line)].add(i)
    gone = {k: max(own) for k, own in held.items() if len(k) >= 20 and len(own) >= 3}
    return {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in rows}


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 4 * len(x & y) >= 3 * len(x | y):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    clean = corpus_pipeline.materialize(corpus_pipeline.toxicity(spark, docs, SF), "test")
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert {i for i, _ in rows} == {i for i, p in scores.items() if not p}
    lines = corpus_pipeline.materialize(corpus_pipeline.line_dedup(spark, clean, SF), "test")
    found = {r.doc_id: r.text for r in lines.collect()}
    assert found == plain_lines(rows)
    single = corpus_pipeline.materialize(corpus_pipeline.near_copies(spark, lines, SF), "test")
    assert {r.doc_id for r in single.collect()} == {i for i, c in plain_components(list(found.items())).items() if c == i}
    sizes = Counter(r.source for r in single.collect())
    copies = corpus_pipeline.materialize(corpus_pipeline.mixing(spark, single, SF), "test")
    got = Counter(r.source for r in copies.collect())
    share = sum(sizes.values()) / len(sizes)
    assert set(got) <= set(sizes) and all(abs(got[s] - share) < 6 * max(share, share * share / sizes[s]) ** 0.5 for s in sizes)
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in copies.collect()}
    many = Counter(r.doc_id for r in copies.collect())
    covered, held = Counter(), defaultdict(int)
    for p in corpus_pipeline.packing(spark, copies, SF).collect():
        piece = b"".join(x.to_bytes(4, "little") for x in ids[p.doc_id][p.start : p.start + p.length])
        assert p.ids_crc32 == zlib.crc32(piece) and p.doc_tokens == len(ids[p.doc_id])
        covered[p.doc_id] += p.length
        held[p.sequence_id] += p.length
    assert covered == {i: len(x) * many[i] for i, x in ids.items()} and max(held.values()) <= 4096
