"""The pipeline's stages against brute force."""

import hashlib
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradus.llm import near_dedup

BLANK = re.compile(r"[\x20\x09-\x0D]")


@pytest.fixture(scope="module")
def steps(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], data).cache())
    return out


def test_columns_stay(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]


def test_language_stage_keeps_prose(steps):
    before, after = ({r.doc_id: r for r in df.collect()} for df in steps[:2])
    assert set(before) - set(after) <= {i for i, r in before.items() if len(r.text or "") < 40 or not any(map(str.isalpha, r.text))}


def test_exact_stage(steps):
    groups = {}
    for r in steps[1].collect():
        groups.setdefault(BLANK.sub("", r.text or ""), []).append((-len(r.text or ""), r.doc_id))
    assert sorted(min(g)[1] for g in groups.values()) == sorted(r.doc_id for r in steps[2].collect())


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate({k: " " for k in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_stage(steps):
    """Against all pairs of texts: those that share 4/5 of their five-word shingles are linked, and one row of a group stays."""
    rows = [(r.doc_id, shingles(r.text)) for r in steps[2].collect()]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    assert sorted(i for i in up if root(i) == i) == sorted(r.doc_id for r in steps[3].collect())


def test_mixing_and_encoding(steps):
    before, mixed = steps[3].collect(), steps[4].collect()
    size = {r.doc_id: len((r.text or "").split()) for r in before}
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= set(size) and max(copies.values()) <= 2
    taken = sum(size[r.doc_id] for r in mixed)
    assert abs(taken - 1.5 * sum(size.values())) < 0.05 * sum(size.values())
    encoded = steps[5].collect()
    text = {r.doc_id: r.text for r in before}
    assert Counter(r.doc_id for r in encoded) == copies
    assert all(r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest() for r in encoded)


def test_odd_documents(spark, data):
    rows = [(1, "the cat sat on the mat and looked at the other cat " * 3, "en", "a", 1), (1, "the cat sat on the mat and looked at the other cat " * 3, "en", "a", 1), (2, None, None, None, None), (3, "", "en", None, 0), (4, "123 !!", "fr", "b", 6), (5, "le chat est sur le tapis et regarde un autre chat " * 5000, "fr", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"copies": F.lit("x"), "score": F.lit(0), "kept": F.lit(True)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data).cache()
    assert {r.doc_id for r in docs.collect()} == {1, 5} and docs.count() <= 4
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, data)
    assert empty.count() == 0


def test_rows_without_or_with_repeated_ids(spark, data):
    prose = lambda word: " ".join(f"{word}{k}" for k in range(40))
    rows = [(None, prose("one")), (None, prose("two")), (7, prose("three")), (7, prose("four")), (7, prose("five")), (8, prose("five")), (None, prose("five")), (None, prose("six")), (None, prose("six"))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage):
        docs = stage(spark, docs, data).cache()
        want = [(None, prose("one")), (None, prose("two")), (7, prose("three")), (7, prose("four")), (7, prose("five")), (None, prose("six"))]
        assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(want)
    mixed = Counter((r.doc_id, r.text) for r in corpus_pipeline.mixing_stage(spark, docs, data).collect())
    assert sum(mixed.values()) == 9 and set(mixed) <= set(want) and max(mixed.values()) <= 2


def test_near_stage_links_by_five_word_shingles(spark, data):
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(w) for w in (words, words[::-1], [*words[:-1], "end"], [f"x{k}" if k % 9 == 0 else w for k, w in enumerate(words)])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, docs, data).collect()) == [0, 1, 3]
    for block in (1, 4096):  # pairs of blocks find the same
        groups = {r.row: r.group for r in corpus_pipeline.near_dedup.near_groups(docs, "doc_id", block=block).collect()}
        assert groups[0] == groups[2] and len({groups[i] for i in range(4)}) == 3


def test_units_of_near_copies_stay_small():
    """8,192 near-copies of 300 shingles in one unit: seconds and memory are bounded, and the component is found."""
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 40, 300)
    sets = []
    for _ in range(8192):
        own = base.copy()
        own[draw.integers(0, 300, 20)] = draw.integers(0, 1 << 40, 20)
        sets.append(np.unique(own))
    began = time.process_time()
    tracemalloc.start()
    nodes, least = near_dedup.confirmed(np.arange(8192) + 5, sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (least == 5).all() and peak < 500 << 20 and time.process_time() - began < 60


def test_units_are_all_pairs():
    draw = np.random.default_rng(2)
    for dense in (0, 4, 10**9):
        groups = [draw.integers(0, 10**6, draw.integers(1, 40)) for _ in range(30)]
        sets = []
        for g in [groups[k] for k in draw.integers(0, 30, 700)]:
            own = g.copy()
            own[draw.random(len(own)) < 0.08] = draw.integers(0, 50)
            sets.append(np.unique(own))
        nodes = draw.permutation(len(sets)) + 10
        links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(c := np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - len(c))]
        met, least = near_dedup.least_reached(*(np.array([nodes[x[k]] for x in links]) for k in (0, 1)))
        want = dict(zip(nodes.tolist(), nodes.tolist())) | dict(zip(met.tolist(), least.tolist()))
        near_dedup.DENSE, was = dense, near_dedup.DENSE
        try:
            own, found = near_dedup.confirmed(nodes, sets)
        finally:
            near_dedup.DENSE = was
        assert dict(zip(own.tolist(), found.tolist())) == want
