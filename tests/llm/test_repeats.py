"""The two substring operators against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import repeats, rlz_dedup, suffix_array, suffix_dedup, winnow


def brute_bytes(rows, width):
    first = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        for p in range(len(data) - width + 1):
            first.setdefault(data[p : p + width], (i, p))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - width + 1):
            if first[data[p : p + width]] < (i, p):
                gone[p : p + width] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(rows, width):
    first = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        for p in range(len(words) - width + 1):
            first.setdefault(tuple(words[p : p + width]), i)
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = np.zeros(len(words), bool)
        for p in range(len(words) - width + 1):
            if first[tuple(words[p : p + width])] < i:
                gone[p : p + width] = True
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def made_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5)))
    passages = [" ".join(word() for _ in range(rng.choice([40, 51, 60, 130]))) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "x" * 400), (4, "ab " * 200), (5, "x" * 150)]
    for i in range(6, 46):
        rows.append((i * 3 % 97, rng.choice(["", " ", "\n"]).join(rng.choice([rng.choice(passages), " ".join(word() for _ in range(rng.randint(1, 60)))]) + " " for _ in range(rng.randint(1, 5)))))
    copies = [(200 + k, rows[10 + k][1]) for k in range(5)] + [(300, rows[12][1].replace("a", "b", 3)), (301, rows[12][1] + "\x0b" + rows[13][1])]
    return rows + copies + [copies[0]]


@pytest.fixture(scope="module")
def tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [(docs, [(r.doc_id, r.text) for r in docs.collect()])]
    for seed in (1, 2):
        rows = list({(i, t): None for i, t in made_rows(seed)})
        rows = list({i: (i, t) for i, t in rows}.values())
        rows += rows[-2:]  # repeated rows
        clash = {"spans": F.lit(1), "start": F.lit("x"), "packed": F.lit(2), "anchor": F.lit(3)}
        out.append((spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash), rows))
    return out


def test_suffix_dedup(tables):
    for df, rows in tables:
        for shard in (1000, suffix_dedup.SHARD_BYTES):
            got = suffix_dedup.suffix_dedup(df, shard_bytes=shard).drop("kept")
            assert sorted(map(tuple, got.collect())) == brute_bytes(rows, 100)
    assert suffix_dedup.suffix_dedup(tables[1][0].limit(0)).count() == 0


def test_rlz_dedup(tables):
    for df, rows in tables:
        for shard in (1000, rlz_dedup.SHARD_BYTES):
            got = rlz_dedup.rlz_dedup(df, shard_bytes=shard).drop("kept")
            assert sorted(map(tuple, got.collect())) == brute_words(rows, 50)
    assert rlz_dedup.rlz_dedup(tables[1][0].limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2, 10])
def test_hot_anchors_change_nothing(tables, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    df, rows = tables[1]
    assert len(repeats.hot_anchors(repeats.stored(df, "doc_id", "text", "test"), suffix_dedup.ByteView, 100, 24)) > 0
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(df).drop("kept").collect())) == brute_bytes(rows, 100)
    assert sorted(map(tuple, rlz_dedup.rlz_dedup(df).drop("kept").collect())) == brute_words(rows, 50)


@pytest.mark.parametrize("size", [0, 300])
def test_contexts_beyond_the_bound_change_nothing(tables, monkeypatch, size):
    """Anchors with more contexts than a shard may hold are dealt window by window."""
    monkeypatch.setattr(repeats, "MOST_BYTES", size)
    df, rows = tables[2]
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(df).drop("kept").collect())) == brute_bytes(rows, 100)
    assert sorted(map(tuple, rlz_dedup.rlz_dedup(df).drop("kept").collect())) == brute_words(rows, 50)


def test_pieces_of_long_texts_change_nothing(tables, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 37)
    monkeypatch.setattr(repeats, "SLICE", 3)
    df, rows = tables[1]
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(df).drop("kept").collect())) == brute_bytes(rows, 100)
    assert sorted(map(tuple, rlz_dedup.rlz_dedup(df).drop("kept").collect())) == brute_words(rows, 50)


@pytest.mark.parametrize("slices", [2, 2048])
def test_hashes_decide_nothing(tables, monkeypatch, slices):
    """With contents hashed to three values, runs of other contents are claimed equal; the comparison finds out."""
    plain = winnow.runs
    monkeypatch.setattr(winnow, "runs", lambda *a: (lambda r: r._replace(content=r.content % np.uint64(3)))(plain(*a)))
    monkeypatch.setattr(repeats, "SLICE", slices)
    df, rows = tables[1]
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(df).drop("kept").collect())) == brute_bytes(rows, 100)
    assert sorted(map(tuple, rlz_dedup.rlz_dedup(df).drop("kept").collect())) == brute_words(rows, 50)


def test_windows_that_share_a_hash(monkeypatch):
    plain = winnow.Hashes.every
    monkeypatch.setattr(winnow.Hashes, "every", lambda self, width: plain(self, width) % np.uint64(2))
    rng = random.Random(3)
    parts = [" ".join(rng.choice("ab") for _ in range(rng.randint(5, 30))).encode() for _ in range(12)]
    of, start, stop = rlz_dedup.duplicate_spans(np.arange(12), np.zeros(12, np.int64), parts, 5)
    got = {(int(c), k) for c, a, b in zip(of, start, stop) for k in range(a, b)}
    assert got == {(c, k + j) for c, p in enumerate(parts) for k in range(len(p.split()) - 4) if any(p.split()[k : k + 5] == q.split()[i : i + 5] for q in parts[:c] for i in range(len(q.split()) - 4)) for j in range(5)}


def thue_morse(bits):
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_long_words_that_differ_are_different(spark):
    word = thue_morse(11)
    other = word.translate(str.maketrans("ab", "ba"))
    lead, rest = [f"w{k}" for k in range(30)], [f"x{k}" for k in range(30)]
    rows = [(1, " ".join([*lead, word, *rest])), (2, " ".join([*lead, other, *rest])), (3, " ".join([*lead, other, *rest]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, rlz_dedup.rlz_dedup(df).drop("kept").collect())) == brute_words(rows, 50)
    assert {r.doc_id: r.n_removed for r in rlz_dedup.rlz_dedup(df).collect()} == {1: 0, 2: 0, 3: 61}


def test_ids_that_clash(spark):
    """Rows of one id with different texts are judged each by its own text."""
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(120))
    fill = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    rows = [(1, passage), (7, f"{fill(9)} {passage} {fill(20)}"), (7, f"{fill(300)} {passage}"), (7, fill(80)), (8, passage), (8, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(df).drop("kept").collect())) == brute_bytes(rows, 100)
    assert sorted(map(tuple, rlz_dedup.rlz_dedup(df).drop("kept").collect())) == brute_words(rows, 50)
    assert sorted(r.n_removed for r in rlz_dedup.rlz_dedup(df).collect()) == [0, 0, 120, 120, 120, 120]


def test_very_long_text(spark):
    """Texts of 50 MB, one a word only; the pieces keep what is held small."""
    rng = np.random.default_rng(4)
    letters = "".join(map(chr, rng.integers(97, 123, 5_000_000)))
    passage = " ".join(letters[k : k + 7] for k in range(0, 3500, 7))
    text = " ".join([" ".join(letters[k : k + 9] for k in range(0, len(letters), 9))] * 8 + [passage])
    rows = [(1, passage), (2, text), (3, "y" * 50_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in rlz_dedup.rlz_dedup(df, keep_text=False).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 500 and got[2].n_words == 8 * 555_556 + 500 and got[3].n_words == 1
    view = suffix_dedup.ByteView(text.encode())
    runs = [r for piece in repeats._runs(view, 100, 24, np.zeros(0, np.int64)) for r in zip(piece.start.tolist(), piece.stop.tolist())]
    assert runs[0][0] == 0 and runs[-1][1] == view.n - 99 and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for k in range(120):
        n, letters = rng.randint(1, 200), rng.choice([1, 2, 3, 20])
        raw = [rng.randint(1, letters) for _ in range(n)]
        text = np.array(((raw[:7] * 40)[:n] if k % 3 == 0 else raw) + [0], np.uint8)
        want = sorted(range(len(text)), key=lambda i: bytes(text[i:]))
        assert list(suffix_array.suffix_array(text, int(text.max()) + 1)) == want
        assert list(suffix_array.suffix_array(text.astype(np.int64))) == want
        common = suffix_array.permuted_common_prefixes(text, np.array(want), 20)
        for a, b in zip(want, want[1:]):
            share = 0
            while share < 20 and max(a, b) + share < len(text) and text[a + share] == text[b + share]:
                share += 1
            assert common[b] == share


def test_runs_meet_equal_windows():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 2**63, 40).astype(np.uint64)
    seen = []
    for _ in range(20):
        values = np.concatenate([rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64), passage, rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)])
        runs = winnow.runs(values, 20, 6)
        assert (runs.start[1:] == runs.stop[:-1]).all() and runs.stop[-1] == len(values) - 19
        at = int(np.flatnonzero(values == passage[0])[0])
        seen.append([int(runs.gram[np.searchsorted(runs.start, at + k, side="right") - 1]) for k in range(21)])
    assert all(s == seen[0] for s in seen)
