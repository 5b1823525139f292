"""The Merkle manifest against a plain fold, and the layout against its definition."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(r, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def levels_of(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        run, place = level[i // 16 * 16 : i // 16 * 16 + 16], i % 16
        out.append(("".join(run[:place]), "".join(run[place + 1 :])))
        i //= 16
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: x[0])
    trees = {s: levels_of([key[2] for key, _ in by[s]]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, ((_, _, leaf), r) in enumerate(by[s]):
            steps, text = path_of(trees[s], i) + path_of(top, k), r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            whole = leaf_of(r, text)
            for left, right in steps:
                whole = digest(left + whole + right)
            out.append((r.doc_id, leaf, trees[s][-1][0], top[-1][0], digest("".join(left + right for left, right in steps)), whole, whole == top[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_layout_is_a_recursive_cut_at_half_height():
    def laid(levels, root, depth):  # the definition: upper half, then the lower halves in turn
        if levels == 1:
            return [(depth, root)]
        upper = levels // 2
        out = laid(upper, root, depth)
        for k in range(16**upper):
            out += laid(levels - upper, root * 16**upper + k, depth + upper)
        return out

    for levels in (1, 2, 3, 4):
        places = {node: k for k, node in enumerate(laid(levels, 0, 0))}
        for depth in range(levels):
            assert merkle.address(levels, depth, np.arange(16**depth)).tolist() == [places[depth, i] for i in range(16**depth)]


def test_odd_rows(spark):
    long = "Ä B c " * 3_000_000
    rows = [(1, "A", "de", None, 1), (None, "Aa", None, "s", None), (None, "Aa", None, "s", None), (7, None, "x", "s", 0), (7, "Q", "x", "s", 0), (7, "q", "x", "s", 0), (9, "", "", "", 0), (5, long, "x", "é", 2), (4, "T", "x", "z", 2)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("rank", "size", "tree", "block", "digest", "root", "row")})
    for height in (1, 3):
        assert rows_of(merkle.verify(docs, height)) == brute(docs.collect())
    empty = merkle.verify(docs.limit(0))
    assert empty.count() == 0 and empty.columns == merkle.verify(docs).columns


@pytest.mark.parametrize("height", [1, 2, 3])
def test_rounds(spark, height):
    """A hot source over several rounds of subtrees, and sizes around powers of the arity."""
    ids = [("hot", 4098), ("a", 1), ("b", 16), ("c", 17), ("d", 256), ("e", 257), *[(f"s{k:02}", 1) for k in range(30)]]
    sizes = ids if height > 1 else [("hot", 600), *ids[1:]]
    rows = [(k * 1000 + i, f"Text {i}", "en", s, i) for k, (s, n) in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = rows_of(merkle.verify(docs, height))
    assert got == brute(docs.collect()) and 0 < sum(not r[-1] for r in got) < len(got)
