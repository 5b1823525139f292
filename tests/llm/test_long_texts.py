"""Texts of many megabytes beside short ones: results are those of brute force, whatever the length."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gradus.llm import bpe, exact_dedup, simhash, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long_docs(spark):
    words = " ".join(f"w{k}" for k in range(2_000_000))  # 15 MB
    rows = [(1, words), (2, words + " more"), (3, f"\t{words}\n"), (4, "a short text of words"), (5, words.upper())]
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3), dict(rows)


def test_simhash_of_long_texts(long_docs):
    docs, _ = long_docs
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got[1][0] == got[3][0] == got[5][0] and [got[i][1] for i in (1, 2, 3, 4, 5)] == [1, 1, 1, 4, 1]


def test_exact_dedup_of_long_texts(long_docs):
    docs, texts = long_docs
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    sha = hashlib.sha256(texts[1].replace(" ", "").encode()).hexdigest()
    assert got[1] == got[3] == (3, 2, sha) and {i: got[i][0] for i in (2, 4, 5)} == {2: 2, 4: 4, 5: 5}


def test_bpe_of_long_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, text = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), "Some words, 123 and émigrés.\n" * 100_000
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.bpe_round_trip(docs).collect()}
    ids = library.encode(text, add_special_tokens=False).ids
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_long_pages(spark):
    html = "<p>text</p>" * 1_500_000 + '<link rel="canonical" href="https://example.org/en/1/x">'
    pages = spark.createDataFrame([(1, "https://a.test/1", html), (2, "https://a.test/2", "<p>"), (3, "https://b.test/" + "y" * 3_000_000, html)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert [got[i].verdict for i in (1, 2, 3)] == ["block", "allow", "block"] and len(got[3].path) == 3_000_001
