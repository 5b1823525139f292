"""Personal data: the base against the plain patterns, gradients against differences, the tagger on hidden spans."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_is_what_the_patterns_find():
    rng = random.Random(4)
    pieces = ["a", "b.c", "@", "@@", ".", "x-y", " ", "1", "255", "256", "00012", "+", "+4", "(20)", "-", "4111 1111 1111 1111", "378282246310005", "1.2.3.4", "é", "d.e@f.gh", "\n", "٣"]
    for _ in range(20000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == plain(text), text
    assert pii.base_spans("1" * 50000 + "@" + "a" * 50000) == []
    assert [s[0] for s in pii.base_spans("call +44 20 7946 0958 or a@b.co, 10.0.0.1, 4111 1111 1111 1111")] == [0, 1, 2, 3]


def test_gradients():
    rng = np.random.default_rng(0)
    model = pii.BiLstmCrf(1, hidden=3, embedding=2, vocabulary=6)
    model.p["step"] = rng.normal(0, 1, (pii.TAGS, pii.TAGS))
    chars, tags = rng.integers(0, 6, (2, 5)), rng.integers(0, pii.TAGS, (2, 5))
    _, grads = model.gradients(chars, tags)
    for name, value in model.p.items():
        at = tuple(rng.integers(0, s) for s in value.shape)
        was, losses = value[at], []
        for step in (1e-5, -1e-5):
            value[at] = was + step
            losses.append(model.gradients(chars, tags)[0])
        value[at] = was
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grads[name][at], abs=1e-6)


def test_viterbi_and_posteriors():
    """Against all tag sequences of short windows."""
    rng = np.random.default_rng(3)
    model = pii.BiLstmCrf(2, hidden=3, embedding=2, vocabulary=6)
    model.p["step"], model.p["begin"] = rng.normal(0, 1, (pii.TAGS, pii.TAGS)), rng.normal(0, 1, pii.TAGS)
    chars = rng.integers(0, 6, (3, 4))
    e, _ = model.emissions(chars)
    paths = np.array(list(itertools.product(range(pii.TAGS), repeat=4)))
    tags, sure = model.decode(chars)
    for k in range(3):
        score = model.p["begin"][paths[:, 0]] + sum(e[k, t][paths[:, t]] for t in range(4)) + sum(model.p["step"][paths[:, t - 1], paths[:, t]] for t in range(1, 4))
        weight = np.exp(score - score.max())
        assert tags[k].tolist() == paths[score.argmax()].tolist()
        for t in range(4):
            assert sure[k, t] == pytest.approx(weight[paths[:, t] == tags[k, t]].sum() / weight.sum())


def test_windows_decide_their_middles():
    """Tags of windows that disagree: the window in whose middle a character lies decides, across the whole text."""

    class Told:
        def decode(self, chars):
            return np.tile(np.where(np.arange(pii.WINDOW) < 20, 3, 4), (len(chars), 1)), np.ones(chars.shape)

    text = "1" * 200
    tags, _ = pii.decoded(Told(), [text])[0]
    for p, tag in enumerate(tags.tolist()):
        start = pii.STRIDE * min(range(7), key=lambda w: (abs(p - w * pii.STRIDE - pii.WINDOW / 2 + 0.5), -w))
        assert tag == (3 if p - start < 20 else 4)
    assert pii.spans_from(np.array([0, 3, 4, 4, 3, 4, 0, 5, 6, 2]), np.full(10, 0.5)) == [((1, 1, 4), 0.5), ((1, 4, 6), 0.5), ((2, 7, 9), 0.5), ((0, 9, 10), 0.5)]


@pytest.fixture(scope="module")
def learned(spark):
    """A model of the documents with even ids, and texts of the others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return pii.fit(docs.where("doc_id % 2 = 0")), [r.text for r in docs.where("doc_id % 2 = 1 and length(text) > 100").orderBy("doc_id").collect()]


def test_spans_beyond_the_base_in_texts_held_out(learned):
    """Of forms that the base misses, set into texts that were not learned from: 9 of 10 are found, of every kind."""
    model, texts = learned
    rng = np.random.default_rng(99)
    found, missed, wrong = np.zeros(4), np.zeros(4), 0
    for k, text in enumerate(texts):
        kind = k % 4
        at = [m.start() for m in re.finditer(" ", text)]
        at = at[rng.integers(len(at))] + 1
        span = pii.draw(kind, rng)
        text = text[:at] + span + " " + text[at:]
        base = pii.base_spans(text)
        if any(a < at + len(span) and b > at for _, a, b in base):
            continue
        added = pii.added_spans(model, [text], [base])[0]
        hit = any(j == kind and min(b, at + len(span)) - max(a, at) >= 0.8 * len(span) for j, a, b in added)
        found[kind] += hit
        missed[kind] += not hit
        wrong += sum(b <= at or a >= at + len(span) for _, a, b in added)
    print(dict(zip(pii.KINDS, zip(found, missed))))
    assert (found > 30).all() and (found / (found + missed) >= 0.9).all() and wrong <= 0.01 * len(texts)


def test_decoding_on_demand_is_decoding_everything(learned):
    model, texts = learned
    rng = np.random.default_rng(5)
    texts = [t[:900] + pii.draw(k % 4, rng) + "a" * (k * 7 % 90) + t[900:1500] for k, t in enumerate(texts[:120])] + ["x" * 150 + "@" + "y" * 150 + ".com", "z" * 70 + ".example dot org" + "1" * 70]
    base = [pii.base_spans(t) for t in texts]
    assert pii.added_spans(model, texts, base) == pii.added_spans(model, texts, base, every=True)


def test_query(spark, learned):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "call 030 1234 5678 now"), (-3, "call 030 1234 5678 now"), (-4, "x " * 150000 + " jane dot doe at example dot org " + "1.2.3.4 " * 2000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    model = learned[0]
    got = sorted(pii.find(docs.withColumns({"spans": F.lit(1), "n_ip": F.lit("x")}), model).collect(), key=lambda r: (r.doc_id, r.base_sha256))
    assert len(got) == len(rows)
    for r, (i, text) in zip(got, sorted(rows, key=lambda r: (r[0], hashlib.sha256(pii.render(plain(r[1])).encode()).hexdigest()))):
        base = plain(text)
        assert r.doc_id == i and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.render(base).encode()).hexdigest()
        more = pii.added_spans(model, [text], [base])[0]
        assert r.spans == pii.render(base + more) and r.n_added == len(more)
    assert sum(r.n_added for r in got if r.doc_id in (-3, -4)) == 3


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "\n"), (3, "\n"), (4, "x" * 100000)], "doc_id long, text string")
    assert pii.fit(rows) is None
    got = pii.find(rows, None).collect()
    assert len(got) == 5 and {r.spans for r in got} == {""}
    assert pii.find(rows.limit(0), None).count() == 0


def test_look_alikes_and_other_forms(learned):
    """Written apart from the templates of training: dates, book numbers, sections and the like stay untagged, other forms are found."""
    model, texts = learned
    rng = np.random.default_rng(42)
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))
    ip = lambda: [str(k) for k in rng.integers(0, 256, 4)]

    def card():
        own = d(14)
        own += next(c for c in "0123456789" if pii.luhn(own + c))
        return ".".join([own[:4], own[4:10], own[10:]])

    look_alikes = (
        lambda: f"20{d(2)}-05-12 10:33:{d(2)} ref {d(10)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"section 1 . {d(1)} . 3 . {d(1)}", lambda: d(10),
        lambda: f"12/05/20{d(2)} at 14.{d(2)}", lambda: f"{d(1)} {d(3)},{d(2)} euros", lambda: f"kernel {d(1)}.{d(2)}.0-{d(2)}", lambda: f"flight {d(4)} gate {d(2)}", lambda: f"@{word()} wrote . then {word()}",
    )
    forms = ((0, lambda: f"{word()}{{at}}{word()}{{dot}}org"), (0, lambda: f"{word()}<at>{word()}.com"), (1, lambda: " [dot] ".join(ip())), (2, card), (3, lambda: f"(0{d(2)}) {d(7)}"))

    def hits(text, span, kind=None):
        at = [m.start() for m in re.finditer(" ", text)]
        at = at[rng.integers(len(at))] + 1
        text = text[:at] + span + " " + text[at:]
        base = pii.base_spans(text)
        added = pii.added_spans(model, [text], [base])[0]
        if kind is None:
            return any(a < at + len(span) and b > at for _, a, b in added)
        return any(j == kind and min(b, at + len(span)) - max(a, at) >= 0.8 * len(span) for j, a, b in base + added)

    wrong = [sum(hits(t, make()) for t in texts[:60]) for make in look_alikes]
    right = [sum(hits(t, make(), kind) for t in texts[:60]) for kind, make in forms]
    print(wrong, right)
    assert max(wrong) <= 6 and sum(wrong) <= 0.02 * 60 * len(wrong) and min(right) >= 54
