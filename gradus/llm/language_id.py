"""Operator 1: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of every labelled text, per language: each task adds up its texts in numpy
and emits one row per language and bucket that occurs, which Spark sums.  The matrix of log-probabilities has
``languages x 2 ** BITS`` entries whatever the amount of text, so it may be collected and broadcast.  Prediction hashes
a few texts of a batch at once into a sparse row layout (bucket numbers of all grams, offsets of the texts) and adds up the
matrix entries per text, so a worker holds a batch and the texts of one such piece of it.

The score is the posterior of the predicted language with the evidence (likelihood and prior alike) scaled down to that of
``EVIDENCE`` grams, since the grams of a text are far from independent; scaling leaves the best language the best.
At most ``MOST_LANGUAGES`` languages are learned: a column with more values is an error and not a model of any size.

Edge cases: a text that is null or has no letter is ``und`` with score 0; rows with null lang or text are not learned
from; with nothing to learn from every text is ``und``; ties go to the language that sorts first; copies count as often
as they occur; a null id is never held out; other columns are ignored, and ``predict`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import documents, let_go, written

BITS = 15
ORDERS = (1, 2, 3)
EVIDENCE = 40
MOST_LANGUAGES = 512  # matrix rows of 128 KB
UNKNOWN = "und"
SLICE = 1 << 18  # characters that are hashed at once
TEXTS = 256  # texts of a batch that are made Python strings at once

# Odd multipliers of the gram hash, one for each place.
_PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def sparse_grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (numbers of texts, buckets, offsets): the buckets of all grams, text by text.

    A gram may run past the end of its text into padding, never into the next text.  Every text appears in exactly
    one batch unless it is longer than a slice; then each of its parts does.
    """
    pad, top = "\0" * (max(ORDERS) - 1), max(ORDERS) - 1
    parts: list[tuple[int, str]] = []
    size = 0

    def hashed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = np.frombuffer("".join([p + pad for _, p in parts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(p) for _, p in parts])
        starts = np.concatenate([[0], np.cumsum(lengths + top)])[:-1]
        inside = np.ones(len(points), bool)
        for k in range(top):
            inside[starts + lengths + k] = False
        first = np.flatnonzero(inside)
        grams, total = [], np.zeros(len(points), np.uint32)
        for order in range(1, max(ORDERS) + 1):
            total = total + np.concatenate([points[order - 1 :], np.zeros(order - 1, np.uint32)]) * _PLACES[order - 1]
            if order in ORDERS:
                value = total ^ np.uint32(order * 0x632BE5AB & 0xFFFFFFFF)
                value = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                grams.append((value >> np.uint32(32 - BITS))[first])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        return np.array([k for k, _ in parts]), np.stack(grams), offsets

    for number, text in enumerate(texts):
        for at in range(0, len(text), SLICE):
            part = text[at : at + SLICE]
            if parts and size + len(part) > SLICE:
                yield hashed()
                parts, size = [], 0
            parts.append((number, part))
            size += len(part)
    if parts:
        yield hashed()


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # log, per language
    weights: np.ndarray  # log-probabilities, language x bucket

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lowered = [t.lower() if t and has_letter(t) else "" for t in texts]
        sums, grams = np.zeros((len(self.languages), len(texts))), np.zeros(len(texts))
        for numbers, buckets, offsets in sparse_grams(lowered):
            np.add.at(grams, numbers, np.diff(offsets) * len(ORDERS))
            for k, row in enumerate(self.weights):
                each = row[buckets[0]]
                for more in buckets[1:]:
                    each = each + row[more]
                np.add.at(sums[k], numbers, np.add.reduceat(each, offsets[:-1]))
        known = (grams > 0) & bool(self.languages)
        out, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known.any():
            shrink = np.minimum(1.0, EVIDENCE / grams[known])
            log = (sums[:, known] + self.prior[:, None]) * shrink
            best = log.argmax(axis=0)
            post = np.exp(log - log.max(axis=0))
            scores[known] = post[best, np.arange(len(best))] / post.sum(axis=0)
            for at, k in zip(np.flatnonzero(known).tolist(), best.tolist()):
                out[at] = self.languages[k]
        return out, scores


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row that has both a text and a language."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        let_go()
        for piece in (batch.slice(at, TEXTS) for batch in batches for at in range(0, batch.num_rows, TEXTS)):
            by: dict[str, list[str]] = {}
            for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                by.setdefault(lang, []).append(text.lower())
            for lang, texts in by.items():
                own = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                rows[lang] = rows.get(lang, 0) + len(texts)
                for _, buckets, _ in sparse_grams(texts):
                    for row in buckets:
                        own += np.bincount(row, minlength=1 << BITS)
        for lang, own in counts.items():
            bucket = np.append(np.flatnonzero(own), -1)
            n = np.append(own[bucket[:-1]], rows[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    known = rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()  # before any task holds an array a language
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of {lang_col}: not a column of languages")
    languages = sorted(r["lang"] for r in known)
    summed = written(rows.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "op1-counts")
    found = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).toArrow()  # a row a language, of at most 2^BITS + 1 numbers
    counts, prior = np.zeros((len(languages), 1 << BITS)), np.zeros(len(languages))
    for lang, own in zip(found["lang"].to_pylist(), found["counts"].combine_chunks()):
        bucket, n = (own.values.field(f).to_numpy(zero_copy_only=False) for f in ("bucket", "n"))
        k = languages.index(lang)
        counts[k, bucket[bucket >= 0]] = n[bucket >= 0]
        prior[k] = n[bucket < 0].sum()
    smooth = counts + 0.5
    weights = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(languages, np.log(prior / prior.sum()) if languages else prior, weights)


def scored(batches: Iterator[pa.Array], model: Model) -> Iterator[pa.Array]:
    """Structs of lang_pred and score for batches of texts, ``TEXTS`` of which are strings at a time."""
    for batch in batches:
        langs, scores = [], [np.zeros(0)]
        for at in range(0, len(batch), TEXTS):
            found, each = model.score(batch.slice(at, TEXTS).to_pylist())
            langs += found
            scores.append(each)
        yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "score"])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input with columns lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        yield from scored(batches, shared.value)

    found = judged(F.col(text_col).cast("string"))
    return docs.withColumn("__found", found).select("*", "__found.lang_pred", "__found.score").drop("__found")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
