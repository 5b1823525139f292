"""Operator 6: substring deduplication by relative Lempel-Ziv parsing.

Removes each word that a window of ``width`` consecutive words covers whose word sequence also starts in a document
with a smaller id; windows are judged on the input.

``repeats`` brings together what can be equal.  A run of windows that its hash finds whole at an earlier place is a
factor against the document that stands there, and is compared with it word by word.  Of runs with one anchor and
different words the contexts come together in shards.  These are the reference blocks: every window of every block is indexed with the earliest document that holds it.  Each document's
contexts are factored greedily against all indexed blocks of smaller documents: where a window is in the index, the
factor that starts there is extended word by word along its source as far as both go.  A factor is long enough when it
has ``width`` words, which those found through the index have.  Windows that cross the boundary at a factor's end may
still be found in another block, so the next factor starts at the first such window that the index knows, and
otherwise at the first indexed window after the boundary.  Factors are duplicate spans.

Edge cases: a null or blank text has no words; texts shorter than a window keep everything; repeats within one document
stay; rows that repeat an id are nobody's source to each other, and each is judged by its own text; rows without an id
keep everything and are nobody's source; very long texts and words are cut in pieces; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from gradus.llm import repeats, winnow
from gradus.llm.common import documents

WIDTH, GRAM = 50, 12
SHARD_BYTES = 4 << 20
LONG, CHUNK = 64, 1 << 20  # bytes of a word; bytes (or words) that are treated at once

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)

_BYTES = winnow.mixed(np.arange(1, 257, dtype=np.uint64))


class WordView:
    """A text as its words; words of up to ``LONG`` bytes are hashed together, longer ones each by itself."""

    def __init__(self, data: bytes):
        self.data = data.translate(_SPACES)
        self.raw = np.frombuffer(self.data, np.uint8)
        edges = np.flatnonzero(np.diff(self.raw != 32, prepend=False, append=False))
        self.start, self.stop = edges[::2], edges[1::2]
        self.n = len(self.start)

    def values(self, start: int, stop: int) -> np.ndarray:
        begin, end = self.start[start:stop], self.stop[start:stop]
        out, short = np.empty(len(begin), np.uint64), end - begin <= LONG
        for k in np.flatnonzero(~short).tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.data[begin[k] : end[k]])
        short = np.flatnonzero(short)
        # pieces of the text without a long word in between
        breaks = np.flatnonzero((np.diff(short) > 1) | (begin[short[1:]] // CHUNK != begin[short[:-1]] // CHUNK)) + 1
        for own in np.split(short, breaks) if len(short) else ():
            at = begin[own[0]]
            out[own] = winnow.Hashes(_BYTES[self.raw[at : end[own[-1]]]]).span(begin[own] - at, end[own] - at)
        return out

    def cut(self, start: int, stop: int) -> bytes:
        """The words joined by one space."""
        stop = min(stop, self.n)
        parts = [b" ".join(self.data[self.start[a] : self.stop[min(a + CHUNK, stop) - 1]].split()) for a in range(start, stop, CHUNK)]
        return parts[0] if len(parts) == 1 else b" ".join(parts)


def window_names(words: np.ndarray, width: int) -> np.ndarray:
    """Numbers of all windows of this width, alike for equal windows only: by doubling, from numbered words."""
    names, have = words, 1
    while have < width:
        step = min(have, width - have)
        pair = names[: len(names) - step].astype(np.uint64) << np.uint64(32) | names[step:].astype(np.uint64)
        names, have = np.unique(pair, return_inverse=True)[1], have + step
    return names


def factors(words: np.ndarray, start: int, stop: int, hits: np.ndarray, source: np.ndarray, limit: np.ndarray, width: int) -> list[tuple[int, int]]:
    """The greedy parse of the context ``words[start:stop]``; hits: its indexed windows, with where their source stands."""
    out, k = [], 0
    while k < len(hits):
        at, ref = int(hits[k]), int(source[hits[k]])
        longest = min(stop - at, int(limit[ref]) - ref)
        unlike = np.flatnonzero(words[at : at + longest] != words[ref : ref + longest])
        length = int(unlike[0]) if len(unlike) else longest
        out.append((at, at + length))
        k = max(k + 1, int(np.searchsorted(hits, at + length - width + 1)))  # the first window across the boundary, or after it
    return out


def duplicate_spans(docs: np.ndarray, starts: np.ndarray, parts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of context, start, stop) in words, covered by factors of documents with smaller ids.

    Words are numbered in the shard, so equal numbers are equal words.  Windows are indexed by a hash of their numbers; a
    factor shorter than a window tells that two windows share a hash, and then the index takes exact names instead.
    """
    numbers: dict[bytes, int] = {}
    words = np.array([numbers.setdefault(w, len(numbers)) for w in b" ".join(parts).split()], np.int64)
    lengths = np.array([p.count(b" ") + 1 for p in parts])
    begin = np.concatenate([[0], np.cumsum(lengths)])
    none = np.zeros(0, np.int64)
    if len(words) < width:
        return none, none, none
    of = np.repeat(np.arange(len(parts)), lengths)
    end = begin[1:][of]
    n = len(words) - width + 1
    windows = np.flatnonzero(np.arange(n) + width <= end[:n])
    for exact in (False, True):
        index = (window_names(words, width) if exact else winnow.Hashes(winnow.mixed(words.astype(np.uint64) + np.uint64(1))).every(width))[windows]
        order = np.lexsort((docs[of[windows]], index))  # each window's earliest document first
        new = np.append(True, index[order][1:] != index[order][:-1])
        earliest = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        source = np.zeros(len(words), np.int64)
        source[windows[order]] = windows[earliest]
        known = np.sort(windows[order][docs[of[windows[earliest]]] < docs[of[windows[order]]]])
        out = []
        owners, where = np.unique(of[known], return_index=True)
        for c, a, b in zip(owners.tolist(), where.tolist(), [*where[1:].tolist(), len(known)]):
            shift = int(starts[c]) - int(begin[c])
            out += [(c, start, stop, shift) for start, stop in factors(words, int(begin[c]), int(begin[c + 1]), known[a:b], source, end, width)]
        found = np.array(out, np.int64).reshape(-1, 4)
        if (found[:, 2] - found[:, 1] >= width).all():
            break
    return found[:, 0], found[:, 1] + found[:, 3], found[:, 2] + found[:, 3]


def rlz_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, keep_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and the kept words unless ``keep_text`` is off."""
    search = lambda d, s, p: duplicate_spans(d, s, p, width)
    rows = repeats.repeated(docs, WordView, search, width, gram, False, shard_bytes, "op6", id_col, text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, spans in zip(batch.column("packed"), batch.column("spans")):
                text = WordView(repeats.unpacked(data.as_py()))
                start, stop = repeats.spans_of(spans)
                joined = b" ".join(text.cut(a, b) for a, b in zip([0, *stop.tolist()], [*start.tolist(), text.n]) if a < b)
                out.append((text.n, int((stop - start).sum()), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace") if keep_text else None))
            columns = [batch.column("doc_id"), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    done = rows.mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return done if keep_text else done.drop("kept")


def op6_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup(documents(spark, sf_dir), keep_text=False)


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
win as (select doc_id, p, array_to_string(words[p:p + 49], ' ') as s from (select doc_id, words, unnest(range(1, len(words) - 48)) as p from w)),
f as (select s, min(doc_id) as first from win group by s),
dup as (select doc_id, p, true as hit from win join f using (s) where first < doc_id),
each as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from w),
gone as (select doc_id, i, word, coalesce(max(case when hit then p end) over (partition by doc_id order by i rows unbounded preceding) > i - 50, false) as gone
         from (select each.*, dup.p, dup.hit from each left join dup on each.doc_id = dup.doc_id and each.i = dup.p)),
k as (select doc_id, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from gone group by doc_id)
select w.doc_id, len(words) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k on w.doc_id = k.doc_id"""
