"""Operator 9: suffix-array deduplication of byte strings.

Removes each byte that a string of ``width`` bytes covers which also starts earlier (in a document with a smaller id,
or earlier in the same one); overlaps count, and strings are judged on the input.

``repeats`` brings together what can be equal: shards of contexts around common anchors.  Of each shard the suffix
array is built by induced sorting, and neighbours in it that share ``width`` bytes or more, by the permuted common
prefixes, form the groups of equal strings; all but the earliest of a group are repeats.

A string that ``repeats`` finds whole at an earlier place by hash is removed after a comparison of the bytes.

Edge cases: a null text is empty; texts shorter than a string keep everything; rows that repeat an id are judged each by
its own text, at places of one document; rows without an id keep everything and are nobody's source; very long texts are
cut in pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gradus.llm import repeats, winnow
from gradus.llm.common import documents
from gradus.llm.suffix_array import permuted_common_prefixes, suffix_array

WIDTH, GRAM = 100, 24
SHARD_BYTES = 2 << 20

_BYTES = winnow.mixed(np.arange(1, 257, dtype=np.uint64))


class ByteView:
    def __init__(self, data: bytes):
        self.data, self.n = data, len(data)

    def values(self, start: int, stop: int) -> np.ndarray:
        return _BYTES[np.frombuffer(self.data, np.uint8)[start:stop]]

    def cut(self, start: int, stop: int) -> bytes:
        return self.data[start:stop]


def repeated_spans(docs: np.ndarray, starts: np.ndarray, parts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of context, start, stop) covered by strings that start earlier, among contexts at these places of these documents."""
    lengths = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    gap = begin + lengths
    present = np.zeros(256, bool)
    present[raw] = True
    dense = (np.cumsum(present) + 1).astype(np.uint16)  # bytes in order from 2, 1 between contexts, 0 at the end
    text = np.append(dense[raw], np.uint16(0))
    text[gap] = 1
    buckets = int(text.max()) + 1
    if buckets <= 256:
        text = text.astype(np.uint8)
    order = suffix_array(text, buckets)
    common = permuted_common_prefixes(text, order, width)

    of = np.repeat(np.arange(len(parts)), lengths + 1)
    offset = np.arange(len(of)) - begin[of]
    valid = np.append(offset + width <= lengths[of], False)
    ranked = np.unique(docs, return_inverse=True)[1]
    place = np.append(ranked[of] << 40 | (starts[of] + offset), 0)

    equal = common[order] >= width
    group = np.flatnonzero(~equal)
    earliest = np.repeat(np.minimum.reduceat(place[order], group), np.diff(np.append(group, len(order))))
    repeat = np.zeros(len(text), bool)
    repeat[order] = place[order] > earliest
    at = np.flatnonzero(repeat & valid)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, (np.diff(at) > 1) | (of[at[1:]] != of[at[:-1]]))
    first, last = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    base = starts[of[first]] - begin[of[first]]
    return of[first], base + first, base + last + width


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, keep_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the remaining bytes unless ``keep_text`` is off."""
    search = lambda d, s, p: repeated_spans(d, s, p, width)
    rows = repeats.repeated(docs, ByteView, search, width, gram, True, shard_bytes, "op9", id_col, text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, spans in zip(batch.column("packed"), batch.column("spans")):
                data = repeats.unpacked(data.as_py())
                start, stop = repeats.spans_of(spans)
                left = b"".join(data[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(data)]))
                out.append((len(data), len(data) - len(left), len(start), hashlib.sha256(left).hexdigest(), left if keep_text else None))
            columns = [batch.column("doc_id"), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = rows.mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if keep_text else done.drop("kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), keep_text=False)


ORACLE = """
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
n as (select doc_id, h, length(h) // 2 as n from b),
each as (select doc_id, unnest(range(0, n)) as i, h, n from n),
win as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as s from each where i + 100 <= n),
f as (select s, min(cast(doc_id as hugeint) * 4294967296 + i) as first from win group by s),
dup as (select doc_id, i as p from win join f using (s) where first < cast(doc_id as hugeint) * 4294967296 + i),
gone as (select doc_id, i, byte, coalesce(max(p) over (partition by doc_id order by i rows unbounded preceding) > i - 100, false) as gone
         from (select each.doc_id, each.i, substr(h, 2 * each.i + 1, 2) as byte, dup.p from each left join dup on each.doc_id = dup.doc_id and each.i = dup.p)),
edge as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as begins from gone),
k as (select doc_id, count(*) filter (gone) as n_removed, count(*) filter (begins) as n_spans, string_agg(byte, '' order by i) filter (not gone) as kept from edge group by doc_id)
select n.doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from n left join k on n.doc_id = k.doc_id"""
