"""Operator 4: near-duplicates by SimHash, with pigeonring filtering.

A fingerprint has 64 bits in a ring of m segments.  If two fingerprints differ in at most ``d`` bits, then some segment
exists from which every chain of l consecutive segments differs in at most ``floor(l * d / m)`` bits (the pigeonring
principle).  Here d : m is 3 : 8, that is 3 bits with 8 segments or 6 with 16, so the first two segments of the chain
must be equal, five may differ in one bit, seven in two, and so on.  Fingerprints are therefore indexed, for each of the
m starts, by the two equal segments together with two of the next three (one of which may hold the single difference):
3 m keys of 32 bits.  With 4 segments and 3 bits the first is equal and the second differs in one bit at most: 2 m keys
of 24 bits.  Fingerprints that share a key are candidates; the chain is tested with growing length up to the full distance.

Equal fingerprints are put together before any of this.  A key with very many different fingerprints is dealt out in
blocks, every pair of blocks being one unit of work, so no task holds more than two blocks; a unit emits a spanning
forest of its links rather than its pairs.  Components of the links follow, in which fingerprints stand for themselves;
a component is then named by the smallest id of its documents, and every document joins its fingerprint's component.

Edge cases: a null or blank text has no words and the fingerprint zero, which is linked like any other; a text with
fewer words than a shingle has its whole word sequence as its one shingle; repeated rows share fingerprint and
component; rows without an id link like any other and never name a component (one of such rows only has no name); an empty table gives an empty result; other columns are ignored.
A text is fingerprinted whole by one task: about 45 bytes of memory a byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import documents, written
from gradus.llm.components import components

SEED = 42
SEGMENTS = 8
BLOCK = 4096

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of some 64-bit numbers."""
    columns = hashes.view(np.uint8).reshape(len(hashes), 8)
    set_bits = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int) -> int:
    """Majority of the bits of the XXH64 of all shingles, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if words == 1:
        shingles = tokens
    else:
        joined = b" ".join(tokens)
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
        shingles = [joined[i:j] for i, j in zip(starts, ends[words - 1 :] or ends[-1:])]
    return majority(np.fromiter((digest(x, SEED) for x in shingles), np.uint64, len(shingles)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py(), words) for text in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(made, "doc_id long, fp long")


def equal_parts(segments: int) -> list[list[int]]:
    """For the chain that starts at a segment: sets of bits, one of which must be equal in fingerprints within the distance.

    With 8 segments or more, the first two segments are equal and of the next three all but one.  With 4 segments, of 16
    bits, the first is equal, and the second differs in one bit at most, so one of its halves is equal.
    """
    bits = 64 // segments
    if segments >= 8:
        return [[b for k in range(5) if k != left_out for b in range(k * bits, (k + 1) * bits)] for left_out in (2, 3, 4)]
    return [[*range(bits), *range(bits + half, bits + half + bits // 2)] for half in (0, bits // 2)]


def chain_keys(segments: int = SEGMENTS, fp: str = "fp", kind: str = "kind") -> Column:
    """The keys of a fingerprint, an array of numbers: kind, start and part above the equal bits of the chain."""
    keys, bits, parts = [], 64 // segments, equal_parts(segments)
    for start in range(segments):
        turn = start * bits
        chain = F.shiftrightunsigned(fp, turn).bitwiseOR(F.shiftleft(fp, 64 - turn)) if turn else F.col(fp)
        for k, part in enumerate(parts):
            number = F.col(kind).cast("long") * (segments * len(parts)) + (start * len(parts) + k)
            keys.append(chain.bitwiseAND(F.lit(sum(1 << b for b in part))).bitwiseOR(F.shiftleft(number, 48)))
    return F.array(*keys)


def pairs_within(key: np.ndarray, unit: np.ndarray, fps: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one unit that pass every chain from their key's start and so the full distance.

    Rows of a unit follow each other; rows k apart are compared all at once, for k = 1, 2 and so on.
    """
    bits, most, out = 64 // segments, 6 if segments == 16 else 3, []
    turn = ((key >> 48) // len(equal_parts(segments)) % segments * bits).astype(np.uint64)
    active, apart = np.arange(len(fps)), 0
    while len(active):
        apart += 1
        active = active[: np.searchsorted(active, len(fps) - apart)]
        active = active[unit[active] == unit[active + apart]]
        differ, turned = fps[active] ^ fps[active + apart], turn[active]
        differ = (differ >> turned) | (differ << ((np.uint64(64) - turned) & np.uint64(63)))
        left = np.arange(len(active))
        for length in range(5 if segments >= 8 else 2, segments + 1):
            chain = differ[left] & np.uint64((1 << (length * bits)) - 1)
            left = left[np.bitwise_count(chain) <= length * most // segments]
        out.append((active[left], active[left] + apart))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of links between ids as many as connect what all of them connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept[0].append(x)
            kept[1].append(y)
    return kept


def links(prints: DataFrame, block: int = BLOCK, segments: int = SEGMENTS) -> DataFrame:
    """(a, b): links between different fingerprints at most 3 bits (with 16 segments 6) apart, from (kind, fp).

    Only fingerprints of one kind (a number below 600) are linked, each of which should come once.  What a batch of units
    finds is emitted as a forest.
    """
    keyed = prints.select("fp", F.explode(chain_keys(segments)).alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "op4-shared")
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = keyed.join(shared, "key").select("key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = met.withColumn("other", other).select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp")
    names = ["key", "low", "high", "fp"]

    def found(rows: dict[str, np.ndarray], change: np.ndarray) -> pa.RecordBatch:
        i, j = pairs_within(rows["key"], np.cumsum(change), rows["fp"].view(np.uint64), segments)
        pairs = np.unique(np.stack([rows["fp"][i], rows["fp"][j]], axis=1), axis=0)
        a, b = forest(pairs[:, 0], pairs[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None  # the last unit may go on in the next batch
        for batch in batches:
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()} if held else rows
            if not len(rows["fp"]):
                continue
            change = np.append(True, np.any([rows[k][1:] != rows[k][:-1] for k in names[:3]], axis=0))
            last = int(np.flatnonzero(change)[-1])
            if last:
                yield found({k: v[:last] for k, v in rows.items()}, change[:last])
            held = {k: v[last:] for k, v in rows.items()}
        if held:
            yield found(held, np.append(True, np.zeros(len(held["fp"]) - 1, bool)))

    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, block: int = BLOCK, segments: int = SEGMENTS) -> DataFrame:
    """Per row: doc_id, fingerprint (hexadecimal) and component_id, the smallest id that can be reached."""
    made = written(fingerprints(docs, id_col, text_col, words), "op4-fingerprints")
    distinct = written(made.groupBy("fp").agg(F.min("doc_id").alias("id")), "op4-distinct")
    found = components(links(distinct.select(F.lit(0).alias("kind"), "fp"), block, segments), "a", "b")
    placed = written(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("root")), "op4-placed")
    named = written(placed.groupBy("root").agg(F.min("id").alias("component_id")), "op4-named")
    placed = placed.join(named, "root").select("fp", "component_id")
    return made.join(placed, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
