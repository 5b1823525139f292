"""Near-duplicates of the pipeline: SimHash candidates, confirmed by five-word shingles.

Candidates are texts with fingerprints of distinct words within 3 bits, for any of ``KINDS`` independent fingerprints: one
alone misses many pairs, and a search within more bits would have narrower keys, under which unlike texts meet more and
more often as the collection grows.  Texts with one set of shingles are put together before.  Components of the
candidate links only say which texts may be compared; within them every pair is held against the rule, and only pairs
whose sets of five-word shingles share at least 4/5 of their union are linked.  A component with very many texts, or long ones,
is dealt out in pairs of blocks that are bounded in rows and in shingles, and a unit emits stars of its confirmed links.

Edge cases as in operator 4; texts without a word are one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import sorted_groups, written
from gradus.llm.components import components, least_reached
from gradus.llm.simhash import links
from gradus.llm.winnow import mixed

WORDS = 5
KINDS, SEGMENTS = 12, 4
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20
SLICE, DENSE = 256, 256


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's shingles, sorted, each once."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s) for s in shingles), np.uint64, len(shingles)).view(np.int64))


def fingerprints(text: str | None, kinds: int = KINDS) -> list[int]:
    """Independent fingerprints of a text's distinct words: each word is hashed once, and the hash mixed anew for each kind."""
    tokens = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not tokens:
        return [0] * kinds
    hashes = np.fromiter((xxhash.xxh64_intdigest(t) for t in tokens), np.uint64, len(tokens))
    bits = np.unpackbits(mixed(hashes[:, None] ^ np.arange(kinds, dtype=np.uint64)).view(np.uint8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.uint16 if len(tokens) < 1 << 16 else np.int64).astype(np.int64)
    return np.packbits(ones * 2 > len(tokens), bitorder="little").view(np.uint64).tolist()


def confirmed(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) of the links between sets that share at least 4/5 of their union.

    ``SLICE`` sets at a time meet all before them.  Shingles that more than ``DENSE`` sets have are counted by a product of
    matrices, the others by their lists; pairs already in one component are passed over, so no list of all pairs arises.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, shingle, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    heavy = np.flatnonzero(often > DENSE)
    column = np.full(len(often), -1)
    column[heavy] = np.arange(len(heavy))
    dense = np.zeros((n, len(heavy)), np.float32)
    inside = column[shingle] >= 0
    dense[owner[inside], column[shingle[inside]]] = 1
    light = ~inside & (often[shingle] > 1)
    owner, shingle = owner[light], shingle[light]
    order = np.argsort(shingle, kind="stable")
    posted, starts = owner[order], np.searchsorted(shingle[order], np.arange(len(often)))
    ends = np.searchsorted(owner, np.arange(n + 1))
    root = np.arange(n)
    for at in range(0, n, SLICE):
        to = min(at + SLICE, n)
        shared = dense[at:to] @ dense[:to].T
        for i in range(at, to):
            mine = shingle[ends[i] : ends[i + 1]]
            if len(mine):
                long = often[mine]
                met = posted[np.repeat(starts[mine] - np.cumsum(long) + long, long) + np.arange(long.sum())]
                shared[i - at] += np.bincount(met, minlength=n)[:to]
        near = shared * 5 >= (sizes[at:to, None] + sizes[:to] - shared) * 4
        near &= root[at:to, None] != root[:to]
        i, j = np.nonzero(near)
        if len(i):
            met, least = least_reached(root[i + at], root[j])
            onto = np.arange(n)
            onto[met] = least
            root = onto[root]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, root, nodes)
    return nodes, least[root]


def near_groups(docs: DataFrame, row_col: str, text_col: str = "text", block: int = BLOCK, kinds: int = KINDS) -> DataFrame:
    """(row, group): rows of one group are joined by confirmed links."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [shingle_set(t) for t in texts]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fps = np.array([fingerprints(t, kinds) for t in texts], np.uint64).view(np.int64)
            size = np.array([len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array(size, pa.int64()), pa.array([*fps], pa.list_(pa.int64()))], ["row", "node", "size", "fps"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("node", "component", "blocks", "block")), sets], ["node", "component", "blocks", "block", "shingles"])

    rows = docs.select(F.col(row_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    made = written(rows.mapInArrow(printed, "row long, node long, size long, fps array<long>"), "near-prints")
    nodes = written(made.groupBy("node").agg(F.min("fps").alias("fps"), F.min("row").alias("first"), F.min("size").alias("size")), "near-nodes")
    each = nodes.select("node", F.posexplode("fps").alias("kind", "fp"))
    prints = written(each.groupBy("kind", "fp").agg(F.count("*").alias("nodes")), "near-fingerprints")
    met = written(links(prints.select("kind", "fp"), block, SEGMENTS), "near-links")
    # a fingerprint that is linked, or that several texts have, stands between them; what else meets there is told apart below
    between = written(met.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(prints.where("nodes > 1").select("fp")).distinct(), "near-between")
    graph = met.unionByName(each.join(between, "fp").select(F.col("node").alias("a"), F.col("fp").alias("b")))
    placed = components(graph, "a", "b").join(nodes.select("node", "first", "size"), "node")
    placed = written(placed, "near-candidates")
    blocks = written(placed.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "near-blocks")
    placed = placed.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # only candidates' texts are read again, one row for each set of shingles
    sets = rows.join(placed, F.col("row") == F.col("first")).select("node", "component", "blocks", "block", "text").mapInArrow(shingled, "node long, component long, blocks int, block int, shingles array<long>")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.withColumn("other", other).select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "shingles")
    keys = ["component", "low", "high"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g in sorted_groups(batches, tuple(keys)):
            own, least = confirmed(g["node"], [*g["shingles"]])
            yield pa.RecordBatch.from_arrays([pa.array(own[own != least], pa.int64()), pa.array(least[own != least], pa.int64())], ["a", "b"])

    found = components(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compared, "a long, b long"), "a", "b").withColumnRenamed("node", "its")
    return made.select("row", "node").join(found, F.col("node") == F.col("its"), "left").select("row", F.coalesce("component", "node").alias("group"))
