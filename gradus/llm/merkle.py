"""Operator 11: a Merkle manifest of a dataset, kept in van Emde Boas layout.

Every row is a leaf; the rows of a source, by id, are folded 16 to a node until one is left, and these subroots, by
source, are folded the same way into the root.  A proof of a row is what must be known besides the row to find the root.

Trees are cut into aligned subtrees of ``HEIGHT`` levels, at most 4,096 leaves each.  A subtree is one row whose digests
lie in van Emde Boas order: the levels are cut at half height, the upper part comes first, then the lower parts one
after another, each laid out the same way.  ``address`` is the arithmetic of that layout; building a subtree and fetching
siblings use nothing else.  The roots of all subtrees are the leaves of the next, 4,096 times smaller, round, and so on up.
Proofs come down the same rounds: what lies above a subtree is worked out once and sent to it.

Places of rows come from ranges, so a source with any share of all rows is dealt over tasks, and a task holds one
subtree at a time.  Texts are hashed where they are read and go nowhere.  Of the whole, only the root (a digest) and the
size of the largest tree reach the driver.

Edge cases: a null column leaves ``-``; rows without an id come first in their source, rows that share an id in the order
of their digests; a null source is a source of its own and comes first; an empty table has no rows and no root; very long
texts are hashed whole; other columns are ignored.  A row without an id is never tampered with.
"""

from __future__ import annotations

import string
from binascii import hexlify
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import documents, sorted_groups, written
from gradus.llm.crc_sql import CRC_STEPS, crc32
from gradus.llm.ranks import ranked

ARITY, HEIGHT = 16, 3
DIGEST = 32
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_ONE_IN = 5


# The layout -----------------------------------------------------------------------------------------------------------


def nodes_in(levels: int) -> int:
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes of one depth (0 is the root) lie in the layout of a tree with so many levels of nodes."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    lower, wide = levels - upper, ARITY ** (depth - upper)  # index // wide is the lower subtree, index % wide the place in it
    return nodes_in(upper) + index // wide * nodes_in(lower) + address(lower, depth - upper, index % wide)


def folded(children: bytes) -> bytes:
    """The digest of a run of digests, as hex text."""
    return sha256(hexlify(children)).digest()


class Subtree:
    """An aligned subtree: its digests in layout order, and how many nodes each depth has."""

    def __init__(self, height: int, leaves: int, nodes: np.ndarray):
        self.height, self.nodes, self.counts = height, nodes, [leaves]
        for _ in range(height):
            self.counts.insert(0, -(-self.counts[0] // ARITY))

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> Subtree:
        count, levels = len(leaves), height + 1
        places = address(levels, height, np.arange(count))
        tree = cls(height, count, np.zeros((int(places.max()) + 1, DIGEST), np.uint8))
        tree.nodes[places] = np.frombuffer(b"".join(leaves), np.uint8).reshape(count, DIGEST)
        for depth in range(height, 0, -1):
            parents = address(levels, depth - 1, np.arange(tree.counts[depth - 1]))
            for place, run in zip(parents.tolist(), tree.runs(depth)):
                tree.nodes[place] = np.frombuffer(folded(run), np.uint8)
        return tree

    def runs(self, depth: int) -> Iterator[bytes]:
        """The digests of each node's children, for the nodes above a depth in turn."""
        places = address(self.height + 1, depth, np.arange(self.counts[depth]))
        for at in range(0, len(places), ARITY):
            yield self.nodes[places[at : at + ARITY]].tobytes()

    def siblings(self) -> list[list[bytes]]:
        """Runs of digests by depth, from the leaves up."""
        return [list(self.runs(depth)) for depth in range(self.height, 0, -1)]

    @property
    def root(self) -> bytes:
        return self.nodes[0].tobytes()


def height_of(size: int, most: int = HEIGHT) -> int:
    """Levels that fold a tree of so many leaves to one node; all of a subtree's where it goes on above."""
    height = 0
    while height < most and ARITY**height < size:
        height += 1
    return height


def step(run: bytes, place: int) -> tuple[bytes, bytes]:
    """What lies left and right of a node among its parent's children."""
    return run[: place * DIGEST], run[(place + 1) * DIGEST :]


def packed(steps: list[tuple[bytes, bytes]]) -> bytes:
    """Steps as bytes: how many digests lie left and right, then these."""
    return b"".join(bytes((len(left) // DIGEST, len(right) // DIGEST)) + left + right for left, right in steps)


def unpacked(path: bytes) -> list[tuple[bytes, bytes]]:
    steps, at = [], 0
    while at < len(path):
        left, right = path[at] * DIGEST, path[at + 1] * DIGEST
        steps.append((path[at + 2 : at + 2 + left], path[at + 2 + left : at + 2 + left + right]))
        at += 2 + left + right
    return steps


# Rounds of subtrees ---------------------------------------------------------------------------------------------------


def _subtrees(leaves: DataFrame, height: int) -> DataFrame:
    """(tree, rank, size, digest) -> (tree, block, size, leaves, nodes, root): a row per aligned subtree."""
    span = ARITY**height

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), rows in sorted_groups(batches, ("tree", "block")):
            size = int(rows["size"][0])
            made = Subtree.build(rows["digest"].tolist(), height_of(size, height))
            yield pa.RecordBatch.from_pylist([{"tree": tree, "block": int(block), "size": size, "leaves": len(rows["rank"]), "nodes": made.nodes.tobytes(), "root": made.root}], schema)

    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("leaves", pa.int64()), ("nodes", pa.binary()), ("root", pa.binary())])
    dealt = leaves.select("tree", F.floor(F.col("rank") / span).alias("block"), "rank", "size", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
    return dealt.mapInArrow(build, "tree string, block long, size long, leaves long, nodes binary, root binary")


def rounds(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Subtrees of all trees, round by round, each written; a tree ends in the round in which it has one."""
    span, out = ARITY**height, []
    largest = leaves.agg(F.max("size").alias("n")).first()["n"] or 0
    while True:
        out.append(written(_subtrees(leaves, height), "op11-subtrees"))
        if largest <= span:
            return out
        leaves = out[-1].where(F.col("size") > span).select("tree", F.col("block").alias("rank"), F.ceil(F.col("size") / span).alias("size"), F.col("root").alias("digest"))
        largest = -(-largest // span)


def roots(levels: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """(tree, root)."""
    whole = [level.where(F.col("size") <= ARITY**height).select("tree", "root") for level in levels]
    out = whole[0]
    for more in whole[1:]:
        out = out.unionByName(more)
    return out


def _leaf_paths(subtrees: DataFrame, height: int) -> DataFrame:
    """Subtrees with the path above them -> (tree, rank, subroot, path) of each of their leaves."""
    span = ARITY**height

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _read(row, height)
                runs, paths = own.siblings(), []
                for k in range(row["leaves"]):
                    steps, index = [], k
                    for level in runs:
                        steps.append(step(level[index // ARITY], index % ARITY))
                        index //= ARITY
                    paths.append(packed(steps) + row["path"])
                first = row["block"] * span
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * len(paths)), pa.array(range(first, first + len(paths)), pa.int64()), pa.array([row["subroot"]] * len(paths), pa.binary()), pa.array(paths, pa.binary())], ["tree", "rank", "subroot", "path"])

    return subtrees.mapInArrow(descend, "tree string, rank long, subroot binary, path binary")


def _read(row: dict, height: int) -> Subtree:
    return Subtree(height_of(row["size"], height), row["leaves"], np.frombuffer(row["nodes"], np.uint8).reshape(-1, DIGEST))


def paths_above(levels: list[DataFrame], tops: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The subtrees of the first round with ``subroot`` and ``path``, the steps above each; ``tops`` (tree, subroot, path) has those above the trees."""
    span, below = ARITY**height, None
    for level in reversed(levels):
        met = level.where(F.col("size") <= span).join(tops, "tree")
        if below is not None:
            met = met.unionByName(level.where(F.col("size") > span).join(below, ["tree", "block"]))
        if level is levels[0]:
            return met
        below = written(_leaf_paths(met, height).withColumnRenamed("rank", "block"), "op11-paths")
    raise ValueError("no rounds")


# The manifest ---------------------------------------------------------------------------------------------------------


def framed(*columns: Column) -> Column:
    """The digest of columns: ``-`` for null, else the count of bytes, a colon and the value."""
    parts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts]), 256))


def tampered_text(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def manifest(docs: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, list[DataFrame], list[DataFrame], bytes | None]:
    """(rows with their place and digests, rounds of the sources, rounds above them, root)."""
    leaf = framed(*[F.col(c) for c in COLUMNS])
    picked = F.crc32(F.col("doc_id").cast("string")) % TAMPERED_ONE_IN == 0
    other = F.when(picked & F.col("text").isNotNull(), framed(*[F.col(c) for c in COLUMNS[:-1]], tampered_text(F.col("text"))))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # "" sorts before all others
    rows = docs.select("doc_id", tree.alias("tree"), leaf.alias("digest"), other.alias("changed"), F.monotonically_increasing_id().alias("row"))
    placed = written(ranked(written(rows, "op11-rows"), "tree", ["doc_id", "digest", "row"], "op11-order"), "op11-leaves")
    sources = rounds(placed, height)
    subroots = ranked(roots(sources, height).select(F.lit("").alias("all"), F.col("tree").alias("source"), F.col("root").alias("digest")), "all", ["source"], "op11-subroots")
    subroots = written(subroots, "op11-tops").withColumnRenamed("all", "tree")
    above = rounds(subroots, height)
    top = roots(above, height).first()
    tops = paths_above(above, above[0].select("tree", F.lit(b"").alias("subroot"), F.lit(b"").alias("path")).distinct(), height) if top else above[0]
    paths = _leaf_paths(tops, height) if top else None
    named = written(paths.drop("tree", "subroot").join(subroots.select("rank", F.col("source").alias("tree"), F.col("digest").alias("subroot")), "rank").drop("rank"), "op11-tops") if top else None
    return placed, sources, named, bytes(top["root"]) if top else None


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verify(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified."""
    placed, sources, tops, root = manifest(docs, height)
    if root is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    span = ARITY**height
    subtrees = paths_above(sources, tops, height).select("tree", "block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("rank"), "size", "leaves", "nodes", "subroot", "path", *[F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("digest", "binary"), ("changed", "binary"))])
    rows = placed.select("tree", F.floor(F.col("rank") / span).alias("block"), F.lit(1).alias("kind"), "rank", *[F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("leaves", "long"), ("nodes", "binary"), ("subroot", "binary"), ("path", "binary"))], F.col("doc_id").cast("long").alias("doc_id"), "digest", "changed")
    dealt = subtrees.unionByName(rows).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "rank")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, above, proof_above, subroot = [], [], b"", ""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not row["kind"]:
                    runs, above, subroot = _read(row, height).siblings(), unpacked(row["path"]), row["subroot"].hex()
                    proof_above = b"".join(hexlify(left + right) for left, right in above)
                    continue
                proof, digest, index = sha256(), row["changed"] or row["digest"], row["rank"] % span
                for level in runs:
                    left, right = step(level[index // ARITY], index % ARITY)
                    proof.update(hexlify(left + right))
                    digest, index = folded(left + digest + right), index // ARITY
                proof.update(proof_above)
                for left, right in above:
                    digest = folded(left + digest + right)
                out.append((row["doc_id"], row["digest"].hex(), subroot, proof.hexdigest(), digest.hex()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), *[pa.string()] * 4))], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    found = dealt.mapInArrow(fold, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    whole = F.lit(root.hex())
    return found.select("doc_id", "leaf", "subroot", whole.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == whole).alias("verified"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(documents(spark, sf_dir))


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || {c}, '-')"
    return "sha256(" + " || ".join(map(part, (*COLUMNS[:-1], text))) + ")"


def _fold_sql(name: str, levels: int) -> str:
    """Tables {name}1, {name}2, ... that fold {name}0 (tree, r, d, n) level by level, and what lies beside each node of a level."""
    out = []
    for k in range(levels):
        run = "partition by tree, r // 16 order by r rows between"
        out.append(f"{name}w{k} as (select tree, r, n, coalesce(string_agg(d, '') over ({run} unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(d, '') over ({run} 1 following and unbounded following), '') as g from {name}{k})")
        out.append(f"{name}{k + 1} as (select tree, r // 16 as r, case when n = 1 then max(d) else sha256(string_agg(d, '' order by r)) end as d, (n + 15) // 16 as n from {name}{k} group by tree, r // 16, n)")
    return ", ".join(out)


def _climb_sql(start: str, name: str, tree: str, rank: str, levels: int) -> str:
    out = []
    for k in range(levels):
        of = start if not k else f"{name}x{k - 1}"
        out.append(f"{name}x{k} as (select x.* replace (case when n = 1 then f else sha256(l || f || g) end as f, p || l || g as p) from {of} x join {name}w{k} w on w.tree = x.{tree} and w.r = x.{rank} // {16**k})")
    return ", ".join(out)


ORACLE = f"""
with {CRC_STEPS},
t as (select doc_id, coalesce('=' || source, '') as tree, {_leaf_sql("text")} as leaf,
        case when {crc32("cast(doc_id as varchar)")} % 5 = 0 then {_leaf_sql(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} end as changed from documents, crc),
s as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as r, count(*) over (partition by tree) as n from t),
a0 as (select tree, r, leaf as d, n from s), {_fold_sql("a", 5)},
o as (select tree, d, row_number() over (order by encode(tree)) - 1 as place, count(*) over () as n from a5),
b0 as (select 0 as tree, place as r, d, n from o), {_fold_sql("b", 4)},
start as (select s.doc_id, s.leaf, s.tree, s.r as own, coalesce(changed, leaf) as f, '' as p, 0 as everything, place, d as subroot from s join o on o.tree = s.tree),
{_climb_sql("start", "a", "tree", "own", 5)}, {_climb_sql("ax4", "b", "everything", "place", 4)}
select doc_id, leaf, subroot, (select d from b4) as root, sha256(p) as proof_sha256, f as folded_root, f = (select d from b4) as verified from bx3"""
