"""Operator 8: exact deduplication with an extendible-hash index, in DataFrame operations only.

Texts are equal when they are identical after deleting blanks.  The index is built as extendible hashing builds it:

1. every row leaves an entry (id, 64-bit hash, SHA-256, length) in files of the shared folder;
2. the directory starts with one bucket and doubles as long as a bucket with more keys than its capacity has the
   directory's own depth; such buckets split by the next bit of the hash.  A bucket of one key cannot be split, so a
   key with more rows than the capacity gets overflow pages instead, over which its rows are dealt by their position (so
   rows without an id, or with a repeated one, are dealt as well);
3. owner tasks receive ranges of buckets (and their pages), follow the chain of rows with one hash and compare the texts
   byte by byte; the chains are written as bucket files in the order of the buckets, and pages of one key are then put
   together.  Rows find their chain by hash and SHA-256.

With ``index_path`` the directory and the bucket files, texts included, stay there, and ``known`` looks other texts up.

The directory and the list of keys with overflow pages have at most ``2 ** DIRECTORY_BITS`` rows each, whatever the
input (the capacity grows with it), which is why they may be broadcast.  Texts cross the network once.

Edge cases: a null text counts as empty, all empty texts are equal; among equal rows the longest original text stays,
then the smallest id (a null id comes last); rows that repeat an id are separate rows of the same group; an empty table gives an empty
result; other columns are ignored.
A text is a value of one row and is normalised and compared whole, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import documents, text_of, written

DIRECTORY_BITS = 18
CAPACITY = 64


@dataclass
class Bucket:
    prefix: int
    depth: int
    keys: int


def grow_directory(counts: dict[int, int], bits: int, capacity: int) -> list[Bucket]:
    """The directory over ``counts``, keys by their first ``bits`` bits: slot i holds the bucket of prefix i.

    The returned list has ``2 ** depth`` slots; buckets of a smaller depth of their own fill several slots.
    """

    def keys_under(prefix: int, depth: int) -> int:
        return levels[depth].get(prefix, 0)

    levels = [dict(counts)]
    for _ in range(bits):
        above: dict[int, int] = {}
        for prefix, n in levels[0].items():
            above[prefix >> 1] = above.get(prefix >> 1, 0) + n
        levels.insert(0, above)
    depth, directory = 0, [Bucket(0, 0, keys_under(0, 0))]
    while full := {b.prefix: b for b in directory if b.keys > capacity and b.depth == depth and depth < bits}:
        directory = [b for b in directory for _ in range(2)]  # doubling: both new slots still point to one bucket
        depth += 1
        halves = {b: (Bucket(2 * b, depth, keys_under(2 * b, depth)), Bucket(2 * b + 1, depth, keys_under(2 * b + 1, depth))) for b in full}
        directory = [halves[b.prefix][i & 1] if b.prefix in full and b.depth == depth - 1 else b for i, b in enumerate(directory)]
    return directory


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, directory_bits: int = DIRECTORY_BITS, row_col: str | None = None, index_path: str | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and text_sha256 (of the text without blanks).

    With ``row_col``, a number unlike in all rows, it follows as row, and just one row of a group is kept.
    """
    spark = docs.sparkSession
    row = ["row"] if row_col else []
    rows = docs.select(
        *[F.col(row_col).alias(r) for r in row],
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(text_of(text_col)).cast("long").alias("points"),
        F.regexp_replace(text_of(text_col), r"[\x20\x09-\x0D]+", "").alias("norm"),
    ).withColumn("h", F.xxhash64("norm"))
    index = written(rows.select(*row, "doc_id", "points", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "op8-entries")

    n = index.count()
    capacity = max(capacity, n >> directory_bits)
    bits = min(directory_bits, max(1, (n // capacity).bit_length() + 1))
    prefix = F.shiftrightunsigned("h", 64 - bits).alias("prefix")
    keys = written(index.groupBy("h").agg(F.count("*").alias("rows")), "op8-keys")
    counts = {r["prefix"]: r["keys"] for r in keys.groupBy(prefix).agg(F.count("*").alias("keys")).collect()}
    directory = grow_directory(counts, bits, capacity)
    depth = len(directory).bit_length() - 1
    first = {}
    slots = [(i, first.setdefault((b.depth, b.prefix), i)) for i, b in enumerate(directory)]
    lookup = spark.createDataFrame(slots, "slot long, bucket long")
    overflow = keys.where(F.col("rows") > capacity).select("h", F.ceil(F.col("rows") / capacity).alias("pages"))

    slot = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    dealt = (
        rows.withColumn("slot", slot)
        .join(F.broadcast(lookup), "slot")
        .join(F.broadcast(overflow), "h", "left")
        .withColumn("page", F.when(F.col("pages").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), "pages")))
        .select("bucket", "page", "h", "norm", "doc_id", "points", *row)
        .repartitionByRange("bucket", "page")
    )
    best = F.min(F.struct((-F.col("points")).alias("shorter"), F.col("doc_id").isNull().alias("none"), "doc_id", *row)).alias("best")
    text = F.col("norm") if index_path else F.when(F.col("page").isNotNull(), F.col("norm"))
    made = dealt.groupBy("bucket", "page", "h", "norm").agg(F.count("*").alias("rows"), best).select("bucket", "page", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), "rows", "best", text.alias("norm"))
    if index_path:
        made.write.parquet(f"{index_path}/buckets")
        lookup.write.parquet(f"{index_path}/directory")
        chains = spark.read.schema(made.schema).parquet(f"{index_path}/buckets")
    else:
        chains = written(made, "op8-chains")
    whole = chains.where("page is null").select("h", "sha", "rows", "best")
    paged = chains.where("page is not null").groupBy("h", "norm").agg(F.first("sha").alias("sha"), F.sum("rows").alias("rows"), F.min("best").alias("best"))
    groups = whole.unionByName(paged.select("h", "sha", "rows", "best"))
    return index.join(groups, ["h", "sha"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        (F.col("row") == F.col("best.row") if row_col else F.col("doc_id").eqNullSafe(F.col("best.doc_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *row,
    )


def known(docs: DataFrame, index_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of other texts: doc_id and keep_id, the row of the index that has the same text without blanks, or null."""
    spark = docs.sparkSession
    directory = spark.read.parquet(f"{index_path}/directory")
    depth = directory.count().bit_length() - 1
    slot = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_replace(text_of(text_col), r"[\x20\x09-\x0D]+", "").alias("norm")).withColumn("h", F.xxhash64("norm"))
    asked = asked.withColumn("slot", slot).join(F.broadcast(directory), "slot").drop("slot")
    chains = spark.read.parquet(f"{index_path}/buckets").groupBy("bucket", "h", "norm").agg(F.min("best").alias("best"))
    return asked.join(chains, ["bucket", "h", "norm"], "left").select("doc_id", F.col("best.doc_id").alias("keep_id"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id,
       first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id rows between unbounded preceding and unbounded following) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id rows between unbounded preceding and unbounded following) as kept,
       text_sha256
from t"""
