"""The corpus pipeline: documents in, encoded training mix out.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents.

1. language ID drops documents that the classifier rejects: those without a letter, and those whose best language
   has a posterior below ``LEAST_SCORE``.
2. exact deduplication keeps one document of each group of equal texts.
3. SimHash near-deduplication keeps one document of each group.  Fingerprints of the distinct words within 3 bits, for
   any of twelve independent ones, give candidates; only texts that share 0.8 or more of their five-word shingles are
   linked (see the README for precision and recall).
4. mixing repeats documents, or leaves them out, so that sources meet their target weights.
5. BPE encodes and decodes what is left, one row per document of the mix.

Rows count one by one: those without an id, or with the id of another row, are judged by their own text.  Of equal or
near-equal rows the one with the smallest id stays (no id comes last) among those that a stage does not rank otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from gradus.llm.common import written

LEAST_SCORE = 0.5
ROW = "__row_key"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs)
    judged = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    kept = language_id.predict(judged, model).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select("__row.*")


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, fixed by writing them; decisions are joined on it, since ids may be null or repeat."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    kept = exact_dedup.exact_dedup(rows, row_col=ROW).where("kept").select(F.col("row").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    groups = near_dedup.near_groups(rows, ROW).select(F.col("row").alias(ROW), "group")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW]
    kept = groups.join(rows.select("doc_id", ROW), ROW).groupBy("group").agg(first.alias(ROW)).select(ROW)
    return rows.join(kept, ROW, "left_semi").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    mixed = mixing.mix(rows.withColumn("__tie", F.coalesce(F.col("doc_id"), ROW)), ROW, tie_col="__tie")
    copies = mixed.where("copies > 0").select(F.col("doc_id").alias(ROW), F.col("copies").alias("__copies"))
    repeated = rows.join(copies, ROW).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return repeated.select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(docs, keep_ids=False)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: Naive Bayes, fingerprints, rounding and BPE are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
