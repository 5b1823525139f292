"""Reading and writing tables, record texts and artifacts."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str, start: str = "[Event ", gap: str = "\n\n") -> DataFrame:
    """One row ``record`` for each multi-line record; records begin with ``start`` after a gap.

    Plain files are split between tasks.  Compressed files are read one per task: write them to Parquet once.  Gaps are
    those of plain line feeds; a file with carriage returns must be normalised first.
    """
    text = spark.read.option("lineSep", gap + start).text(path).withColumnRenamed("value", "record")
    whole = F.when(F.col("record").startswith(start), F.col("record")).otherwise(F.concat(F.lit(start), F.col("record")))
    trimmed = F.regexp_replace(F.regexp_replace(whole, "\r\n", "\n"), r"^\s+|\s+$", "")
    return text.where(F.trim("record") != "").select(trimmed.alias("record"))


def read_large_window_zstd(spark: SparkSession, paths: Sequence[str], start: str = "[Event ", gap: str = "\n\n", window: int = 1 << 31) -> DataFrame:
    """``read_records`` for zstd files whose window is larger than Spark's codec accepts; one task streams each file.

    The paths must be readable from the executors as files.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for batch in batches:
            for path in batch["path"]:
                rest = ""
                with open(path, "rb") as file, zstandard.ZstdDecompressor(max_window_size=window).stream_reader(file) as stream:
                    lines = io.TextIOWrapper(stream, encoding="utf-8", errors="replace")
                    while part := lines.read(1 << 22):
                        *done, rest = (rest + part).replace("\r\n", "\n").split(gap + start)
                        yield pd.DataFrame({"record": [(r if r.startswith(start) else start + r).strip() for r in done if r.strip()]})
                if rest.strip():
                    yield pd.DataFrame({"record": [(rest if rest.startswith(start) else start + rest).strip()]})

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInPandas(read, "record string")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a declared schema; lines that do not parse keep their text in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.option("compression", compression).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), codec: str = "snappy", max_records: int = 0, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).option("compression", codec).option("maxRecordsPerFile", max_records)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, path: str, table: str, key: str, buckets: int) -> None:
    """A table whose files are dealt and sorted by key: tables of one number of buckets join and group by it without a shuffle."""
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)


def scan_parquet(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns) if columns else df


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, bytes, rows, bytes_per_row) of each file."""
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
    return files.withColumn("bytes_per_row", F.round(F.col("bytes") / F.col("rows"), 6))


def read_prefix(spark: SparkSession, path: str, n_per_file: int) -> DataFrame:
    """The first rows of each file."""
    return spark.read.parquet(path).where(F.col("_metadata.row_index") < n_per_file)


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def count_records(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def save_artifacts(spark: SparkSession, artifacts: dict, path: str, version: str) -> None:
    """A small specification (column order, vocabularies, factors) as one JSON row with its version."""
    row = [(version, json.dumps(artifacts, sort_keys=True))]
    spark.createDataFrame(row, "version string, content string").coalesce(1).write.mode("append").json(path)


def load_artifacts(spark: SparkSession, path: str, version: str) -> dict:
    row = spark.read.schema("version string, content string").json(path).where(F.col("version") == version).first()
    if row is None:
        raise KeyError(version)
    return json.loads(row["content"])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where none is set and Spark runs on one machine, as in tests, a temporary folder takes its place; on a cluster
    that is an error, since executors would not see each other's files.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-gradus-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/gradus/{name}-{uuid.uuid4().hex}"
