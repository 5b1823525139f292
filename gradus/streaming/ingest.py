"""Incremental ingest of newly arrived record files, with the same three-way split as the batch."""

from __future__ import annotations

import time
import uuid
from collections import deque

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from gradus.operators.ingest import QualityRules, parse_records, part_of, quality_filter, read_part, write_parts
from gradus.sources.records import RecordFiles


def read_record_stream(spark: SparkSession, path: str, start: str = "[Event ", gap: str = "\n\n") -> DataFrame:
    text = spark.readStream.option("lineSep", gap + start).text(path).withColumnRenamed("value", "record").where(F.trim("record") != "")
    whole = F.when(F.col("record").startswith(start), F.col("record")).otherwise(F.concat(F.lit(start), F.col("record")))
    return text.select(F.regexp_replace(F.regexp_replace(whole, "\r\n", "\n"), r"^\s+|\s+$", "").alias("record"))


def read_frame_stream(spark: SparkSession, path: str, frames: int | None = None) -> DataFrame:
    """Records of zstd files (a glob) by frame: frames that are appended to a file arrive like files of their own."""
    spark.dataSource.register(RecordFiles)
    source = spark.readStream.format("record_files").option("path", path)
    return (source.option("frames", frames) if frames else source).load()


def ingest_stream(spark: SparkSession, path: str, out: str, checkpoint: str, rules: QualityRules = QualityRules(), zstd_frames: bool = False):
    """Start the ingest of what has arrived; returns the running query.  The path is that of plain files, or of zstd files by frame.

    Each batch is read and parsed once: one job writes its three parts to its own folder, replacing it if the batch is run
    again, so a restart loses and doubles nothing, and counts what passes by (``observe``).  Counts and time go to
    ``progress``, beside those of the other batches.
    """

    def land(batch: DataFrame, number: int) -> None:
        began, seen = time.monotonic(), Observation(f"ingest-{uuid.uuid4().hex}")
        judged = quality_filter(parse_records(batch), rules)
        counts = [F.count(F.lit(1)).alias("input_rows"), *[F.count_if(part_of() == part).alias(part) for part in ("usable", "skipped", "errors")]]
        write_parts(judged.observe(seen, *counts), f"{out}/rows/batch={number}")
        met, seconds = seen.get, time.monotonic() - began
        row = (met["input_rows"], met["usable"], met["skipped"], met["errors"], seconds, met["input_rows"] / seconds)
        spark.createDataFrame([row], COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{out}/progress/batch={number}")

    stream = read_frame_stream(spark, path) if zstd_frames else read_record_stream(spark, path)
    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


COUNTS = "input_rows long, usable long, skipped long, errors long, seconds double, rows_per_second double"


def ingested(spark: SparkSession, out: str, part: str = "usable") -> DataFrame:
    """The rows of one part of all batches that landed, with their ``batch``."""
    return read_part(spark, f"{out}/rows", part)


def ingest_progress(spark: SparkSession, out: str) -> DataFrame:
    """(batch, input_rows, usable, skipped, errors, seconds, rows_per_second) of all batches that landed, restarts included."""
    return spark.read.schema(f"{COUNTS}, batch long").parquet(f"{out}/progress").select("batch", "input_rows", "usable", "skipped", "errors", "seconds", "rows_per_second")


class ProgressLog(StreamingQueryListener):
    """What Spark reports of running streams: the last ``most`` batches as (name, batch, input_rows, rows_per_second, seconds)."""

    def __init__(self, most: int = 1000):
        self.batches: deque[tuple[str | None, int, int, float, float]] = deque(maxlen=most)
        self.ended: deque[tuple[str, str | None]] = deque(maxlen=most)  # (id of the run, exception if it failed)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond, p.durationMs.get("triggerExecution", 0) / 1000))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append((str(event.runId), event.exception))
