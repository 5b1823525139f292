"""What the operators share: reading tables, the shared folder, and words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.sources.io import scratch

#: The characters that separate words, and the pattern of a word.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """A text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], T]) -> T:
    """What a worker process keeps from task to task, one thing at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Drop what an earlier stage kept: Spark gives its workers to one stage after another, and their memory adds up."""
    _kept.clear()


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Groups of consecutive rows with equal keys, as columns, from the batches of a sorted partition.

    Whole numbers become numpy arrays, lists of them arrays of such; other types, and columns with nulls, arrays of objects.
    A group may span batches.
    """
    held: list[dict[str, np.ndarray]] = []
    held_key: tuple | None = None

    def joined() -> dict[str, np.ndarray]:
        return {k: np.concatenate([part[k] for part in held]) for k in held[0]} if len(held) > 1 else held[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {}
        for name, column in zip(batch.schema.names, batch.columns):
            if pa.types.is_integer(column.type) and not column.null_count:
                columns[name] = column.to_numpy(zero_copy_only=False)
            elif pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type) and not column.null_count:
                flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy())
                columns[name] = np.empty(len(ends), object)
                for k, part in enumerate(np.split(flat, ends[:-1])):
                    columns[name][k] = part
            else:
                columns[name] = np.array([*column.to_pylist(), None], object)[:-1]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, stop in zip(bounds, bounds[1:]):
            key = tuple(columns[k][start] for k in keys)
            if held and key != held_key:
                yield held_key, joined()
                held = []
            held_key = key
            held.append({k: c[start:stop] for k, c in columns.items()})
    if held:
        yield held_key, joined()
