"""Places of rows in the order of their group, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import written

PART_BITS = 33  # fixed value: monotonically_increasing_id keeps the partition above so many bits


def ranked(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """The rows with ``rank`` (from 0, in their group's order) and ``size`` (rows of the group); ``group`` must not be null.

    Rows are dealt by ranges of (group, order), so a large group covers many tasks, and each is numbered within its range.
    What is numbered over ranges afterwards has a row for each range and group that meet, not for each row.  Rows that are
    equal in all of ``order`` come in any order: make it end with a column that tells rows apart, so that ranges can too.
    """
    columns = df.columns
    placed = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed, name).withColumn("__part", F.shiftrightunsigned("__at", PART_BITS))
    runs = placed.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__in")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    by_group = Window.partitionBy("__group")
    earlier = by_group.orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("__group", "__in", F.col("__first") - F.coalesce(F.sum("__n").over(earlier), F.lit(0)), F.sum("__n").over(by_group).alias("size")).toDF("__group", "__in", "__zero", "size")
    met = placed.join(written(starts, f"{name}-starts"), (F.col(group) == F.col("__group")) & (F.col("__part") == F.col("__in")))
    return met.select(*columns, (F.col("__at") - F.col("__zero")).alias("rank"), "size")
