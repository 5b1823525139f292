"""Joins with small sides, set comparison, sorts and top-k."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """(keys, n): the k most frequent keys; ties go to the smaller key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(k)


def semi_join_topk(df: DataFrame, col: str, k: int) -> DataFrame:
    """Rows whose key is among the k most frequent; the k keys are broadcast."""
    return df.join(F.broadcast(top_k(df, [col], k).select(col)), col, "left_semi")


def lookup_map(df: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Left join with a lookup table that has one row per key; Spark broadcasts it if its size allows."""
    return df.join(small, key, "left")


def hconcat_features(dfs: Sequence[DataFrame], key: str) -> DataFrame:
    """Columns of several tables side by side, by key rather than by position."""
    return reduce(lambda a, b: a.join(b, key), dfs)


def set_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): which keys are in one table only, and which in both."""
    left, right = a.select(key).distinct().withColumn("__a", F.lit(True)), b.select(key).distinct().withColumn("__b", F.lit(True))
    side = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b").otherwise("both")
    return left.join(right, key, "full_outer").select(key, side.alias("side"))


def zero_fill_levels(df: DataFrame, key: str, levels: Sequence[str], value: str = "n") -> DataFrame:
    """One row for each level, with 0 where the table has none."""
    named = df.sparkSession.createDataFrame([(x,) for x in levels], f"{key} string")
    return named.join(df.select(key, value), key, "left").na.fill(0, [value])


def top_k_per_group(df: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """(group, key, n, rank): the k most frequent keys of each group; the window sees counts only."""
    counts = df.groupBy(group, key).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), key)))
    return ranked.where(F.col("rank") <= k)


def sort_by_rank(df: DataFrame, rank: str = "rank") -> DataFrame:
    return df.orderBy(rank)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)
