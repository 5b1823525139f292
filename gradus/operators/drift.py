"""How distributions move between partitions such as months or files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.operators.aggregates import histogram


def band_share_by_partition(df: DataFrame, part: Column, band: Column) -> DataFrame:
    """(part, band, n, pct)."""
    counts = df.select(part.alias("part"), band.alias("band")).where("band is not null").groupBy("part", "band").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("part")), 6))


def density_by_partition(df: DataFrame, part: Column, col: str, bins: int, value_range: tuple[float, float]) -> DataFrame:
    """(part, bin, low, density) over one common range."""
    return histogram(df.withColumn("part", part), col, bins, value_range, density=True, by="part")


def share_delta(shares: DataFrame, a: str, b: str) -> DataFrame:
    """(band, a_pct, b_pct, delta) of two partitions; a band that one lacks has 0 there."""
    side = lambda part, name: shares.where(F.col("part") == part).select("band", F.col("pct").alias(name))
    both = side(a, "a_pct").join(side(b, "b_pct"), "band", "full_outer").na.fill(0.0, ["a_pct", "b_pct"])
    return both.withColumn("delta", F.round(F.col("b_pct") - F.col("a_pct"), 6) + 0.0)
