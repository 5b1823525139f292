"""Profiles that are stored by part (a month, a file) and merged: quantiles, distinct counts, set sizes and heavy hitters.

A part is summarised in one aggregation into a row of bounded size: counts and sums that merge exactly, KLL sketches for
quantiles and ranks, HLL sketches for distinct counts, theta sketches for set sizes.  A new or changed part costs one scan of that
part; what is asked of all parts afterwards reads the summaries alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators.relations import top_k, top_k_per_group
from gradus.sources.io import scratch

K, LG_DISTINCT, LG_SET = 800, 14, 14


def rank_error(k: int = K) -> float:
    """Rank error of a KLL sketch's quantile that 99 of 100 stay below (published fit of the sketch)."""
    return 2.446 / k**0.9433


def distinct_error(lg: int = LG_DISTINCT) -> float:
    """Relative standard error of an HLL estimate."""
    return 1.04 / 2 ** (lg / 2)


# Stored profiles ------------------------------------------------------------------------------------------------------


def summarise(df: DataFrame, part: Column, numbers: Sequence[str] = (), distinct: Sequence[str] = (), sets: Sequence[str] = (), k: int = K, lg: int = LG_DISTINCT, lg_set: int = LG_SET) -> DataFrame:
    """A row per part: ``rows``, and of each number n, sum, sum of squares, ends and a KLL sketch, of the others their sketches."""
    number = lambda c: F.col(c).cast("double")
    aggs = [F.count("*").alias("rows")]
    for c in numbers:
        aggs += [F.count(c).alias(f"{c}__n"), F.sum(number(c)).alias(f"{c}__sum"), F.sum(number(c) * number(c)).alias(f"{c}__squares"), F.min(number(c)).alias(f"{c}__min"), F.max(number(c)).alias(f"{c}__max"), F.kll_sketch_agg_double(number(c), k).alias(f"{c}__kll")]
    aggs += [F.hll_sketch_agg(F.col(c), lg).alias(f"{c}__hll") for c in distinct] + [F.theta_sketch_agg(F.col(c), lg_set).alias(f"{c}__theta") for c in sets]
    return df.groupBy(part.alias("part")).agg(*aggs)


def store(summaries: DataFrame, path: str) -> None:
    """Write summaries by part: a part that is there already is replaced, all others stay."""
    summaries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def merged(spark: SparkSession, path: str, by: Column | None = None, parts: Sequence[str] | None = None) -> DataFrame:
    """The summaries of all parts (or those named), merged into one row, or one for each value of ``by``."""
    stored = spark.read.parquet(path)
    stored = stored.where(F.col("part").cast("string").isin(*parts)) if parts is not None else stored
    merge = {"n": F.sum, "sum": F.sum, "squares": F.sum, "min": F.min, "max": F.max, "kll": F.kll_merge_agg_double, "hll": F.hll_union_agg, "theta": F.theta_union_agg}
    aggs = [F.sum("rows").alias("rows")] + [merge[c.rpartition("__")[2]](F.col(c)).alias(c) for c in stored.columns if "__" in c]
    return (stored.groupBy(by.alias("by")) if by is not None else stored).agg(*aggs)


def stored_numbers(profile: DataFrame, cols: Sequence[str], at: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, n, mean, std, min, max, quantiles) of merged summaries: all but the quantiles are exact."""
    keys = [c for c in profile.columns if c == "by"]

    def one(c: str) -> Column:
        n, total, squares = (F.col(f"{c}__{x}") for x in ("n", "sum", "squares"))
        spread = F.sqrt(F.greatest((squares - total * total / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)))
        quantiles = F.when(n > 0, F.kll_sketch_get_quantile_double(F.col(f"{c}__kll"), F.array(*map(F.lit, at))))
        return F.struct(F.lit(c).alias("column"), n.alias("n"), (total / F.nullif(n, F.lit(0))).alias("mean"), spread.alias("std"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"), quantiles.alias("quantiles"))

    return profile.select(*keys, F.explode(F.array(*map(one, cols))).alias("s")).select(*keys, "s.*")


def stored_density(profile: DataFrame, col: str, bins: int, value_range: tuple[float, float]) -> DataFrame:
    """(by, bin, low, share): share of values in equal bins (closed above, the first below too), from ranks of the sketch."""
    keys, (low, high) = [c for c in profile.columns if c == "by"], value_range
    edges = [low + (high - low) * j / bins for j in range(bins + 1)]
    ranks = F.kll_sketch_get_rank_double(F.col(f"{col}__kll"), F.array(*[F.lit(float(e)) for e in edges]))
    rows = profile.where(F.col(f"{col}__n") > 0).withColumn("__r", ranks)
    share = lambda j: F.element_at("__r", j + 2) - (F.element_at("__r", j + 1) if j else F.lit(0.0))
    each = F.array(*[F.struct(F.lit(j).alias("bin"), F.lit(edges[j]).alias("low"), share(j).alias("share")) for j in range(bins)])
    return rows.select(*keys, F.explode(each).alias("s")).select(*keys, "s.*")


def stored_distinct(profile: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, rows, distinct): estimates of the distinct values other than null."""
    keys = [c for c in profile.columns if c == "by"]
    one = lambda c: F.struct(F.lit(c).alias("column"), F.col("rows").alias("rows"), F.hll_sketch_estimate(F.col(f"{c}__hll")).alias("distinct"))
    return profile.select(*keys, F.explode(F.array(*map(one, cols))).alias("s")).select(*keys, "s.*")


def stored_set_sizes(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """(side, n): estimates of how many values two merged summaries have alone and in common."""
    left, right = a.select(F.col(f"{col}__theta").alias("l")), b.select(F.col(f"{col}__theta").alias("r"))
    sizes = {"only_a": F.coalesce(F.theta_difference("l", "r"), "l"), "only_b": F.coalesce(F.theta_difference("r", "l"), "r"), "both": F.theta_intersection("l", "r")}
    each = F.array(*[F.struct(F.lit(side).alias("side"), F.coalesce(F.theta_sketch_estimate(s), F.lit(0)).alias("n")) for side, s in sizes.items()])
    return left.join(right).select(F.explode(each).alias("s")).select("s.*")  # a row each


# Heavy hitters --------------------------------------------------------------------------------------------------------


def frequent_error(tracked: int) -> float:
    """The share of all rows that a value must exceed to be certain of a place among ``tracked``.

    The summary's map has 4/3 as many slots, rounded up to a power of two; counts are off by at most 3.5 / slots of the rows, and a
    value is named once its least possible count is above that.
    """
    slots = 1 << (max(8, -(-4 * tracked // 3)) - 1).bit_length()
    return 7.0 / slots


def heavy_top_k(df: DataFrame, key: str, k: int, tracked: int = 100_000) -> DataFrame:
    """(key, n): exactly the k most frequent values, ties to the smaller, found among heavy hitters.

    Each task keeps a summary of frequent items, which merge into one of at most ``tracked`` values; these candidates, and no
    others, are then counted exactly.  A value outside them has at most ``frequent_error`` of the rows, so if the k-th candidate
    has more, the answer is that of counting everything, and the shuffle was bounded by the summary whatever the number of values.
    If it has not (values nearly all unlike), everything is counted.  The input is read twice, so write it first if it is costly.
    """
    rows, path = df.where(F.col(key).isNotNull()).select(key), scratch(df.sparkSession, "heavy")
    rows.agg(F.expr(f"approx_top_k(`{key}`, {tracked}, {tracked})").alias("top"), F.count("*").alias("total")).write.parquet(path)
    summary = df.sparkSession.read.parquet(path)
    candidates = summary.select(F.explode("top").alias("t")).select(F.col("t.item").alias(key))
    exact = top_k(rows.join(F.broadcast(candidates), key, "left_semi"), [key], k)  # no more rows than tracked
    found, total = exact.collect(), summary.select("total").first()["total"]  # k rows and one
    if len(found) < k or found[-1]["n"] <= frequent_error(tracked) * total:
        return top_k(df, [key], k)
    nulls = df.where(F.col(key).isNull()).groupBy(key).agg(F.count("*").alias("n"))
    counted = df.sparkSession.createDataFrame(found, exact.schema)
    return counted.unionByName(nulls).orderBy(F.desc("n"), key).limit(k)


def heavy_top_k_per_group(df: DataFrame, group: str, key: str, k: int, tracked: int = 10_000, most: int = 1_000_000) -> DataFrame:
    """(group, key, n, rank): exactly the k most frequent values of each group, as ``top_k_per_group`` finds them.

    As ``heavy_top_k`` for every group at once.  The candidates of all groups are counted exactly; groups whose k-th candidate is
    not certain are counted whole, the others are not.  With more than ``most`` candidates everything is counted.
    """
    rows = df.where(F.col(key).isNotNull()).select(group, key)
    summary = rows.groupBy(group).agg(F.expr(f"approx_top_k(`{key}`, {tracked}, {tracked})").alias("top"), F.count("*").alias("total"))
    path = scratch(df.sparkSession, "heavy")
    summary.write.parquet(path)
    summary = df.sparkSession.read.schema(summary.schema).parquet(path)
    if (summary.agg(F.sum(F.size("top")).alias("n")).first()["n"] or 0) > most:
        return top_k_per_group(df, group, key, k)
    candidates = summary.select(F.col(group).alias("__group"), F.explode("top").alias("t")).select("__group", F.col("t.item").alias("__key"))
    same = F.col(group).eqNullSafe(F.col("__group"))
    nulls = df.where(F.col(key).isNull()).select(group, key)
    ranked = top_k_per_group(rows.join(F.broadcast(candidates), same & (F.col(key) == F.col("__key")), "left_semi").unionByName(nulls), group, key, k)
    # a group is certain if its k-th place lies above what a value outside the candidates may have
    last = ranked.where(F.col("rank") == k).select(F.col(group).alias("__g"), F.col("n").alias("__least"))
    certain = summary.join(last, F.col(group).eqNullSafe(F.col("__g"))).where(F.col("__least") > frequent_error(tracked) * F.col("total")).select(F.col(group).alias("__group"))
    certain = F.broadcast(certain)  # no more rows than candidates
    rest = top_k_per_group(df.join(certain, same, "left_anti"), group, key, k)
    return ranked.join(certain, same, "left_semi").unionByName(rest)
