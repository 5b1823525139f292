"""Profiles and distributions.

Each is one pass with map-side aggregation; totals are windows over the few aggregated rows, never over the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gradus.functions.expressions import band, band_rank


def _rounded(c: Column) -> Column:
    return F.round(c, 6) + 0.0


def _all() -> WindowSpec:
    return Window.partitionBy()


def exact_quantiles(df: DataFrame, cols: Sequence[str], at: Sequence[float], accuracy: int = 1000) -> DataFrame:
    """(column, q): per column the exact quantiles ``at``, interpolated as ``percentile`` does; null where there is no value.

    A sketch of bounded size gives two breaks around each quantile.  They cut each column into regions, whose rows are
    counted, with map-side combine; the wanted ranks then fall into few regions, mostly those between two breaks of one
    quantile, and only rows of these are counted by value and shuffled.  Whatever the sketch is worth, ranks are
    exact: it only decides how many rows are in those regions.  Null is left out, and NaN is larger than any number.
    """
    span = 2 / accuracy
    near = F.array(*[F.lit(min(max(p + d, 0.0), 1.0)) for p in at for d in (-span, span)])
    breaks = df.agg(*[F.percentile_approx(F.col(c).cast("double"), near, F.lit(accuracy)).alias(f"__b{k}") for k, c in enumerate(cols)])
    value = [F.col(c).cast("double") for c in cols]
    region = lambda k: sum(((value[k] > F.col(f"__b{k}")[j]).cast("int") for j in range(2 * len(at))), F.lit(0))
    items = [F.struct(F.lit(k).alias("k"), region(k).alias("region"), (value[k] + 0.0).alias("v")) for k in range(len(cols))]
    long = df.join(F.broadcast(breaks)).select(F.explode(F.array(*items)).alias("i")).select("i.*").where("v is not null")  # a row of breaks
    counts = long.groupBy("k", "region").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("k").orderBy("region")  # a row per region
    run = counts.select("k", "region", "n", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("k")).alias("all"))
    ranks = F.array(*[F.struct(F.lit(j).alias("j"), (F.lit(float(p)) * (F.col("all") - 1)).alias("place")) for j, p in enumerate(at)])
    ends = run.select("*", F.explode(ranks).alias("r")).select("*", F.col("r.j").alias("j"), F.col("r.place").alias("place"), F.explode(F.array(F.floor("r.place"), F.ceil("r.place"))).alias("rank")).distinct()
    wanted = ends.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select("k", "region", "j", "place", "rank", (F.col("rank") - F.col("before")).alias("within"))
    inside = long.join(F.broadcast(wanted.select("k", "region").distinct()), ["k", "region"], "left_semi")  # at most two a quantile
    cells = inside.groupBy("k", "region", "v").agg(F.count("*").alias("c"))
    placed = cells.withColumn("upto", F.sum("c").over(Window.partitionBy("k", "region").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    met = placed.join(F.broadcast(wanted), ["k", "region"]).where((F.col("within") >= F.col("upto") - F.col("c")) & (F.col("within") < F.col("upto")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    part = F.min("place") - F.floor(F.min("place"))
    each = met.groupBy("k", "j").agg(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias("q"))
    found = each.groupBy("k").agg(*[F.max(F.when(F.col("j") == j, F.col("q"))).alias(f"q{j}") for j in range(len(at))])
    names = df.sparkSession.createDataFrame([(k, c) for k, c in enumerate(cols)], "k int, column string")
    return names.join(found, "k", "left").select("column", F.array(*[F.col(f"q{j}") for j in range(len(at))]).alias("q"))


def describe_numeric(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column, rows, nulls, mean, std, min, max, median) per column: one aggregation, and ``exact_quantiles`` unless approximate."""
    median = (lambda c: F.percentile_approx(c, 0.5)) if approximate else (lambda c: F.lit(None))
    stats = lambda c: F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.sum(F.col(c).isNull().cast("long")).alias("nulls"), _rounded(F.avg(c)).alias("mean"), _rounded(F.stddev_samp(c)).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), _rounded(median(F.col(c).cast("double")).cast("double")).alias("median"))
    found = df.agg(F.array(*[stats(c) for c in cols]).alias("all")).select(F.explode("all").alias("s")).select("s.*")
    if approximate:
        return found
    return found.drop("median").join(F.broadcast(exact_quantiles(df, cols, [0.5])), "column").select("*", _rounded(F.col("q")[0]).alias("median")).drop("q")


def value_counts(df: DataFrame, col: str, k: int | None = None, pct_of: str = "all") -> DataFrame:
    """(value, n, pct), most frequent first; percentages of all rows or of those shown."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    if pct_of == "all":
        counts = counts.withColumn("total", F.sum("n").over(_all()))
    top = counts.orderBy(F.desc("n"), "value")
    top = top.limit(k) if k else top
    if pct_of != "all":
        top = top.withColumn("total", F.sum("n").over(_all()))
    return top.select("value", "n", _rounded(100.0 * F.col("n") / F.col("total")).alias("pct"))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, pct) of every column."""
    one = lambda c: F.struct(F.lit(c).alias("column"), F.sum(F.col(c).isNull().cast("long")).alias("nulls"), _rounded(100.0 * F.avg(F.col(c).isNull().cast("double"))).alias("pct"))
    return df.agg(F.array(*[one(c) for c in df.columns]).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def band_counts(df: DataFrame, score: str, breaks: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """(band, rank, n, pct) in band order."""
    counts = df.select(band(score, breaks, labels).alias("band")).where("band is not null").groupBy("band").agg(F.count("*").alias("n"))
    return counts.select("band", band_rank("band", labels).alias("rank"), "n", _rounded(100.0 * F.col("n") / F.sum("n").over(_all())).alias("pct")).orderBy("rank")


def imbalance_ratio(counts: DataFrame, limit: float = 3.0) -> DataFrame:
    """(largest, smallest, ratio, imbalanced) of class counts ``n``."""
    return counts.agg(F.max("n").alias("largest"), F.min("n").alias("smallest")).select("*", _rounded(F.col("largest") / F.col("smallest")).alias("ratio"), (F.col("largest") / F.col("smallest") > limit).alias("imbalanced"))


def group_mean(df: DataFrame, keys: Sequence[str], value: str, min_n: int = 100) -> DataFrame:
    """(keys, mean, n) of groups with more than ``min_n`` rows."""
    return df.groupBy(*keys).agg(_rounded(F.avg(value)).alias("mean"), F.count("*").alias("n")).where(F.col("n") > min_n)


def crosstab(df: DataFrame, rows: str, cols: str, values: Sequence[str]) -> DataFrame:
    """Counts of rows x stated column values, 0 where there are none."""
    return df.groupBy(rows).pivot(cols, list(values)).count().na.fill(0, list(values))


def row_share(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row-normalised percentages; null for a row of zeros."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return table.withColumns({c: _rounded(100.0 * F.col(c) / F.nullif(total, F.lit(0))) for c in columns})


def distinct_per_group(df: DataFrame, key: str, col: str, approximate: bool = False) -> DataFrame:
    """(key, n_distinct): null counts as one value."""
    distinct = F.approx_count_distinct(col) if approximate else F.count_distinct(col)
    return df.groupBy(key).agg((distinct + F.max(F.col(col).isNull().cast("long"))).alias("n_distinct"))


def entropy_by_group(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, n, entropy): Shannon entropy in bits of the values of each group."""
    counts = df.groupBy(key, col).agg(F.count("*").alias("c"))
    # sum(-p log2 p) = log2(n) - sum(c log2 c) / n needs no total beside each value
    sums = counts.groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return sums.select(key, "n", _rounded(F.greatest(F.log2("n") - F.col("s") / F.col("n"), F.lit(0.0))).alias("entropy"))


def moments(df: DataFrame, col: str, approximate: bool = False) -> DataFrame:
    """(n, mean, median, skewness, kurtosis): population skewness, excess kurtosis."""
    median = F.percentile_approx(F.col(col).cast("double"), F.array(F.lit(0.5)), F.lit(10_000)) if approximate else F.lit(None)
    found = df.agg(F.count(col).alias("n"), _rounded(F.avg(col)).alias("mean"), median.alias("q"), _rounded(F.skewness(col)).alias("skewness"), _rounded(F.kurtosis(col)).alias("kurtosis"))
    if not approximate:
        found = found.drop("q").join(F.broadcast(exact_quantiles(df, [col], [0.5])))  # a row each
    return found.select("n", "mean", _rounded(F.col("q")[0]).alias("median"), "skewness", "kurtosis")


def histogram(df: DataFrame, col: str, bins: int, value_range: tuple[float, float] | None = None, density: bool = False, by: str | None = None) -> DataFrame:
    """(by, bin, low, n or density): equal-width bins; the last one is closed.  Without a range, that of the data."""
    keys = [by] if by else []
    if value_range:
        low, high = (F.lit(float(x)) for x in value_range)
        rows = df
    else:
        ends = df.agg(F.min(col).cast("double").alias("__low"), F.max(col).cast("double").alias("__high"))
        rows, low, high = df.join(F.broadcast(ends)), F.col("__low"), F.col("__high")  # one row
    width = F.when(high > low, (high - low) / bins).otherwise(F.lit(1.0 / bins))
    place = F.least(F.floor((F.col(col).cast("double") - low) / width), F.lit(bins - 1)).cast("int")
    counts = rows.where((F.col(col) >= low) & (F.col(col) <= high)).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"), F.min(_rounded(low + place * width)).alias("low"), F.min(width).alias("__width"))
    if not density:
        return counts.select(*keys, "bin", "low", "n")
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.select(*keys, "bin", "low", F.round(F.col("n") / total / F.col("__width"), 12).alias("density"))


def box_stats(df: DataFrame, key: str, col: str, approximate: bool = False) -> DataFrame:
    """(key, q1, median, q3, low, high, outliers): whiskers are the furthest values within 1.5 IQR of the box.

    Values are counted by (key, value) once, with map-side combine, and boxes and whiskers both come from those counts; boxes go
    back to them by a join that adaptive execution makes a broadcast where there are few.  Nothing runs while the plan is built.
    """
    value = F.col("__v")
    counts = df.groupBy(key, F.col(col).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    ends = F.array(*map(F.lit, (0.25, 0.5, 0.75)))
    quartiles = F.percentile_approx(value, ends, F.lit(10_000)) if approximate else F.percentile(value, ends, F.col("__c"))
    of = df.select(key, F.col(col).cast("double").alias("__v")) if approximate else counts  # the approximate form has no weights
    box = of.groupBy(F.col(key).alias("__key")).agg(quartiles.alias("q")).withColumn("__reach", 1.5 * (F.col("q")[2] - F.col("q")[0]))
    inside = (value >= F.col("q")[0] - F.col("__reach")) & (value <= F.col("q")[2] + F.col("__reach"))
    joined = counts.join(box, F.col(key).eqNullSafe(F.col("__key")))
    out = joined.groupBy(key).agg(F.first("q").alias("q"), F.min(F.when(inside, value)).alias("low"), F.max(F.when(inside, value)).alias("high"), F.sum(F.when(~inside, F.col("__c")).when(inside, 0)).alias("outliers"))
    return out.select(key, *[_rounded(F.col("q")[k]).alias(n) for k, n in enumerate(("q1", "median", "q3"))], _rounded(F.col("low")).alias("low"), _rounded(F.col("high")).alias("high"), "outliers")


def grid_density(df: DataFrame, x: str, y: str, nx: int, ny: int) -> DataFrame:
    """(bx, by, n) on an equal grid over the range of both."""
    ends = df.agg(*[f(c).cast("double").alias(f"__{n}_{a}") for a, c in (("x", x), ("y", y)) for n, f in (("low", F.min), ("high", F.max))])
    place = lambda c, a, n: F.least(F.floor((F.col(c).cast("double") - F.col(f"__low_{a}")) / F.when(F.col(f"__high_{a}") > F.col(f"__low_{a}"), (F.col(f"__high_{a}") - F.col(f"__low_{a}")) / n).otherwise(1.0)), F.lit(n - 1)).cast("int")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(F.broadcast(ends)).groupBy(place(x, "x", nx).alias("bx"), place(y, "y", ny).alias("by")).agg(F.count("*").alias("n"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) of the lower triangle, rows with both values, in one aggregation."""
    one = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias("r"))
    pairs = [one(a, b) for i, a in enumerate(cols) for b in cols[:i]]
    return df.agg(F.array(*pairs).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def rank_correlations(df: DataFrame, target: str, cols: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """(column, r) by strength of correlation with the target."""
    one = lambda c: F.struct(F.lit(c).alias("column"), F.round(F.corr(F.col(c).cast("double"), F.col(target).cast("double")), 6).alias("r"))
    wanted = [c for c in cols if c != target and c not in exclude]
    return df.agg(F.array(*[one(c) for c in wanted]).alias("all")).select(F.explode("all").alias("s")).select("s.*").orderBy(F.desc(F.abs("r")), "column")


def win_rate_by_category(df: DataFrame, category: str, outcome: Column, k: int) -> DataFrame:
    """(category, n, rate) of the k most frequent categories."""
    return df.groupBy(category).agg(F.count("*").alias("n"), _rounded(F.avg(outcome)).alias("rate")).orderBy(F.desc("n"), category).limit(k)


def rate_by_band(df: DataFrame, key: str, predicate: Column) -> DataFrame:
    """(key, n, rate): share of rows for which the predicate holds; unknown counts as no."""
    return df.groupBy(key).agg(F.count("*").alias("n"), _rounded(F.avg(F.coalesce(predicate, F.lit(False)).cast("double"))).alias("rate"))
