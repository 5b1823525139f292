"""Samples and splits that a hash of key and seed decides, so that every run and every engine draws the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.sources.io import read_prefix


def draw(key: str, seed: int) -> Column:
    """A hexadecimal draw per key; rows that share a key, or have none, share a draw."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"#{seed}")).cast("binary"))


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows; kept as a top-n, without sorting the table."""
    return df.orderBy(draw(key, seed), key).limit(n)


BEYOND = "g"  # sorts after every hexadecimal digit


def _cuts(df: DataFrame, stratum: str, seed: int, key: str, wanted: Callable[[Column], Column], digits: int, listed: int) -> DataFrame:
    """(__label, __n, __cut, __before) of the ``listed`` largest strata.

    ``__cut`` is the bucket of draws (their first digits) in which the stratum's first ``wanted`` rows end, ``__before`` the
    rows in earlier buckets.  Buckets are counted, with map-side combine; rows and draws stay where they are.
    """
    counts = df.select(F.col(stratum).alias("__label"), F.substring(draw(key, seed), 1, digits).alias("__b")).groupBy("__label", "__b").agg(F.count("*").alias("__c"))
    own = Window.partitionBy("__label")
    run = counts.select("*", F.sum("__c").over(own).alias("__all"), F.sum("__c").over(own.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"))
    reached = F.col("__upto") >= wanted(F.col("__all"))
    cuts = run.groupBy("__label").agg(F.max("__all").alias("__n"), F.coalesce(F.min(F.when(reached, F.col("__b"))), F.lit(BEYOND)).alias("__cut"), F.sum(F.when(reached, 0).otherwise(F.col("__c"))).alias("__before"))
    return cuts.orderBy(F.desc("__n"), "__label").limit(listed)


def _drawn(df: DataFrame, stratum: str, seed: int, key: str, wanted: Callable[[Column], Column], digits: int, listed: int) -> DataFrame:
    """The rows with their draw, its bucket and the cut of their stratum, without a shuffle.

    Cuts are broadcast: they have a row for each of at most ``listed`` strata.  Rows of any other stratum have none.
    """
    rows = df.withColumn("__draw", draw(key, seed)).withColumn("__bucket", F.substring("__draw", 1, digits))
    return rows.join(F.broadcast(_cuts(df, stratum, seed, key, wanted, digits, listed)), F.col(stratum).eqNullSafe(F.col("__label")), "left")


def _within(stratum: str, key: str, wanted: Callable[[Column], Column], *apart: Column) -> Column:
    """Whether a row is one of those still wanted of its stratum, by rank among the rows that no bucket decides."""
    group = Window.partitionBy(stratum, *apart)
    still = wanted(F.coalesce("__n", F.count("*").over(group))) - F.coalesce("__before", F.lit(0))
    return F.row_number().over(group.orderBy("__draw", key)) <= still


def stratified_sample(df: DataFrame, stratum: str, n_per: int, seed: int, key: str, digits: int = 3, listed: int = 10_000) -> DataFrame:
    """Exactly min(n_per, size) rows of each stratum, those with the smallest draws; rows without a stratum are left out.

    A first pass counts draws in ``16 ** digits`` buckets, which gives each of the ``listed`` largest strata the bucket in which
    its sample ends.  In the second, rows of later buckets are dropped where they are read, and what survives (the sample and
    the rest of one bucket) is shuffled once; rank decides in that bucket only, so no window holds a stratum.  A stratum that
    is not listed holds less than ``1 / listed`` of the rows and is ranked whole.  Nothing runs while the plan is built.
    """
    wanted = lambda n: F.lit(n_per)
    rows = _drawn(df.where(F.col(stratum).isNotNull()), stratum, seed, key, wanted, digits, listed)
    sure = F.coalesce(F.col("__bucket") < F.col("__cut"), F.lit(False))
    survivors = rows.where(F.col("__n").isNull() | (F.col("__bucket") <= F.col("__cut")))
    kept = survivors.withColumn("__in", sure | _within(stratum, key, wanted, F.when(sure, F.col("__bucket"))))
    return kept.where("__in").select(df.columns)


def shuffle(df: DataFrame, seed: int, key: str) -> DataFrame:
    return df.orderBy(draw(key, seed), key)


def prefix_stratified(spark, path: str, n_file: int, stratum: Column, n_per: int, seed: int, key: str) -> DataFrame:
    """A stratified sample of the first rows of each file."""
    return stratified_sample(read_prefix(spark, path, n_file).withColumn("stratum", stratum), "stratum", n_per, seed, key)


def sample_report(df: DataFrame, sample: DataFrame, stratum: str, least: int = 1) -> DataFrame:
    """(stratum, population, sampled, covered)."""
    count = lambda d, name: d.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count("*").alias(name))
    both = count(df, "population").join(count(sample, "sampled"), stratum, "full_outer").na.fill(0, ["population", "sampled"])
    return both.withColumn("covered", F.col("sampled") >= F.least(F.col("population"), F.lit(least)))


def stratified_split(df: DataFrame, label: str, test: float, seed: int, key: str, digits: int = 3, listed: int = 10_000) -> DataFrame:
    """``is_test`` for round(test * n) rows of each class: those whose draws come first.  Null is a class of its own.

    As in ``stratified_sample``: all rows but those of the bucket in which a class's test rows end are decided where they are
    read, without a shuffle; only that bucket's, and those of classes beyond the ``listed`` largest, are ranked.
    """
    wanted = lambda n: F.floor(n * test + 0.5)
    rows = _drawn(df, label, seed, key, wanted, digits, listed)
    decided = F.col("__n").isNotNull() & (F.col("__bucket") != F.col("__cut"))
    clear = rows.where(decided).withColumn("is_test", F.col("__bucket") < F.col("__cut"))
    ranked = rows.where(~decided).withColumn("is_test", _within(label, key, wanted))
    return clear.unionByName(ranked).select(*df.columns, "is_test")


def temporal_split(df: DataFrame, month: Column, train: Sequence[str], validation: Sequence[str]) -> DataFrame:
    """``split``: train or validation by month; rows of other months are left out."""
    part = F.when(month.isin(*train), "train").when(month.isin(*validation), "validation")
    return df.withColumn("split", part).where("split is not null")


def content_hash(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(rows, checksum) of the keys, whatever their order."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.sum(number).alias("checksum"))


def chi_square_representative(population: DataFrame, sample: DataFrame, stratum: str) -> DataFrame:
    """(chi_square, df): goodness of fit of the sample's strata to the population's."""
    report = sample_report(population, sample, stratum)
    expected = F.col("population") * F.sum("sampled").over(Window.partitionBy()) / F.sum("population").over(Window.partitionBy())
    return report.select(((F.col("sampled") - expected) ** 2 / expected).alias("part")).agg(F.round(F.sum("part"), 6).alias("chi_square"), (F.count("*") - 1).alias("df"))
