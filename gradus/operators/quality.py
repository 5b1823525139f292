"""The data-quality contract: a row (check_id, column, observed, threshold, passed) per check.

All checks of values are one aggregation of the table; checks of the schema count what is filled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Check:
    id: str
    column: str
    observed: Column
    threshold: str
    passed: Column


def _text(number: Column) -> Column:
    return F.coalesce(number.cast("string"), F.lit("null"))


def _bad(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def row_count(least: int = 1, id: str = "row_count") -> Check:
    n = F.count("*")
    return Check(id, "*", _text(n), f">={least}", n >= least)


def domain(column: str, values: Sequence[object], nulls_fail: bool = True) -> Check:
    """Membership; with ``nulls_fail`` null is no member, else it is ignored."""
    outside = F.coalesce(~F.col(column).isin(*values), F.lit(nulls_fail))
    return Check("domain", column, _text(_bad(outside)), "0", _bad(outside) == 0)


def null_ratio(column: str, limit: float = 0.01) -> Check:
    ratio = F.avg(F.col(column).isNull().cast("double"))
    return Check("null_ratio", column, _text(F.round(ratio, 6).cast("decimal(20,6)")), f"<{limit}", F.coalesce(ratio < limit, F.lit(False)))


def value_range(column: str, low: float, high: float) -> Check:
    """Minimum and maximum within bounds; a column of nulls fails."""
    a, b = F.min(column), F.max(column)
    seen = F.concat(_text(a.cast("decimal(20,2)")), F.lit(".."), _text(b.cast("decimal(20,2)")), F.lit(" nulls="), _bad(F.col(column).isNull()).cast("string"))
    return Check("range", column, seen, f"{low}..{high}", F.coalesce((a >= low) & (b <= high), F.lit(False)))


def minimum(column: str, least: float) -> Check:
    a = F.min(column)
    return Check("minimum", column, _text(a.cast("decimal(20,2)")), f">={least}", F.coalesce(a >= least, F.lit(False)))


def no_blank(column: str) -> Check:
    n = _bad(F.col(column).isNull() | (F.length(column) == 0))
    return Check("no_blank", column, _text(n), "0", n == 0)


def code_format(column: str, pattern: str) -> Check:
    n = _bad(F.coalesce(~F.col(column).rlike(pattern), F.lit(False)))
    return Check("format", column, _text(n), "0", n == 0)


def non_negative(column: str) -> Check:
    a = F.min(column)
    return Check("non_negative", column, _text(a.cast("decimal(20,2)")), ">=0", F.coalesce(a >= 0, F.lit(False)))


def verify(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All checks of values in one pass."""
    rows = [F.struct(F.lit(c.id).alias("check_id"), F.lit(c.column).alias("column"), c.observed.alias("observed"), F.lit(c.threshold).alias("threshold"), c.passed.alias("passed")) for c in checks]
    return df.agg(F.array(*rows).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def schema_checks(df: DataFrame, required: Sequence[str] = (), forbidden: Sequence[str] = (), types: Mapping[str, str] | None = None, width: int = 0) -> DataFrame:
    """Columns present, absent, of their types (a missing column fails), and how many.

    What is observed comes with the number of rows that hold a value, counted in one pass.
    """
    have = dict(df.dtypes)

    def row(id: str, column: str, seen: str, threshold: str, passed: bool) -> Column:
        filled = F.count(column) if column in have else F.count("*") if column == "*" else F.lit(0)
        return F.struct(F.lit(id).alias("check_id"), F.lit(column).alias("column"), F.concat(F.lit(f"{seen} filled="), filled.cast("string")).alias("observed"), F.lit(threshold).alias("threshold"), F.lit(passed).alias("passed"))

    rows = [row("required", c, str(c in have).lower(), "true", c in have) for c in required]
    rows += [row("forbidden", c, str(c in have).lower(), "false", c not in have) for c in forbidden]
    rows += [row("type", c, have.get(c, "missing"), t, have.get(c) == t) for c, t in (types or {}).items()]
    rows += [row("width", "*", str(len(have)), str(width), len(have) == width)] if width else []
    return df.agg(F.array(*rows).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def source_exists(spark: SparkSession, path: str, least_bytes: int = 1) -> DataFrame:
    """Whether a Parquet source can be read and has a minimum size."""
    from gradus.sources.io import file_inventory

    size = file_inventory(spark, path).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return size.select(F.lit("source").alias("check_id"), F.lit("*").alias("column"), F.col("bytes").cast("string").alias("observed"), F.lit(f">={least_bytes}").alias("threshold"), (F.col("bytes") >= least_bytes).alias("passed"))


def reconcile(df: DataFrame, source: DataFrame, limit: float = 0.99) -> DataFrame:
    """Rows kept of a source's rows."""
    counts = df.agg(F.count("*").alias("a")).join(source.agg(F.count("*").alias("b")))  # a row each
    ratio = F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0)
    return counts.select(F.lit("reconcile").alias("check_id"), F.lit("*").alias("column"), F.concat_ws("/", "a", "b").alias("observed"), F.lit(f">{limit}").alias("threshold"), (ratio > limit).alias("passed"))


def compression(spark: SparkSession, path: str, source_bytes: int, limit: float = 0.5) -> DataFrame:
    """Bytes saved against the source."""
    from gradus.sources.io import file_inventory

    saved = 1 - F.sum("bytes") / F.lit(float(source_bytes))
    return file_inventory(spark, path).agg(saved.alias("r")).select(F.lit("compression").alias("check_id"), F.lit("*").alias("column"), F.round("r", 4).cast("string").alias("observed"), F.lit(f">{limit}").alias("threshold"), (F.col("r") > limit).alias("passed"))


def summary(checks: DataFrame) -> DataFrame:
    """(total, passed, failed, failures, status)."""
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.concat_ws(":", "check_id", "column")))), ",")
    hits = F.sum(F.col("passed").cast("long"))
    return checks.agg(F.count("*").alias("total"), hits.alias("passed"), (F.count("*") - hits).alias("failed"), failed.alias("failures"), F.when(F.count("*") == hits, "PASS").otherwise("FAIL").alias("status"))
