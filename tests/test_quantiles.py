"""Exact quantiles by regions against ``percentile``, whatever the sketch is worth."""

import math

import pytest
from pyspark.sql import functions as F

from gradus.operators import aggregates

AT = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("accuracy", [5, 1000])
def test_same_as_percentile(spark, accuracy):
    k = F.col("id")
    rows = spark.range(0, 5001, 1, 5).select((F.xxhash64(k) % 100_000 / 7).alias("a"), (k % 3).alias("b"), F.when(k % 4 > 0, F.exp(k % 700)).alias("c"), F.lit(None).cast("double").alias("d"), F.when(k == 17, F.lit(-2.5)).alias("e"), (k - 1500).alias("f"))
    for df in (rows, rows.limit(2), rows.limit(0)):
        want = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, AT))).alias(c) for c in df.columns]).first()
        got = {r["column"]: r["q"] for r in aggregates.exact_quantiles(df, df.columns, AT, accuracy).collect()}
        assert sorted(got) == sorted(df.columns)
        for c in df.columns:
            assert all((x is None and y is None) or math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-9) for x, y in zip(got[c], want[c] or [None] * len(AT))), c


def test_no_task_holds_all_values(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().replace("percentile_approx", "")
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    assert "percentile(" not in plan(aggregates.describe_numeric(df, ["v"])) and "percentile(" not in plan(aggregates.moments(df, "v"))
