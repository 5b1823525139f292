"""Mechanisms for tables that do not fit: prefilters, factors, stored sketches, heavy hitters, prefix trees, layouts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import expressions as X
from gradus.operators import aggregates, factorise, features, ingest, relations, sampling, sequences, sketches
from gradus.plans import ingestion
from gradus.plans.binding import banded_orders
from gradus.sources import io
from gradus.streaming import ingest as streaming


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


# Samples


def test_sampling_shuffles_survivors_only(spark, data):
    rows = banded_orders(spark, data, "o_orderpriority")
    before = jobs(spark)
    sample, split = sampling.stratified_sample(rows, "band", 20, 42, "o_orderkey"), sampling.stratified_split(rows, "band", 0.2, 42, "o_orderkey")
    plans = [plan_of(sample), plan_of(split)]
    assert jobs(spark) == before  # nothing runs while the plan is built
    for plan in plans:
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert moved and "BroadcastExchange" in plan and "md5" in plan
    # what is shuffled of the rows: the sample and one bucket a stratum
    wanted = lambda n: F.lit(20)
    drawn = sampling._drawn(rows, "band", 42, "o_orderkey", wanted, 3, 100)
    assert drawn.where(F.col("__bucket") <= F.col("__cut")).count() <= 5 * 20 + 5 * 8
    assert drawn.where(F.col("__bucket") == F.col("__cut")).count() <= 5 * 8


@pytest.mark.parametrize(("digits", "listed"), [(1, 10_000), (3, 10_000), (4, 2), (2, 0)])
def test_samples_with_odd_keys_and_strata(spark, digits, listed):
    """Short strata, keys that repeat or are null, any resolution and number of listed strata: sizes are exact."""
    df = spark.range(3000).withColumns({"s": F.when(F.col("id") % 11 == 0, None).when(F.col("id") < 3, "few").when(F.col("id") % 2 == 0, "even").otherwise("odd"), "key": F.when(F.col("id") % 3 > 0, F.col("id") % 500)})
    sizes = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    for n in (0, 7, 900, 5000):
        got = {r.s: r["count"] for r in sampling.stratified_sample(df, "s", n, 1, "key", digits, listed).groupBy("s").count().collect()}
        assert got == {s: min(n, c) for s, c in sizes.items() if s is not None and min(n, c)}
    got = {(r.s, r.is_test): r["count"] for r in sampling.stratified_split(df, "s", 0.3, 1, "key", digits, listed).groupBy("s", "is_test").count().collect()}
    assert got == {k: v for s, c in sizes.items() for k, v in (((s, True), int(c * 0.3 + 0.5)), ((s, False), c - int(c * 0.3 + 0.5))) if v}


def test_boxes_run_nothing_while_planned(spark, data):
    before = jobs(spark)
    aggregates.box_stats(spark.read.parquet(f"{data}/orders.parquet"), "o_orderpriority", "o_totalprice")
    assert jobs(spark) <= before + 1  # the footer of the file
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0), ("b", 2.0), ("b", 90.0), ("b", 2.0), ("b", 2.5)], "k string, v double")
    got = {r.k: r for r in aggregates.box_stats(rows, "k", "v").collect()}
    assert got[None].median == 2 and got["a"].median is None and got["a"].outliers is None and (got["b"].high, got["b"].outliers) == (2.5, 1)
    assert {r.k: r.outliers for r in aggregates.box_stats(rows, "k", "v", approximate=True).collect()} == {None: 0, "a": None, "b": 1}


# Factors


def matrix(spark, dense):
    at = np.argwhere(dense != 0)
    rows = [(int(i), f"g{j}", float(dense[i, j])) for i, j in at]
    return spark.createDataFrame(rows, "k long, gram string, w double").repartition(4)


def test_factors_of_a_large_vocabulary(spark):
    draw = np.random.default_rng(3)
    dense = np.zeros((120, 50_000))
    for i in range(len(dense)):
        dense[i, draw.integers(0, 50_000, 60)] = draw.random(60)
    dense[:, :40] += draw.random((120, 6)) * [9, 7, 5, 3, 2, 1] @ draw.random((6, 40))
    values, vectors = factorise.fit_svd(matrix(spark, dense), "k", [f"g{j}" for j in range(50_000)], 4)
    _, s, v = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(values, s[:4], rtol=1e-9)
    assert vectors.shape == (50_000, 4) and np.allclose(np.abs(np.sum(vectors * v[:4].T, axis=0)), 1, atol=1e-9)
    assert np.abs(vectors - v[:4].T * np.sign(np.sum(vectors * v[:4].T, axis=0))).max() < 1e-6


def test_factors_of_small_matrices(spark):
    draw = np.random.default_rng(4)
    for n, m, k in ((30, 5, 9), (3, 8, 2), (1, 1, 1)):
        dense = draw.random((n, m))
        values, vectors = factorise.fit_svd(matrix(spark, dense), "k", [f"g{j}" for j in range(m)], k)
        assert np.allclose(values, np.linalg.svd(dense, compute_uv=False)[: min(k, m)], atol=1e-9) and vectors.shape == (m, min(k, m))
        assert (np.abs(vectors).max(axis=0) == vectors.max(axis=0)).all()


# Stored sketches


@pytest.fixture(scope="module")
def readings(spark):
    return spark.range(60_000).select((F.col("id") % 3).cast("string").alias("month"), F.pow(F.rand(1), 3).alias("v"), (F.xxhash64("id") % 20_000).alias("who")).cache()


def test_stored_profiles_merge(spark, readings, tmp_path):
    path = str(tmp_path / "profile")
    for month in ("0", "1", "2", "1"):  # the second month comes again
        sketches.store(sketches.summarise(readings.where(F.col("month") == month), F.col("month"), ["v"], ["who"], ["who"]), path)
    assert spark.read.parquet(path).count() == 3
    once = sketches.summarise(readings, F.lit("all"), ["v"], ["who"], ["who"]).drop("part")
    values = np.sort([r.v for r in readings.select("v").collect()])
    distinct = readings.select("who").distinct().count()
    for profile in (sketches.merged(spark, path), once):
        got = sketches.stored_numbers(profile, ["v"], [0.01, 0.25, 0.5, 0.9]).first()
        assert (got.n, got.min, got.max) == (len(values), values[0], values[-1]) and got.mean == pytest.approx(values.mean(), rel=1e-12) and got.std == pytest.approx(values.std(ddof=1), rel=1e-9)
        ranks = np.searchsorted(values, got.quantiles) / len(values)
        assert np.abs(ranks - [0.01, 0.25, 0.5, 0.9]).max() < 3 * sketches.rank_error()
        assert abs(sketches.stored_distinct(profile, ["who"]).first().distinct - distinct) < 4 * sketches.distinct_error() * distinct
        shares = {r.bin: r.share for r in sketches.stored_density(profile, "v", 4, (0, 1)).collect()}
        exact = np.histogram(values, bins=4, range=(0, 1))[0] / len(values)
        assert all(abs(shares[k] - exact[k]) < 6 * sketches.rank_error() for k in range(4)) and sum(shares.values()) == pytest.approx(1, abs=1e-6)


def test_stored_parts(spark, readings, tmp_path):
    path = str(tmp_path / "parts")
    sketches.store(sketches.summarise(readings, F.col("month"), ["v"], ["who"], ["who"]), path)
    by = {r.by: r.n for r in sketches.stored_numbers(sketches.merged(spark, path, F.col("part").cast("string")), ["v"]).collect()}
    assert by == {"0": 20_000, "1": 20_000, "2": 20_000}
    a, b, none = (sketches.merged(spark, path, parts=p) for p in (["0"], ["1", "2"], []))
    sizes = {r.side: r.n for r in sketches.stored_set_sizes(a, b, "who").collect()}
    left, right = ({r.who for r in readings.where(w).select("who").collect()} for w in ("month = '0'", "month <> '0'"))
    for side, exact in (("only_a", left - right), ("only_b", right - left), ("both", left & right)):
        assert abs(sizes[side] - len(exact)) < 600
    assert {r.side: r.n for r in sketches.stored_set_sizes(a, none, "who").collect()}["both"] == 0
    empty = sketches.stored_numbers(none, ["v"]).first()
    assert empty.quantiles is None and empty.mean is None


# Heavy hitters


@pytest.mark.parametrize("tracked", [64, 1000, 100_000])
def test_heavy_hitters_are_the_exact_top(spark, tracked):
    """Skewed values are found by the summary, values nearly all unlike by counting everything: the answer is the same."""
    skewed = spark.range(40_000).select(F.floor(400 * F.pow(F.rand(5), 4)).cast("string").alias("v"))
    flat = spark.range(5_000).select((F.col("id") % 4_000).cast("string").alias("v"))
    for df in (skewed.union(spark.createDataFrame([(None,)] * 900, "v string")), flat, flat.limit(0), flat.limit(3)):
        assert sketches.heavy_top_k(df, "v", 7, tracked).collect() == relations.top_k(df, ["v"], 7).collect()


@pytest.mark.parametrize(("tracked", "most"), [(64, 10**6), (1000, 10**6), (1000, 10)])
def test_heavy_hitters_of_groups(spark, tracked, most):
    """A skewed group is certain, one of values nearly all unlike and one of few values are counted whole, null is a group."""
    one = spark.range(20_000).select(F.lit("skewed").alias("g"), F.floor(400 * F.pow(F.rand(5), 4)).cast("string").alias("v"))
    two = spark.range(3_000).select(F.lit("flat").alias("g"), (F.col("id") % 2_500).cast("string").alias("v"))
    more = spark.createDataFrame([("few", "a"), ("few", None), ("few", None), (None, "b"), ("none", None)], "g string, v string")
    for df in (one.union(two).union(more), more, more.limit(0)):
        want = sorted(map(tuple, relations.top_k_per_group(df, "g", "v", 5).collect()), key=str)
        assert sorted(map(tuple, sketches.heavy_top_k_per_group(df, "g", "v", 5, tracked, most).collect()), key=str) == want
    assert features.fit_topn_vocab(one, "v", 9, 1000) == features.fit_topn_vocab(one, "v", 9)


# Prefix tree


@pytest.mark.parametrize("listed", [10_000, 2, 0])
def test_prefix_tree_is_counting_all_prefixes(spark, listed):
    draw = np.random.default_rng(7)
    lists = [[*"abcdefgh"[: draw.integers(0, 9)]] if draw.random() < 0.4 else ["abc"[c] for c in draw.integers(0, 3, draw.integers(0, 7))] for _ in range(400)] + [None, []]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(lists)], "k long, tokens array<string>").repartition(3)
    for support, most in ((1, 20), (5, 20), (5, 3), (1000, 20)):
        counts = {}
        for t in lists:
            for d in range(1, min(len(t or []), most) + 1):
                counts[tuple(t[:d])] = counts.get(tuple(t[:d]), 0) + 1
        want = {k: max([d for d in range(1, min(len(t or []), most) + 1) if counts[tuple(t[:d])] >= support], default=0) for k, t in enumerate(lists)}
        got = sequences.book_depth(df, "k", "tokens", support, most, listed).collect()
        assert len(got) == len(lists) and {r.k: r.depth for r in got} == want


# Layouts


def test_month_folders_and_buckets_prune(spark, data, tmp_path):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    io.write_parquet(orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM")).repartition("month"), str(tmp_path / "m"), ["month"])
    split = sampling.temporal_split(io.scan_parquet(spark, str(tmp_path / "m")), F.col("month").cast("string"), ["1995-01"], ["1995-03"])
    plan = plan_of(split)
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    files = {r.f for r in split.select(F.input_file_name().alias("f")).collect()}
    assert files and all("month=1995-01" in f or "month=1995-03" in f for f in files)
    for name, rows in (("t_left", orders.select("o_orderkey", "o_totalprice")), ("t_right", orders.select("o_orderkey", "o_custkey"))):
        spark.sql(f"drop table if exists {name}")
        io.write_bucketed(rows, str(tmp_path / name), name, "o_orderkey", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = spark.table("t_left").join(spark.table("t_right").groupBy("o_orderkey").agg(F.max("o_custkey")), "o_orderkey")
        assert "Exchange" not in plan_of(joined) and joined.count() == orders.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("t_left", "t_right"):
            spark.sql(f"drop table {name}")


# Ingest in one pass


def test_parts_are_written_by_one_job_and_again(spark, data, tmp_path):
    judged, path = ingestion.judged(spark, data), str(tmp_path / "parts")
    wants = [sorted(map(tuple, df.collect()), key=str) for df in (ingest.to_silver(ingest.quarantine(judged)[0]), *(q.select(*c) for q, c in zip(ingest.quarantine(judged)[1:], (["record", "skip_reason", "skip_detail"], ["record"]))))]
    for _ in range(2):  # a second attempt replaces the first
        ingest.write_parts(judged, path)
        assert [sorted(map(tuple, ingest.read_part(spark, path, part).collect()), key=str) for part in ("usable", "skipped", "errors")] == wants
    assert ingest.read_part(spark, path, "usable").columns == ingest.to_silver(judged).columns


def test_headers_of_one_match(spark):
    record = '[Event "a \\ b"]\n[Site ""]\n[Event "second"]\n[Odd_key1 "x"]\n[Broken "y]\n\n1. e4 {\n[White "no header"]\n} 1-0'
    df = spark.createDataFrame([(record, 1), (None, 2), ("", 3)], "record string, __other int")
    got = ingest.parse_headers(df, ["Event", "Site", "Odd_key1", "Broken", "White"]).orderBy("__other").collect()
    assert tuple(got[0])[2:] == ("a \\ b", "", "x", None, None) and tuple(got[1])[2:] == tuple(got[2])[2:] == (None,) * 5
    assert df.select(X.header(F.col("record"), "Site").alias("s")).first().s == ""


def test_missing_scores_are_told(spark):
    head = '[Event "e"]\n[Result "1-0"]\n{}\n\n1. e4 e5 2. d4 d5 3. c4 1-0'
    records = spark.createDataFrame([(head.format('[WhiteElo "?"]\n[BlackElo "1500"]'),), (head.format('[BlackElo "0"]'),)], "record string")
    assert sorted(r.skip_detail for r in ingest.quality_filter(ingest.parse_records(records)).collect()) == ["W=? B=1500", "W=None B=0"]


def test_stream_tells_its_progress(spark, tmp_path):
    log, name = streaming.ProgressLog(), "[Event \"e\"]\n[Result \"1-0\"]\n[WhiteElo \"1500\"]\n[BlackElo \"1500\"]\n\n1. e4 e5 2. d4 d5 3. c4 1-0"
    spark.streams.addListener(log)
    try:
        (tmp_path / "in").mkdir()
        for k in range(3):
            (tmp_path / "in" / f"{k}.txt").write_text("\n\n".join([name] * (k + 1)) + "\n")
            streaming.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()
        assert streaming.ingested(spark, str(tmp_path / "out")).groupBy("batch").count().orderBy("batch").collect() == [(0, 1), (1, 2), (2, 3)]
        assert sorted((r.batch, r.input_rows, r.usable) for r in streaming.ingest_progress(spark, str(tmp_path / "out")).collect()) == [(0, 1, 1), (1, 2, 2), (2, 3, 3)]
    finally:
        spark.streams.removeListener(log)
    assert [b[1:3] for b in log.batches if b[2]] == [(0, 1), (1, 2), (2, 3)] and all(error is None for _, error in log.ended)


def test_move_text_of_null_stays_null(spark):
    df = spark.createDataFrame([(None,), ("",), ("1. e4",)], "m string").select(X.tokenize_moves(F.col("m")).alias("t"))
    assert [r.f for r in df.select(X.first_token(F.col("t")).alias("f")).collect()] == [None, "", "e4"]
    assert sequences.sequence_quality(df, "t", ".").first().missing == 1
    assert features.min_length_gate(df.withColumn("b", F.lit(1)), "t", "b", 1).first().dropped == 2
