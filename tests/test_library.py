"""Golden cases of column functions, and properties of samples, features, ingestion and streaming."""

import io as stdio

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import expressions as X
from gradus.operators import aggregates, association, features, ingest, sampling, sequences
from gradus.plans import binding, ingestion, sequencing
from gradus.sources import io

FINE = ((800, 1000, 1200, 1400, 1600, 1800, 2000, 2200, 2500), ("<800", "800-1000", "1000-1200", "1200-1400", "1400-1600", "1600-1800", "1800-2000", "2000-2200", "2200-2500", "2500+"))
COARSE = ((1000, 1400, 1800, 2200), ("Beginner", "Intermediate", "Advanced", "Expert", "Master"))


def values(spark, kind, items, make):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(items)], f"k int, v {kind}")
    return [r["out"] for r in df.select("k", make(F.col("v")).alias("out")).orderBy("k").collect()]


def test_bands_are_closed_on_the_right(spark):
    assert values(spark, "int", [1500, 800, 801, 1000, 2500, 2501, None], lambda c: X.band(c, *FINE)) == ["1400-1600", "<800", "800-1000", "800-1000", "2200-2500", "2500+", None]
    assert values(spark, "int", [1000, 1001, 2200, 2201], lambda c: X.band(c, *COARSE)) == ["Beginner", "Intermediate", "Expert", "Master"]
    assert values(spark, "int", [1199, 1200], lambda c: X.threshold_group(c, [1200], ["low", "high"])) == ["low", "high"]
    with pytest.raises(ValueError):
        X.band("v", [1], ["a"])


def test_text_functions(spark):
    assert values(spark, "string", ["B20"], lambda c: X.code_prefix(c, 1)) == ["B"]
    assert values(spark, "string", ["https://host/ab", "ab", "", None], X.entity_id_from_url) == ["ab", "ab", "", ""]
    assert values(spark, "string", ["+5", "-6", "", "40000", "x", None], lambda c: X.lenient(c, "smallint")) == [5, -6, None, None, None, None]
    assert values(spark, "string", ["0", "12", "?", None], X.safe_positive_int) == [None, 12, None, None]
    assert values(spark, "string", ["1-0", "1/2-1/2", "0-1", "*"], lambda c: X.map_values(c, ingest.RESULT_VALUES)) == [1.0, 0.5, 0.0, None]


def test_tokens(spark):
    tokens = lambda c: F.array_join(X.tokenize_moves(c), " ")
    texts = ["1. e4 e5 2. Nf3 Nc6", "1. O-O O-O-O 2. e8=Q 1/2-1/2", "1. e4 1-0", "", " 0-1 ", None, "1. d4\t d5  \n2. c4 *"]
    assert values(spark, "string", texts, tokens) == ["e4 e5 Nf3 Nc6", "O-O O-O-O e8=Q", "e4", "", "", None, "d4 d5 c4"]
    assert values(spark, "string", texts[:1] + texts[3:4], lambda c: X.prefix(X.tokenize_moves(c), 4)) == ["e4 e5 Nf3 Nc6", ""]
    assert values(spark, "array<string>", [["a", "b", "c"], ["a"], []], lambda c: X.ngrams_of(c, 2)) == [["a b", "b c"], [], []]
    assert values(spark, "array<string>", [["a", "a"], ["a", "b"], []], lambda c: X.seq_entropy(c, 10)) == [0.0, 1.0, 0.0]


def test_time_controls(spark):
    items = ["300+3", "300", "-", "300+", "1/40", "", None, "300+3+9"]
    assert values(spark, "string", items, lambda c: F.struct(*[x.alias(n) for n, x in zip("bi", X.time_control(c))])) == [(300, 3), (300, 0), *[(None, None)] * 5, (300, 3)]
    names = ["UltraBullet", "Bullet", "Bullet", "Blitz", "Blitz", "Rapid", "Rapid", "Classical", "Unknown"]
    assert values(spark, "int", [29, 30, 179, 180, 479, 480, 1499, 1500, None], lambda c: X.classify_duration(c, F.lit(0))) == names


def test_skip_precedence_and_bounds(spark):
    rows = spark.createDataFrame([("*", 0, 1500, 1500), ("1-0", 0, None, 1500), ("1-0", 3, None, None), ("", 300, 1500, 1500), ("1-0", 30, 1500, None), ("1-0", 30, 500, 1500), ("1-0", 30, 1500, 3000), ("1-0", 30, 1500, 1500), ("?", 30, 600, 2800)], "Result string, NumMoves int, WhiteElo int, BlackElo int")
    rules = ingest.QualityRules(max_moves=200, min_elo=600, max_elo=2800)
    assert [r.skip_reason for r in ingest.quality_filter(rows, rules).collect()] == ["unfinished", "no_moves", "too_short", "too_long", "missing_elo", "elo_too_low", "elo_too_high", None, None]
    assert [r.skip_detail for r in ingest.quality_filter(rows, rules).where("skip_reason like 'elo%'").collect()] == ["W=500 B=1500", "W=1500 B=3000"]
    loose = ingest.QualityRules(False, False, 0, 0, False, 0, 2800)
    assert [r.skip_reason for r in ingest.quality_filter(rows, loose).collect()] == [None, "elo_too_high", "elo_too_high", None, "elo_too_high", None, "elo_too_high", None, None]


def test_stratified_sample_is_that_of_ranking_everything(spark):
    rows = spark.range(20000).select("id", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 7 != 0, "often").alias("s"))
    for n in (1, 50, 5000):
        got = {(r.s, r.id) for r in sampling.stratified_sample(rows, "s", n, 3, "id").collect()}
        plain = rows.where("s is not null").withColumn("d", sampling.draw("id", 3)).collect()
        want = set()
        for s in ("rare", "often"):
            want |= {(s, r.id) for r in sorted((r for r in plain if r.s == s), key=lambda r: (r.d, r.id))[:n]}
        assert got == want


def test_shares_sum_and_entropy_is_bounded(spark, data):
    shares = aggregates.band_counts(spark.read.parquet(f"{data}/orders.parquet"), "o_totalprice", binding.BREAKS, binding.LABELS).collect()
    assert sum(r.pct for r in shares) == pytest.approx(100, abs=1e-4)
    rows = binding.banded_orders(spark, data, "o_orderpriority")
    assert all(0 <= r.entropy <= np.log2(5) for r in aggregates.entropy_by_group(rows, "band", "o_orderpriority").collect())
    assert all(r.mi >= 0 for r in association.mutual_information(rows, ["o_orderpriority"], "band").collect())


def test_svd_is_numpys(spark, data):
    rows = binding.user_sequences(spark, data)
    model = features.fit_tfidf(rows, "k", "tokens", 2, 12)
    vocab = [r.gram for r in model.collect()]
    weights = features.transform_tfidf(rows, "k", "tokens", 2, model)
    values_, _ = features.fit_svd(weights, "k", vocab, 4)
    keys = sorted({r.k for r in weights.collect()})
    dense = np.zeros((len(keys), len(vocab)))
    for r in weights.collect():
        dense[keys.index(r.k), vocab.index(r.gram)] = r.w
    assert np.allclose(values_, np.linalg.svd(dense, compute_uv=False)[:4], atol=1e-6)


def test_stream_ingests_what_the_batch_does(spark, data):
    batch = sorted(map(tuple, ingestion.in17(spark, data).collect()), key=str)
    assert batch == sorted(map(tuple, ingestion.st1(spark, data).collect()), key=str)


def test_records_from_zstd_with_a_large_window(spark, tmp_path):
    import zstandard

    text = "\n\n".join(f'[Event "e{k}"]\n[White "w"]\n\n1. e4 {"x" * k} 1-0' for k in range(200)) + "\n"
    squeeze = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(3, window_log=28))
    out = stdio.BytesIO()
    with squeeze.stream_writer(out, closefd=False) as writer:
        writer.write(text.encode())
    (tmp_path / "a.zst").write_bytes(out.getvalue())
    got = io.read_large_window_zstd(spark, [str(tmp_path / "a.zst")])
    parsed = ingest.parse_records(got)
    assert parsed.count() == 200 and parsed.where("is_error").count() == 0 and {r.Event for r in parsed.collect()} == {f"e{k}" for k in range(200)}
    (tmp_path / "b.txt").write_bytes(text.encode())
    assert sorted(r.record for r in io.read_records(spark, str(tmp_path / "b.txt")).collect()) == sorted(r.record for r in got.collect())


def test_sequence_properties(spark, data):
    rows = binding.order_sequences(spark, data)
    assert sequences.book_depth(rows, "k", "tokens", 1).where("depth <> least(size(array()), 20)").count() > 0
    matrix = sequences.sequence_band_matrix(rows.withColumn("p", X.prefix(F.col("tokens"), 2)), "p", "band", binding.LABELS, 5).collect()
    assert len(matrix) <= 5 and all(sum(r[b] for b in binding.LABELS) == pytest.approx(100, abs=1e-4) for r in matrix)


def test_features_are_built_end_to_end(spark, data):
    gate, out = sequencing.built(spark, data)
    train, validation = (spark.read.parquet(f"{out}/{name}") for name in ("train", "validation"))
    fitted = io.load_artifacts(spark, f"{out}/artifacts", "v1")
    assert train.columns == validation.columns == fitted["columns"] and train.dtypes == validation.dtypes
    assert dict(train.dtypes)["band"] == "tinyint" and {kind for _, kind in train.dtypes[2:]} == {"float"}
    assert [c for c in train.columns if c.startswith("svd_")] == ["svd_0", "svd_1", "svd_2"] and len(fitted["codes"]) == 10 and len(fitted["factors"]) == len(fitted["grams"])
    assert {r.split: r.rows - r.dropped for r in gate.collect()} == {"train": train.count(), "validation": validation.count()}
    assert sum(r.nulls for r in sequencing.E.verify_feature_store(train, validation).collect()) == 0
    # the factors are those of the training rows only
    rows = spark.createDataFrame([(1, ["NO", "NO", "AF"]), (2, ["AF"])], "k long, tokens array<string>").withColumns({"band": F.lit("b2"), "code": F.lit("1-1"), "status": F.lit("F"), "base": F.lit(0), "inc": F.lit(None).cast("int")})
    got = {r.k: r for r in sequencing.E.transform_features(rows, sequencing.SPEC, fitted).collect()}
    assert got[1].band == 1 and got[1].increment_log == 0 and got[2].svd_0 == 0 and got[1].svd_0 != 0


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Far:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Far(), type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError):
        io.scratch(Session(), "x")


def test_samples_by_slices(spark):
    """Slices of a few rows give what ranking every stratum whole gives."""
    df = spark.range(900).withColumn("s", F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)))
    for n in (1, 17, 1000):
        whole = sorted(map(tuple, sampling.stratified_sample(df, "s", n, 3, "id").collect()))
        assert sorted(map(tuple, sampling.stratified_sample(df, "s", n, 3, "id", 5, 0).collect())) == whole
        assert len(whole) == sum(min(n, r["count"]) for r in df.where("s is not null").groupBy("s").count().collect())
    splits = [sorted(sampling.stratified_split(df, "s", 0.3, 3, "id", *more).collect(), key=str) for more in ((), (7, 0))]
    assert splits[0] == splits[1] and len(splits[0]) == 900


def test_progress_of_all_batches(spark, tmp_path):
    from gradus.streaming.ingest import ingest_progress, ingest_stream

    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text("\n\n".join(f'[Event "e{j}"]\n[Result "1-0"]\n[WhiteElo "1500"]\n[BlackElo "{j}"]\n\n1. e4 e5 2. d4 d5 3. c4 1-0' for j in range(k + 1)) + "\n")
        ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()
    got = sorted(ingest_progress(spark, str(tmp_path / "out")).collect())
    assert [(r.batch, r.input_rows, r.usable, r.skipped, r.errors) for r in got] == [(0, 1, 0, 1, 0), (1, 2, 1, 1, 0), (2, 3, 2, 1, 0)] and all(r.rows_per_second > 0 for r in got)


def test_empty_tables(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet").limit(0).withColumn("band", binding.price_band())
    assert aggregates.value_counts(orders, "o_orderstatus", 3).count() == 0
    assert aggregates.histogram(orders, "o_totalprice", 5).count() == 0
    assert aggregates.entropy_by_group(orders, "band", "o_orderstatus").count() == 0
    assert sampling.stratified_sample(orders, "band", 5, 1, "o_orderkey").count() == 0
    assert aggregates.describe_numeric(orders, ["o_totalprice"]).collect()[0]["rows"] == 0
    assert sequencing.E.min_length_gate(orders.withColumn("t", F.array(F.lit("a"))), "t", "band").count() == 0
