"""Rows whose id is null, among others, in every operator."""

import pytest
from pyspark.sql import functions as F

from gradus.llm import bpe, exact_dedup, language_id, mixing, pii, rlz_dedup, simhash, suffix_dedup

LONG = "eins zwei drei vier fünf sechs sieben acht neun zehn " * 12
BIG = (1 << 60) + 1


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(None, LONG, "de", "a"), (BIG, LONG, "de", "a"), (BIG + 1, LONG + "elf", None, None), (None, None, None, None)], "doc_id long, text string, lang string, source string")


def ids(df):
    return sorted((str(r.doc_id) for r in df.collect()))


def test_every_row_comes_back(rows):
    want = sorted(["None", "None", str(BIG), str(BIG + 1)])
    model = language_id.fit(rows)
    for df in (
        exact_dedup.exact_dedup(rows), bpe.bpe_round_trip(rows), mixing.mix(rows), pii.find(rows, None), simhash.near_duplicates(rows),
        rlz_dedup.rlz_dedup(rows), suffix_dedup.suffix_dedup(rows), language_id.predict(rows, model),
    ):
        assert ids(df) == want


def test_nulls_are_nobodys_source(rows):
    exact = {str(r.doc_id): r for r in exact_dedup.exact_dedup(rows).where(F.length("text_sha256") == 64).collect() if r.group_size == 2}
    assert exact["None"].keep_id == BIG and not exact["None"].kept and exact[str(BIG)].kept
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(rows).where("doc_id is not null").collect()}
    assert removed[BIG + 1] == len(LONG.encode()) + 1 and 0 < removed[BIG] < len(LONG.encode())
    # the e of "elf" goes too: "eins" began with one
    words = {r.doc_id: r.n_removed for r in rlz_dedup.rlz_dedup(rows).where("doc_id is not null").collect()}
    assert words == {BIG: 0, BIG + 1: len(LONG.split())}


def test_simhash_links_across_rows_without_id(spark):
    texts = [" ".join(f"w{(i * 7 + k) % 400 if i % (k + 2) == 0 else i}" for i in range(60)) for k in range(120)]
    fps = [simhash.fingerprint(t, 3) for t in texts]
    near = lambda i, j: 0 < bin(fps[i] ^ fps[j]).count("1") <= 3
    everything = range(len(texts))
    a, bridge, b = next((i, k, j) for k in everything for i in everything if near(i, k) for j in everything if near(k, j) and fps[i] != fps[j] and not near(i, j))
    far = next(i for i in everything if all(bin(fps[i] ^ fps[k]).count("1") > 3 for k in (a, bridge, b)))
    rows = spark.createDataFrame([(BIG + 1, texts[a]), (None, texts[bridge]), (BIG + 3, texts[b]), (None, texts[far])], "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(rows).collect()}
    assert got == {(BIG + 1, f"{fps[a]:016x}"): BIG + 1, (None, f"{fps[bridge]:016x}"): BIG + 1, (BIG + 3, f"{fps[b]:016x}"): BIG + 1, (None, f"{fps[far]:016x}"): None}


def test_rows_of_one_id_are_dealt_over_cells(spark):
    """Rows without an id, with one repeated id and with ids of their own, all of one text: no cell far beyond the median."""
    sizes = spark.range(30_000, numPartitions=4).select(F.when(F.col("id") < 10_000, None).when(F.col("id") < 20_000, 7).otherwise(F.col("id")).alias("by"), F.monotonically_increasing_id().alias("position"))
    salted = mixing.spread(sizes, 256)
    assert salted.where("by > 7 and salt <> 0").count() == 0  # cells of other rows do not depend on the layout
    cells = sorted(r["count"] for r in salted.groupBy(F.pmod(F.xxhash64("by", "salt"), F.lit(117))).count().collect())
    assert len(cells) == 117 and cells[-1] < 2 * cells[58]


def test_mixing_without_ids(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"))
    taken = mixing.mix(rows).agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("taken").alias("most"), F.max("target").alias("target")).first()
    assert taken.n == 20_000 and taken.most <= 6 and abs(taken.taken - taken.target) <= 0.001 * taken.target


def test_a_fractional_bound_is_reached(spark):
    rows = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") < 300, "a").otherwise("b").alias("source"))
    got = {r.source_size: r for r in mixing.mix(rows, weights=(9, 1), most=2.5).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("copies").alias("copies")).collect()}
    assert got[600].target == 1500 and abs(got[600].taken - 1500) <= 2 and got[600].copies == 3


def test_overflow_pages_of_rows_without_id(spark):
    rows = spark.range(20_000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(5, "one text"), (6, "another")], "doc_id long, text string"))
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept): r["count"] for r in exact_dedup.exact_dedup(rows, capacity=8).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()}
    assert got == {(None, 5, 20_001, False): 20_000, (5, 5, 20_001, True): 1, (6, 6, 1, True): 1}
