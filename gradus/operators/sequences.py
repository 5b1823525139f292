"""Analytics of ordered token lists: n-grams, prefixes and how well they tell bands apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.functions import expressions as X
from gradus.operators.aggregates import entropy_by_group, row_share
from gradus.operators.relations import semi_join_topk, top_k_per_group, zero_fill_levels
from gradus.operators.sketches import heavy_top_k_per_group
from gradus.sources.io import scratch, union_all


def collect_sequence(df: DataFrame, key: str, order: Sequence[str], token: Column) -> DataFrame:
    """(key, tokens): the tokens of each key in order.  A key's rows must fit one task, as a sequence does."""
    entry = F.struct(*order, token.alias("__token"))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("__all")).select(key, F.transform("__all", lambda s: s["__token"]).alias("tokens"))


def ngram_counts(df: DataFrame, tokens: str, n: int, first: int = 10) -> DataFrame:
    """(gram, n) over the first tokens of each list."""
    return df.select(F.explode(X.ngrams_of(F.slice(tokens, 1, first), n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def top_ngrams_by_group(df: DataFrame, group: str, tokens: str, n: int, k: int, first: int = 10, tracked: int | None = None) -> DataFrame:
    """(group, gram, n, rank).  With ``tracked``, found among heavy hitters of each group (same rows): for grams nearly all unlike."""
    grams = df.where(F.col(group).isNotNull()).select(group, F.explode(X.ngrams_of(F.slice(tokens, 1, first), n)).alias("gram"))
    return heavy_top_k_per_group(grams, group, "gram", k, tracked) if tracked else top_k_per_group(grams, group, "gram", k)


def first_token_share(df: DataFrame, band: str, tokens: str, chosen: Sequence[str]) -> DataFrame:
    """(band, one column per chosen token): percentages among the chosen ones."""
    first = df.select(band, X.first_token(F.col(tokens)).alias("first")).where(F.col("first").isin(*chosen))
    return row_share(first.groupBy(band).pivot("first", list(chosen)).count().na.fill(0, list(chosen)), list(chosen))


def prefix_concentration(df: DataFrame, prefix: str, band: str, k: int = 20) -> DataFrame:
    """(prefix, n, share, dominant): of the k most frequent prefixes, the band that holds most of each."""
    counts = df.where(F.col(band).isNotNull()).groupBy(prefix, band).agg(F.count("*").alias("c"))
    best = F.min(F.struct((-F.col("c")).alias("c"), band)).alias("best")  # of equal counts the band that sorts first
    per = counts.groupBy(prefix).agg(F.sum("c").alias("n"), best)
    return per.orderBy(F.desc("n"), prefix).limit(k).select(prefix, "n", F.round(-F.col("best.c") / F.col("n"), 6).alias("share"), F.col(f"best.{band}").alias("dominant"))


def signal_strength(df: DataFrame, tokens: str, band: str, depths: Sequence[int], k: int = 20) -> DataFrame:
    """(depth, avg_share, label): the mean share of the dominant band at each depth, all depths in one pass."""
    rows = df.where(F.col(band).isNotNull()).select(band, F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), X.prefix(F.col(tokens), d).alias("prefix")) for d in depths])).alias("p"))
    counts = rows.groupBy("p.depth", "p.prefix", band).agg(F.count("*").alias("c"))
    per = counts.groupBy("depth", "prefix").agg(F.sum("c").alias("n"), F.max("c").alias("most"))
    top = per.withColumn("rank", F.row_number().over(Window.partitionBy("depth").orderBy(F.desc("n"), "prefix"))).where(F.col("rank") <= k)
    share = F.avg(F.col("most") / F.col("n"))
    label = F.when(F.col("avg_share") < 0.3, "weak").when(F.col("avg_share") < 0.5, "moderate").otherwise("strong")
    return top.groupBy("depth").agg(F.round(share, 6).alias("avg_share")).withColumn("label", label)


def sequence_band_matrix(df: DataFrame, prefix: str, band: str, labels: Sequence[str], k: int = 20) -> DataFrame:
    """(prefix, one column per band): row percentages of the k most frequent prefixes."""
    kept = semi_join_topk(df.where(F.col(band).isNotNull()), prefix, k)
    table = kept.groupBy(prefix).pivot(band, list(labels)).count().na.fill(0, list(labels))
    return row_share(table, list(labels))


def sequence_entropy_by_band(df: DataFrame, prefix: str, band: str, labels: Sequence[str]) -> DataFrame:
    """(band, entropy) in bits; 0 for a band without rows."""
    found = entropy_by_group(df.where(F.col(band).isNotNull()), band, prefix)
    return zero_fill_levels(found, band, labels, "entropy")


def sequence_quality(df: DataFrame, tokens: str, pattern: str) -> DataFrame:
    """(rows, missing, empty, mean_tokens, bad_tokens) in one aggregation."""
    col = F.col(tokens)
    bad = F.size(F.filter(col, lambda t: ~t.rlike(pattern)))
    return df.agg(F.count("*").alias("rows"), F.sum(col.isNull().cast("long")).alias("missing"), F.sum(F.coalesce(F.size(col) == 0, F.lit(False)).cast("long")).alias("empty"), F.round(F.avg(F.when(col.isNotNull(), F.size(col))), 6).alias("mean_tokens"), F.sum(F.coalesce(F.when(col.isNotNull(), bad), F.lit(0))).cast("long").alias("bad_tokens"))


def book_depth(df: DataFrame, key: str, tokens: str, min_support: int, most: int = 20, listed: int = 10_000) -> DataFrame:
    """(key, depth): tokens of the longest prefix that at least ``min_support`` lists share; 0 for none.

    A prefix tree is grown level by level: a list is looked at one token deeper only while its prefix so far is supported, so
    the rows of a level fall with its depth, and what is counted is (number of the prefix, next token), with map-side combine.
    Supported prefixes go back to the lists by broadcast; beyond ``listed`` of them, only the most frequent do, and the others,
    none of which is hot, by a shuffle.  Every level is written once and names the rows that end there.
    """
    spark = df.sparkSession
    lists = _kept(spark, df.select(key, F.slice(tokens, 1, most).alias("__tokens")), "lists")  # what they come from is worked out once
    some = F.coalesce(F.size("__tokens"), F.lit(0)) > 0
    alive, ended = lists.where(some).withColumn("__node", F.lit(0).cast("long")), [lists.where(~some).select(key, F.lit(0).alias("depth"))]
    for depth in range(1, most + 1):
        token = F.try_element_at("__tokens", F.lit(depth))
        counts = alive.where(F.size("__tokens") >= depth).groupBy("__node", token.alias("__token")).agg(F.count("*").alias("__n")).where(F.col("__n") >= min_support)
        book = _kept(spark, counts.withColumn("__next", F.monotonically_increasing_id()), "book")
        many = book.count()
        rows = alive.withColumn("__token", token)
        if many <= listed:
            met = rows.join(F.broadcast(book.drop("__n")), ["__node", "__token"], "left")
        else:
            hot = book.orderBy(F.desc("__n"), "__next").limit(listed)
            first = rows.join(F.broadcast(hot.drop("__n")), ["__node", "__token"], "left")
            rest = first.where("__next is null").drop("__next").join(book.join(hot.select("__next"), "__next", "left_anti").drop("__n"), ["__node", "__token"], "left")
            met = first.where("__next is not null").unionByName(rest)
        if many:
            level = _kept(spark, met.select(key, "__tokens", "__next"), "level")
            ended.append(level.where("__next is null").select(key, F.lit(depth - 1).alias("depth")))
            alive = level.where("__next is not null").select(key, "__tokens", F.col("__next").alias("__node"))
        if not many or depth == most:
            ended.append(alive.select(key, F.lit(depth if many else depth - 1).alias("depth")))
            break
    return union_all(ended)


def _kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
