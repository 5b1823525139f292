"""Feature building: vocabularies, one-hot columns, TF-IDF, factors, gates and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions import expressions as X
from gradus.operators.factorise import fit_svd, project_svd
from gradus.operators.relations import top_k
from gradus.operators.sketches import heavy_top_k
from gradus.sources.io import save_artifacts, scratch, union_all


def fit_topn_vocab(df: DataFrame, col: str, n: int, tracked: int | None = None) -> list[str]:
    """The n most frequent values: at most n rows reach the driver.  With ``tracked``, found among heavy hitters (same values)."""
    found = df.where(F.col(col).isNotNull())
    return [r[col] for r in (heavy_top_k(found, col, n, tracked) if tracked else top_k(found, [col], n)).collect()]


def one_hot(df: DataFrame, col: str, vocab: Sequence[str], name: str) -> DataFrame:
    """A 0/1 column per value, all in one projection; unknown values and null give zeros."""
    return df.select("*", *[F.coalesce((F.col(col) == v).cast("float"), F.lit(0.0).cast("float")).alias(f"{name}_{v}") for v in vocab])


def topn_index(df: DataFrame, col: str, vocab: Sequence[str]) -> DataFrame:
    """``col``_index: place in the vocabulary, or its length for anything else."""
    lookup = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(vocab)], f"{col} string, {col}_index int")
    return df.join(F.broadcast(lookup), col, "left").na.fill(len(vocab), [f"{col}_index"])  # one row per word of the vocabulary


def target_encode(col: Column, labels: Sequence[str]) -> Column:
    return X.band_rank(col, labels)


def first_token_one_hot(df: DataFrame, tokens: str, chosen: Sequence[str]) -> DataFrame:
    first = X.first_token(F.col(tokens))
    flag = lambda c: F.coalesce(c.cast("float"), F.lit(0.0).cast("float"))
    return df.select("*", *[flag(first == t).alias(f"first_{t}") for t in chosen], flag(~first.isin(*chosen)).alias("first_other"))


def opening_family(tokens: Column, families: dict[str, Sequence[str]], other: str = "other") -> Column:
    out = None
    for name, firsts in families.items():
        fits = X.first_token(tokens).isin(*firsts)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise(other)


def fit_tfidf(df: DataFrame, key: str, tokens: str, n: int, vocab: int) -> DataFrame:
    """(gram, df, idf): the most frequent n-grams by documents, with smoothed idf ln((1 + N) / (1 + df)) + 1."""
    grams = df.select(key, F.explode(F.array_distinct(X.ngrams_of(F.col(tokens), n))).alias("gram"))
    total = df.agg(F.count("*").alias("__n"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "gram").limit(vocab)
    return counts.join(F.broadcast(total)).select("gram", "df", (F.log((1 + F.col("__n")) / (1 + F.col("df"))) + 1).alias("idf"))  # a row


def transform_tfidf(df: DataFrame, key: str, tokens: str, n: int, model: DataFrame) -> DataFrame:
    """(key, gram, w): L2-normalised weights; the model has as many rows as its vocabulary and is broadcast."""
    counts = df.select(key, F.explode(X.ngrams_of(F.col(tokens), n)).alias("gram")).join(F.broadcast(model.select("gram", "idf")), "gram").groupBy(key, "gram").agg((F.count("*") * F.first("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return counts.withColumn("w", F.round(F.col("w") / norm, 6))


def min_length_gate(df: DataFrame, tokens: str, by: str, n: int = 5) -> DataFrame:
    """(by, rows, dropped, rate, verdict): share of rows with fewer than n tokens."""
    short = F.coalesce(F.size(tokens) < n, F.lit(True))
    rates = df.groupBy(by).agg(F.count("*").alias("rows"), F.sum(short.cast("long")).alias("dropped"), F.round(100.0 * F.avg(short.cast("double")), 6).alias("rate"))
    return rates.withColumn("verdict", F.when(F.col("rate") <= 1.5, "pass").when(F.col("rate") <= 3.0, "warn").otherwise("fail"))


def assemble_features(df: DataFrame, spec: Sequence[tuple[str, Column]], key: str) -> DataFrame:
    """(key, features in their fixed order), in one projection."""
    return df.select(key, *[c.alias(name) for name, c in spec])


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns hold what, and the sizes of what is fitted."""

    key: str
    target: str  # a band
    labels: Sequence[str]  # its values in order
    tokens: str
    category: str  # a code whose first letter is a class of its own
    letters: Sequence[str]
    kind: str
    kinds: Sequence[str]
    base: str
    increment: str
    firsts: Sequence[str]
    most_tokens: float = 200.0
    least_tokens: int = 5
    codes: int = 100
    gram: int = 2
    grams: int = 1000
    factors: int = 50


#: What tokens stand for castling to either side, a check and a pawn move, and in how many first tokens they count.
KINGSIDE, QUEENSIDE, CHECK, PAWN = ("O-O[+#]?", 20), ("O-O-O[+#]?", 20), ("[+#]$", 15), ("^[a-h]", 10)


def fit_features(train: DataFrame, spec: FeatureSpec) -> dict:
    """What transforming needs, as plain values: vocabularies, idf, factors and the final columns in order.

    Everything that reaches the driver is as large as the vocabularies of the spec.
    """
    model = [tuple(r) for r in fit_tfidf(train, spec.key, spec.tokens, spec.gram, spec.grams).collect()]
    grams = [g for g, _, _ in model]
    weights = transform_tfidf(train, spec.key, spec.tokens, spec.gram, _tfidf_model(train, model))
    vectors = fit_svd(weights, spec.key, grams, spec.factors)[1] if grams else np.zeros((0, 0))
    fitted = {"codes": fit_topn_vocab(train, spec.category, spec.codes), "grams": [list(m) for m in model], "factors": vectors.tolist()}
    names = [spec.key, spec.target, *[name for name, _ in _plain_columns(spec, fitted)], *[f"svd_{k}" for k in range(vectors.shape[1])]]
    return fitted | {"columns": names}


def _tfidf_model(df: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, "gram string, df long, idf double")


def _plain_columns(spec: FeatureSpec, fitted: Mapping) -> list[tuple[str, Column]]:
    """Features that a row has by itself, in their fixed order."""
    tokens = F.col(spec.tokens)
    first = X.first_token(tokens)
    columns = [(f"cat_{v}", X.code_prefix(F.col(spec.category), 1) == v) for v in spec.letters]
    columns += [(f"code_{v}", F.col(spec.category) == v) for v in fitted["codes"]]
    columns += [(f"kind_{v}", F.col(spec.kind) == v) for v in spec.kinds]
    columns += [("base_log", F.log1p(F.col(spec.base))), ("increment_log", F.log1p(F.col(spec.increment))), ("length_norm", X.clip_scale(F.size(tokens).cast("double"), spec.most_tokens))]
    columns += [(f"first_{v}", first == v) for v in spec.firsts] + [("first_other", ~first.isin(*spec.firsts))]
    return columns + [("entropy", X.seq_entropy(tokens, 20)), ("kingside", X.token_flag(tokens, *KINGSIDE)), ("queenside", X.token_flag(tokens, *QUEENSIDE)), ("checks", X.token_count_matching(tokens, *CHECK)), ("pawn_ratio", X.token_ratio_matching(tokens, *PAWN))]


def transform_features(df: DataFrame, spec: FeatureSpec, fitted: Mapping) -> DataFrame:
    """(key, target as tinyint, features as float in their fixed order), the same for every split."""
    number = lambda c: F.coalesce(c.cast("float"), F.lit(0.0).cast("float"))
    target = X.band_rank(F.col(spec.target), spec.labels).cast("tinyint").alias(spec.target)
    plain = df.select(F.col(spec.key), target, *[number(c).alias(name) for name, c in _plain_columns(spec, fitted)])
    if not fitted["grams"]:
        return plain
    vectors, grams = np.array(fitted["factors"]), [g[0] for g in fitted["grams"]]
    weights = transform_tfidf(df, spec.key, spec.tokens, spec.gram, _tfidf_model(df, [tuple(g) for g in fitted["grams"]]))
    factors = project_svd(weights, spec.key, grams, vectors).withColumnRenamed(spec.key, "__key")
    return plain.join(factors, F.col(spec.key) == F.col("__key"), "left").select(*[f"`{c}`" for c in plain.columns], *[number(F.col(f"svd_{k}")).alias(f"svd_{k}") for k in range(vectors.shape[1])])


def build_features(splits: Mapping[str, DataFrame], spec: FeatureSpec, out: str, version: str = "v1", fit_on: str = "train") -> DataFrame:
    """Fit on one split, then transform and write all of them below ``out``, with the artifacts; returns the gate of each split.

    The rows of all splits are written once before anything else, so what they come from is worked out once, however many
    passes fitting takes.  Rows with fewer than ``least_tokens`` tokens are dropped before anything is fitted; keys must be
    unlike in all rows.
    """
    spark, folder = splits[fit_on].sparkSession, scratch(splits[fit_on].sparkSession, "splits")
    for name, df in splits.items():
        df.write.parquet(f"{folder}/{name}")
    rows = {name: spark.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in splits.items()}
    gates = [min_length_gate(df.withColumn("split", F.lit(name)), spec.tokens, "split", spec.least_tokens) for name, df in rows.items()]
    kept = {name: df.where(F.size(spec.tokens) >= spec.least_tokens) for name, df in rows.items()}
    fitted = fit_features(kept[fit_on], spec)
    save_artifacts(spark, fitted, f"{out}/artifacts", version)
    for name, df in kept.items():
        transform_features(df, spec, fitted).select(*[f"`{c}`" for c in fitted["columns"]]).write.parquet(f"{out}/{name}")
    return union_all(gates)


def leakage_check(df: DataFrame, target: str, forbidden: Sequence[str], limit: float = 0.95) -> DataFrame:
    """(column, forbidden, r, leaks) for each numeric input."""
    numeric = [c for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") and c != target]
    one = lambda c: F.struct(F.lit(c).alias("column"), F.lit(c in forbidden).alias("forbidden"), F.round(F.corr(F.col(c).cast("double"), F.col(target).cast("double")), 6).alias("r"))
    found = df.agg(F.array(*[one(c) for c in numeric]).alias("all")).select(F.explode("all").alias("s")).select("s.*")
    return found.withColumn("leaks", F.col("forbidden") | (F.coalesce(F.abs("r"), F.lit(0.0)) > limit))


def verify_feature_store(train: DataFrame, validation: DataFrame) -> DataFrame:
    """(split, rows, nulls, same_schema)."""
    same = train.dtypes == validation.dtypes
    nulls = lambda d: sum((F.sum(F.col(c).isNull().cast("long")) for c in d.columns[1:]), F.sum(F.col(d.columns[0]).isNull().cast("long")))
    one = lambda d, name: d.agg(F.count("*").alias("rows"), F.coalesce(nulls(d), F.lit(0)).alias("nulls")).select(F.lit(name).alias("split"), "rows", "nulls", F.lit(same).alias("same_schema"))
    return one(train, "train").unionByName(one(validation, "validation"))
