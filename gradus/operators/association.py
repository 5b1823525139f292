"""Mutual information, a band classifier, and evaluation of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.operators.aggregates import exact_quantiles, row_share


def mutual_information(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, mi) in nats from the contingency tables of all features, in one scan; null is a value of its own."""
    entry = lambda c: F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("?")).alias("x"))
    long = df.select(F.coalesce(F.col(target).cast("string"), F.lit("?")).alias("y"), F.explode(F.array(*[entry(c) for c in features])).alias("f")).select("y", "f.feature", "f.x")
    cells = long.groupBy("feature", "x", "y").agg(F.count("*").alias("c"))
    over = lambda *keys: F.sum("c").over(Window.partitionBy("feature", *keys))
    marked = cells.select("feature", "c", over().alias("n"), over("x").alias("nx"), over("y").alias("ny"))
    part = F.col("c") / F.col("n") * F.log(F.col("c").cast("double") * F.col("n") / (F.col("nx").cast("double") * F.col("ny")))
    return marked.groupBy("feature").agg((F.round(F.greatest(F.sum(part), F.lit(0.0)), 6) + 0.0).alias("mi"))


def quantile_bins(df: DataFrame, cols: Sequence[str], bins: int, approximate: bool = False) -> DataFrame:
    """Each column replaced by its equal-frequency bin; a row of breaks is broadcast."""
    at = [k / bins for k in range(1, bins)]
    if approximate:
        breaks = df.agg(*[F.percentile_approx(c, at).alias(f"__{c}") for c in cols])
    else:
        found = exact_quantiles(df, cols, at)
        breaks = found.agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(f"__{c}") for c in cols])  # from a row per column
    place = lambda c: F.when(F.col(c).isNotNull(), F.size(F.filter(F.col(f"__{c}"), lambda b: b < F.col(c))))
    return df.join(F.broadcast(breaks)).withColumns({c: place(c) for c in cols}).select(df.columns)


def mutual_information_numeric(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, mi) of numbers in equal-frequency bins."""
    return mutual_information(quantile_bins(df, features, bins), features, target)


def mi_ranking(df: DataFrame, categories: Sequence[str], numbers: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, mi), strongest first, from one scan of all features."""
    binned = quantile_bins(df, numbers, bins) if numbers else df
    return mutual_information(binned, [*categories, *numbers], target).orderBy(F.desc("mi"), "feature")


def fit_band_classifier(train: DataFrame, features: Sequence[str], label: str, trees: int = 200, depth: int = 6, seed: int = 42):
    """A pipeline of assembler and random forest (one tree of depth 8 with ``trees=1``)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    common = {"labelCol": label, "featuresCol": "features", "seed": seed}
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, **common) if trees > 1 else DecisionTreeClassifier(maxDepth=8, **common)
    return Pipeline(stages=[assembler, model]).fit(train)


def feature_importance(spark, model, features: Sequence[str], k: int = 15) -> DataFrame:
    """(feature, importance) of a fitted pipeline; as many rows as features."""
    scores = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, scores)), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)


def accuracy(pred: DataFrame, label: str, predicted: str) -> DataFrame:
    return pred.agg(F.round(F.avg((F.col(label) == F.col(predicted)).cast("double")), 6).alias("accuracy"))


def confusion_matrix(pred: DataFrame, label: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """(label, one column per predicted class): row percentages."""
    table = pred.groupBy(label).pivot(predicted, list(labels)).count().na.fill(0, [str(x) for x in labels])
    return row_share(table, [str(x) for x in labels])


def classification_report(pred: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support) per class, with macro and weighted means."""
    cells = pred.groupBy(F.col(label).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("c"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("c").alias("support"), F.lit(0).cast("long").alias("claimed"), F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("c").alias("claimed"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    per = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rated = per.select(F.col("class").cast("string").alias("class"), ratio(F.col("hit"), F.col("claimed")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2.0 * F.col("hit"), F.col("claimed") + F.col("support")).alias("f1"), "support")
    names = ("precision", "recall", "f1")
    macro = rated.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("macro").alias("class"), *names, "support")
    weighted = rated.agg(*[(F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("weighted").alias("class"), *names, "support")
    return rated.unionByName(macro).unionByName(weighted).select("class", *[F.round(n, 6).alias(n) for n in names], "support")


def ablation(spark, train: DataFrame, test: DataFrame, sets: dict[str, Sequence[str]], label: str, trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """(features, accuracy) of a model for each set of features."""
    rows = []
    for name, columns in sets.items():
        pred = fit_band_classifier(train, columns, label, trees, depth, seed).transform(test)
        rows.append(accuracy(pred, label, "prediction").select(F.lit(name).alias("features"), "accuracy"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def lift_over_random(acc: DataFrame, classes: int) -> DataFrame:
    return acc.select("accuracy", F.round(F.col("accuracy") * classes, 6).alias("lift"))
