"""Operator 2: mixing sources to target weights by entropy balancing.

Document rates r minimise the relative entropy sum(size * (r log r - r + 1)) under one token constraint per source,
sum(size * r) = target.  The solution is an exponential tilt, r = exp(lambda of the source), and the dual is convex with
gradient sum(size) exp(lambda) - target and Hessian sum(size) exp(lambda), both sums over the source's documents, which
Spark has pre-aggregated.  Constraints of different sources touch different documents, so the Newton steps of all sources
run side by side over a table with a row per source; after each round of steps the largest residual of all sources
tells whether to go on (``solved``).  Steps are bounded, so that no start overshoots.  Targets come from rounds of
aggregations as well (``targets``), and sources are numbered in ranges (``numbered``): nothing runs over all sources in one
task, so their number may be any.

Rates become copies by size classes (lengths of the size in bits).  Classes of at most ``FEW`` cells of a source, and
at most 64 of them, are settled in one sequence from long to short: a document is taken so that what is left of the
target stays within reach of all shorter documents and the rest, and otherwise as often as the words owed say.  The
remaining target then gives the rate of the other classes.  These are dealt over cells of about ``CELL`` documents of one
source and class, in which a document is taken once more whenever the words owed exceed half its size.  Sizes of a cell
differ by less than a factor of two, so a cell misses by at most half of its longest document; a source with any share of
all rows is dealt over as many cells as it needs.  Targets are at most twice a source's size, so rates are at most 2 and
so are copies.

Edge cases: null texts have size 0 and are taken 0 times; a null source is a source of its own and comes last; a
source of size 0 has target 0; ties are broken by a hash of the id and then the id, so reruns agree; rows that
repeat an id, or have none, are taken one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.llm.common import WORD, documents, sorted_groups, text_of, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
CELL = 256
FEW = 4  # cells; a class of at most so many is settled in one sequence
NEWTON_STEPS, NEWTON_ROUNDS, NEWTON_CLOSE = 8, 100, 1e-12
BROADCAST_SOURCES = 100_000


def size_of(text_col: str = "text") -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """The rows with their place in the order of a column (nulls last), from 0: ranges, counted, then numbered each."""
    order = F.col(by).asc_nulls_last()
    ranged = written(rows.repartitionByRange(order).withColumn("range", F.spark_partition_id()), name)
    counts = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect())  # a row per partition
    before, offsets = 0, []
    for number, n in counts:
        offsets += [F.lit(number), F.lit(before)]
        before += n
    if not offsets:
        return ranged.withColumn("place", F.lit(0).cast("long")).drop("range")
    place = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1 + F.element_at(F.create_map(*offsets), F.col("range"))
    return ranged.withColumn("place", place.cast("long")).drop("range")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): shares by weight, none above ``most`` times its size.

    All sources share by weight what those at their limits leave; as long as that puts others above theirs, these stop
    too.  Every round is one aggregation over the sources; the level only rises, so the rounds end.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = written(numbered(by_source, "source", "op2-ranges").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("limit")), "op2-weights")
    level, stopped = 0.0, -1
    while True:
        stops = F.col("weight") * level >= F.col("limit")
        total = weighed.agg(
            (F.sum("source_size") * share).alias("total"), F.sum(F.when(stops, F.col("limit")).otherwise(0.0)).alias("stopped"),
            F.sum(F.when(stops, 0.0).otherwise(F.col("weight"))).alias("sharing"), F.count(F.when(stops, 1)).alias("n"),
        ).first()
        if not total["sharing"] or total["n"] == stopped:
            break
        level, stopped = (total["total"] - total["stopped"]) / total["sharing"], total["n"]
    return weighed.select("source", "source_size", F.least("limit", F.col("weight") * level).alias("target"))


def solved(sources: DataFrame, steps: int = NEWTON_STEPS, rounds: int = NEWTON_ROUNDS, close: float = NEWTON_CLOSE) -> DataFrame:
    """The sources with rate exp(lambda) from Newton's method on the dual; 0 for a target of 0.

    A round takes some steps for every source, none of them longer than 1, and then the largest relative residual is
    looked at; without convergence after all rounds this fails.
    """
    size, target, gains = F.col("source_size").cast("double"), F.col("target"), (F.col("target") > 0) & (F.col("source_size") > 0)
    gradient, hessian = (lambda at: size * F.exp(at) - target), (lambda at: size * F.exp(at))
    bounded = lambda step: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step))
    state = sources.withColumn("lambda", F.lit(0.0))
    for _ in range(rounds):
        taken = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("lambda"), lambda at, _: at - bounded(gradient(at) / hessian(at)))
        state = written(state.withColumn("lambda", F.when(gains, taken).otherwise(F.col("lambda"))), "op2-newton")
        residual = state.where(gains).agg(F.max(F.abs(gradient(F.col("lambda"))) / target).alias("worst")).first()["worst"]
        if residual is None or residual <= close:
            return state.withColumn("rate", F.when(gains, F.exp("lambda")).otherwise(0.0)).drop("lambda")
    raise ArithmeticError(f"no convergence: a source misses its constraint by {residual:g} of its target")


def round_cell(sizes: list[int], rates: list[float], most: int) -> list[int]:
    """Copies of each document of a cell (long ones first), so that the words taken follow the words owed."""
    owed, copies = 0.0, []
    for size, rate in zip(sizes, rates):
        owed += size * rate
        n = min(most, max(0, round(owed / size))) if size else 0
        owed -= n * size
        copies.append(n)
    return copies


def settle(sizes: list[int], rate: float, target: float, rest: int, most: int) -> list[int]:
    """Copies of a source's documents (long ones first) towards a target for them and ``rest`` words that follow."""
    owed, after, copies = 0.0, sum(sizes) + rest, []
    for size in sizes:
        owed += size * rate
        after -= size
        miss = lambda n: round(max(0.0, n * size - target, target - n * size - most * after), 3)  # noqa: B023, E731
        n = min(range(most + 1), key=lambda n: (miss(n), abs(owed - n * size))) if size else 0  # noqa: B023
        owed -= n * size
        target -= n * size
        copies.append(n)
    return copies


def spread(sizes: DataFrame, cell: int) -> DataFrame:
    """The rows with a salt: their position for those without an id, or with one that more than ``cell`` rows share; else 0.

    Ids so frequent are counted first, and broadcast if they are few; if not, ids tell rows apart too badly, and all get a salt.
    """
    crowded = written(sizes.where("by is not null").groupBy("by").agg(F.count("*").alias("n")).where(F.col("n") > cell).select(F.col("by").alias("often")), "op2-crowded")
    if crowded.count() > BROADCAST_SOURCES:
        return sizes.withColumn("salt", F.col("position"))
    met = sizes.join(F.broadcast(crowded), F.col("by") == F.col("often"), "left")
    return met.withColumn("salt", F.when(F.col("by").isNull() | F.col("often").isNotNull(), F.col("position")).otherwise(F.lit(0))).drop("often")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, cell: int = CELL, tie_col: str | None = None) -> DataFrame:
    """Per row: doc_id, size, source_size, target, rate, copies and taken (copies times size); ``tie_col`` is hashed for the id."""
    size = size_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.col(tie_col or id_col).cast("long").alias("by"), F.monotonically_increasing_id().alias("position"))
    sizes = written(rows, "op2-sizes").withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))
    sizes = spread(sizes, cell)
    highest = math.ceil(most)
    sources = solved(targets(sizes, weights, share, most)).withColumn("rate", F.least(F.lit(most), "rate")).withColumnRenamed("source", "its")
    classes = sizes.groupBy("source", "class").agg(F.count("*").alias("class_docs"), F.sum("size").alias("class_size"))
    side = written(classes.join(sources, F.col("source").eqNullSafe(F.col("its"))).select(F.col("source").alias("its"), F.col("class").alias("its_class"), "class_docs", "class_size", "source_size", "target", "rate"), "op2-classes")
    rest = side.groupBy(F.col("its").alias("whose")).agg(F.sum(F.when(F.col("class_docs") > FEW * cell, F.col("class_size")).otherwise(0)).alias("rest"))
    side = written(side.join(rest, F.col("its").eqNullSafe(F.col("whose"))).drop("whose", "class_size"), "op2-sides")
    small = side.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda df: df)
    columns = ["doc_id", "size", "source_size", "target", "rate", "copies", "taken"]
    schema = "doc_id long, size long, source_size long, target double, rate double, copies long, taken long"

    def dealt(side: DataFrame, cells: Column, *more: str) -> DataFrame:
        met = sizes.join(hint(side), F.col("source").eqNullSafe(F.col("its")) & (F.col("class") == F.col("its_class"))).select(
            F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().cast("int").alias("none"), *more, F.pmod(F.xxhash64("by", "salt"), cells).alias("cell"),
            "doc_id", "size", "source_size", "target", "rate", "rest", F.xxhash64("by", F.lit(1)).alias("tie"),
        )
        keys = ["source", "none", *[m for m in more if m == "class"], "cell"]
        return met.repartition(*keys).sortWithinPartitions(*keys, F.col("size").desc(), "tie", "doc_id")

    def rows_of(g: dict, copies: list[int]) -> list[pa.Array]:
        taken = [n * s for n, s in zip(copies, g["size"].tolist())]
        return [pa.array(g["doc_id"].tolist(), pa.int64()), pa.array(g["size"], pa.int64()), pa.array(g["source_size"], pa.int64()), pa.array(g["target"].astype(float), pa.float64()), pa.array(g["rate"].astype(float), pa.float64()), pa.array(copies, pa.int64()), pa.array(taken, pa.int64())]

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (source, none, _), g in sorted_groups(batches, ("source", "none", "cell")):
            n = len(g["size"])
            copies = settle(g["size"].tolist(), float(g["rate"][0]), float(g["target"][0]), int(g["rest"][0]), highest)
            yield pa.RecordBatch.from_arrays([pa.array([None if none else source] * n, pa.string()), *rows_of(g, copies)], ["source", *columns])

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g in sorted_groups(batches, ("source", "none", "class", "cell")):
            copies = round_cell(g["size"].tolist(), g["now"].tolist(), highest)
            yield pa.RecordBatch.from_arrays(rows_of(g, copies), columns)

    few = written(dealt(side.where(F.col("class_docs") <= FEW * cell), F.lit(1)).mapInArrow(settled, f"source string, {schema}"), "op2-settled")
    spent = few.groupBy(F.col("source").alias("whose")).agg(F.sum("taken").alias("spent"))
    left = F.col("target") - F.coalesce("spent", F.lit(0))
    now = F.when(F.col("rest") > 0, F.greatest(F.lit(0.0), F.least(F.lit(most), left / F.col("rest")))).otherwise(0.0)
    many = side.where(F.col("class_docs") > FEW * cell).join(spent, F.col("its").eqNullSafe(F.col("whose")), "left").withColumn("now", now).drop("whose", "spent")
    others = dealt(many, F.ceil(F.col("class_docs") / cell), "class", "now").mapInArrow(rounded, schema)
    return few.select(columns).unionByName(others)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
