"""How operators are bound to the given tables, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.expressions import band
from gradus.operators.sequences import collect_sequence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BREAKS = (100_000, 200_000, 300_000, 400_000)
LABELS = ("b1", "b2", "b3", "b4", "b5")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")
NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

#: SQL of the band of a price, and of sequences per order with their band.
SQL_BAND = "case when {c} <= 100000 then 'b1' when {c} <= 200000 then 'b2' when {c} <= 300000 then 'b3' when {c} <= 400000 then 'b4' when {c} is not null then 'b5' end"
SQL_Q2 = f"""q as (select l_orderkey as k, list(l_returnflag || l_linestatus order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as tokens from lineitem group by l_orderkey),
q2 as (select k, tokens, {SQL_BAND.format(c="o_totalprice")} as band, o_orderpriority as priority, o_totalprice as price from q join orders on o_orderkey = k)"""
SQL_Q = "q as (select user_id as k, list(event_type order by ts, event_id) as tokens from events group by user_id)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def price_band(col: str = "o_totalprice"):
    return band(col, BREAKS, LABELS)


def banded_orders(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "orders", "o_orderkey", "o_totalprice", *columns).withColumn("band", price_band())


def order_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """(k, tokens, band, priority, price): return flag and line status of an order's lines."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    tokens = collect_sequence(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], F.concat("l_returnflag", "l_linestatus"))
    orders = banded_orders(spark, sf, "o_orderpriority")
    return tokens.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("k"), "tokens", "band", F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


def user_sequences(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events", "user_id", "ts", "event_id", "event_type")
    return collect_sequence(events, "user_id", ["ts", "event_id"], F.col("event_type")).withColumnRenamed("user_id", "k")
