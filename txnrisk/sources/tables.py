"""Canonical transaction views over an event table and over order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.functions import columns as C
from txnrisk.operators.canonical import keep_first
from txnrisk.operators.ordering import task_parts

LINE_ORDER = [
    "ts_sec", "merchant_id", "device_id", "amount", "l_quantity", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]


def event_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Users as customers, the event key as merchant: a stream with distinct seconds."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    k = F.get_json_object("props", "$.k")
    ts_sec = C.epoch_seconds(F.col("ts"))
    return events.select(
        F.concat(F.lit("E"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("transaction_id"),
        ts_sec.alias("ts_sec"),
        F.concat(F.lit("C"), "user_id").alias("customer_id"),
        F.concat(F.lit("M"), k).alias("merchant_id"),
        F.concat(F.lit("D"), "user_id", F.lit("-"), k.cast("int") % 3).alias("device_id"),
        F.col("value").alias("amount"),
        C.hour_of(ts_sec).alias("transaction_hour"),
        (F.col("event_type") == "error").cast("int").alias("is_fraud"),
    )


def line_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines in the canonical layout with their numeric keys, repeated keys included."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey")
    if parts := blocks_of(spark, folder, "lineitem"):
        lines, orders = lines.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    order_no = F.lpad(F.col("l_orderkey").cast("string"), 10, "0")
    ts_sec = C.epoch_seconds(F.col("l_shipdate"))
    return joined.select(
        F.concat(F.lit("L"), order_no, F.lit("-"), "l_linenumber").alias("transaction_id"),
        ts_sec.alias("ts_sec"),
        F.concat(F.lit("C"), "o_custkey").alias("customer_id"),
        F.concat(F.lit("M"), "l_suppkey").alias("merchant_id"),
        F.concat(F.lit("D"), "l_partkey").alias("device_id"),
        F.col("l_extendedprice").alias("amount"),
        C.hour_of(ts_sec).alias("transaction_hour"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_fraud"),
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber",
    )


def line_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Day-granular transactions with heavy ties; the first row of each key is kept."""
    # where the numeric keys tell lines apart as their ids do, the join has brought equal ones together already
    key = ["l_orderkey", "l_linenumber"] if _ids_are_numbers(spark, folder) else "transaction_id"
    rows = keep_first(line_rows(spark, folder), key, LINE_ORDER)
    return rows.drop("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")


def _ids_are_numbers(spark: SparkSession, folder: str) -> bool:
    """Whether every line has a number and an order key of at most ten digits, so that no two get one id."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    odd = F.col("l_linenumber").isNull() | ~F.col("l_orderkey").between(0, 10**10 - 1)
    return not lines.agg(F.coalesce(F.bool_or(odd), F.lit(False))).first()[0]


def blocks_of(spark: SparkSession, folder: str, table: str) -> int | None:
    """Partitions for the rows of a table, if the session's are too few for them; files know their number of rows."""
    return task_parts(spark, spark.read.parquet(f"{folder}/{table}.parquet").count())
