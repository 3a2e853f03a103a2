"""Data-quality report of a canonical table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.operators.quantiles import column_quantiles
from txnrisk.settings import CATEGORICAL_SUMMARY, NUMERIC_SUMMARY


def table_shape(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Rows, columns and rows whose key was seen before."""
    per_key = df.groupBy(key).count()
    return per_key.agg(
        F.sum("count").cast("bigint").alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.sum(F.col("count") - 1).cast("bigint").alias("duplicates"),
    )


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")


def null_counts(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """Nulls per column, all columns in one pass."""
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    long = wide.unpivot([], list(df.columns), "column", "nulls")
    return long.filter("nulls > 0") if only_missing else long


def class_distribution(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    total = F.broadcast(counts.agg(F.sum("rows").alias("_all"), F.lit(1).alias("_j")))  # one row
    return (
        counts.withColumn("_j", F.lit(1)).join(total, "_j")
        .select(label, "rows", F.round(100.0 * F.col("rows") / F.col("_all"), 4).alias("percent"))
    )


def describe_numeric(df: DataFrame, columns: list[str] = NUMERIC_SUMMARY) -> DataFrame:
    """Mean, sample deviation, extremes and exact quartiles, 4 decimals. The number of scans doesn't
    depend on the number of columns."""
    figures = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[f(F.col(c).cast("double")).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in figures.items()]).first()
    quartiles = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    names = ["mean", "std", "min", "p25", "median", "p75", "max"]
    rows = []
    for i, c in enumerate(columns):
        found = dict(zip(("p25", "median", "p75"), quartiles[c], strict=True), **{n: wide[f"{n}_{i}"] for n in figures})
        rows.append((c, *[found[n] for n in names]))
    table = df.sparkSession.createDataFrame(rows, ", ".join(["column string", *[f"{n} double" for n in names]]))
    return table.select("column", *[F.round(n, 4).alias(n) for n in names])


def category_counts(df: DataFrame, columns: list[str] = CATEGORICAL_SUMMARY) -> DataFrame:
    """Frequencies of all listed columns, nulls included, in one job."""
    present = [c for c in columns if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in present])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


def time_range(df: DataFrame) -> DataFrame:
    span = (F.max("ts_sec") - F.min("ts_sec")) / 86400.0
    return df.agg(
        F.min("ts_sec").alias("first_ts"), F.max("ts_sec").alias("last_ts"), F.round(span, 1).alias("days_span")
    )


def entity_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    f = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(
        f("customer_id").alias("customers"), f("merchant_id").alias("merchants"), f("device_id").alias("devices")
    )
