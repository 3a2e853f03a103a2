"""Scans. Raw text is read as strings and typed by explicit casts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.operators.canonical import ARRIVAL, canonicalise
from txnrisk.operators.ordering import with_row_index


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, plus ``_arrival``: the position of a row in its file.

    A row is placed by file, by the offset of its split and, inside a split, by
    reading order, so splitting the file among tasks does not change it.
    """
    raw = spark.read.option("header", True).option("multiLine", False).csv(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
    )
    return raw.select("*", place.alias(ARRIVAL))


def read_transactions(spark: SparkSession, path: str, require_label: bool = True) -> DataFrame:
    """Canonical transactions of a CSV file or folder. A missing path is an error."""
    return canonicalise(read_csv_text(spark, path), require_label=require_label)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan that reads only ``columns``."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def first_rows(ordered: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of an ordered table. By position, not by a sorted limit:
    that would pass ``n`` rows through one task."""
    return with_row_index(ordered).filter(F.col("row_index") < n).drop("row_index")
