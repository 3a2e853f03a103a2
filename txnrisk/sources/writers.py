"""Sinks for features, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: columns of a scored export, in file order
EXPORT_COLUMNS = [
    "transaction_id", "timestamp", "amount", "fraud_probability", "novelty_score",
    "risk_band", "rank_score", "is_fraud", "budget_status", "explanation",
]


def write_features(df: DataFrame, path: str, fold: str = "fold") -> None:
    """One folder per fold."""
    df.write.mode("overwrite").partitionBy(fold).parquet(path)


def write_scores(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_view(scored: DataFrame) -> DataFrame:
    return scored.select(*[c for c in EXPORT_COLUMNS if c in scored.columns])


def write_csv(scored: DataFrame, path: str) -> None:
    export_view(scored).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; nested reasons and tags stay nested."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def as_json(df: DataFrame, name: str = "record") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))
