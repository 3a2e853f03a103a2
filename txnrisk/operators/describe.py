"""Descriptive aggregates: the numbers behind charts and insight lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import columns as C
from txnrisk.operators.metrics import ranking_metrics
from txnrisk.operators.quantiles import exact_quantiles


def rate_by(df: DataFrame, key: str) -> DataFrame:
    """Rows and label rate for each value of a column."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("is_fraud"), 6).alias("fraud_rate")
    )


def rate_by_newness(df: DataFrame, flags: list[str]) -> DataFrame:
    """Label rate of new and known entities, one job for all flags."""
    pairs = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).cast("int").alias("value")) for f in flags])
    return rate_by_pair(df.select("is_fraud", F.inline(pairs)))


def rate_by_pair(long: DataFrame) -> DataFrame:
    return long.groupBy("flag", "value").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("is_fraud"), 6).alias("fraud_rate")
    )


def histogram_by_class(df: DataFrame, value: Column, bins: int, label: str = "is_fraud") -> DataFrame:
    """Equal-width histogram between each class's own extremes; the last bin is closed."""
    rows = df.select(F.col(label).alias("class"), value.alias("v")).filter(F.col("v").isNotNull())
    limits = rows.groupBy("class").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row per class
    width = F.col("hi") - F.col("lo")
    place = F.floor((F.col("v") - F.col("lo")) / width * bins).cast("int")
    at = F.when(width > 0, F.least(place, F.lit(bins - 1))).otherwise(F.lit(0))
    return (
        rows.join(F.broadcast(limits), "class")
        .groupBy("class", at.alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def probability_novelty_grid(scored: DataFrame, cells: int = 20) -> DataFrame:
    """Counts over a square grid of probability and novelty, by class."""
    def cell(c: str) -> Column:
        return F.least(F.floor(F.col(c) * cells), F.lit(cells - 1)).cast("int")

    return scored.groupBy(
        cell("fraud_probability").alias("p_cell"), cell("novelty_score").alias("novelty_cell"), "is_fraud"
    ).agg(F.count(F.lit(1)).alias("rows"))


def band_counts(scored: DataFrame) -> DataFrame:
    """Rows per risk band, from normal to high-risk; absent bands are left out."""
    counts = scored.groupBy("risk_band").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("position", C.band_position(F.col("risk_band"))).orderBy("position")


def cold_vs_established(features: DataFrame) -> DataFrame:
    """Mean absolute amount deviation and share of rows for each history stratum."""
    return features.groupBy("history_stratum").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.abs("amount_z_shrunk")), 4).alias("mean_abs_z")
    )


def novelty_summary(scored: DataFrame, value: str = "novelty_score", atypical: float = 0.9) -> DataFrame:
    p25, median, p75 = exact_quantiles(scored, value, [0.25, 0.5, 0.75])
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(value), 4).alias("mean"),
        F.round(F.stddev_samp(value), 4).alias("std"),
        F.min(value).alias("min"),
        F.round(F.lit(p25), 4).alias("p25"),
        F.round(F.lit(median), 4).alias("median"),
        F.round(F.lit(p75), 4).alias("p75"),
        F.max(value).alias("max"),
        F.round(F.avg((F.col(value) > atypical).cast("double")), 4).alias("share_atypical"),
    )


def mean_amount_by_class(df: DataFrame) -> DataFrame:
    return df.groupBy("is_fraud").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("amount"), 4).alias("mean_amount")
    )


def file_report(scored: DataFrame) -> DataFrame:
    """One row of alert, band and label figures of a scored file."""
    alert = F.col("budget_status") == "alert"
    counts = scored.agg(
        F.count(F.lit(1)).alias("rows_scored"),
        F.count_if(alert).alias("alerts_fired"),
        *[F.count_if(F.col("risk_band") == b).alias(b.replace("-", "_")) for b in ("high-risk", "review", "monitor", "normal")],
        F.sum("is_fraud").cast("bigint").alias("fraud_rows_in_file"),
        F.count_if(alert & (F.col("is_fraud") == 1)).alias("_tp"),
        F.lit(1).alias("_j"),
    )
    ranking = ranking_metrics(scored, "fraud_probability").withColumn("_j", F.lit(1))
    n, alerts, tp, fraud = F.col("rows_scored"), F.col("alerts_fired"), F.col("_tp"), F.col("fraud_rows_in_file")
    one = F.lit(1)
    return counts.join(F.broadcast(ranking), "_j").select(
        "rows_scored", "alerts_fired", "high_risk", "review", "monitor", "normal",
        F.round(100.0 * alerts / F.greatest(n, one), 3).alias("alert_rate_pct"),
        "fraud_rows_in_file",
        F.round(100.0 * fraud / F.greatest(n, one), 3).alias("fraud_rate_pct"),
        F.when(alerts > 0, F.round(tp / alerts, 4)).alias("alert_precision"),
        F.round(tp / F.greatest(fraud, one), 4).alias("alert_recall"),
        F.round("pr_auc", 4).alias("pr_auc"),
        F.round("roc_auc", 4).alias("roc_auc"),
    )


def top_tags(scored: DataFrame, n: int = 3) -> DataFrame:
    counts = scored.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.desc("rows"), "tag").limit(n)


def insight_facts(flagged: DataFrame) -> DataFrame:
    """Shares of rows that alert and that belong to unseen customers, in percent."""
    return flagged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(C.is_alert(F.col("risk_band"))).alias("alerting"),
        F.round(100.0 * F.avg(C.is_alert(F.col("risk_band")).cast("double")), 1).alias("alerting_pct"),
        F.sum("unseen_customer").cast("bigint").alias("unseen"),
        F.round(100.0 * F.avg("unseen_customer"), 1).alias("unseen_pct"),
    )
