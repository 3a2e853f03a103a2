"""Thresholds, risk bands and rankings."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import columns as C
from txnrisk.operators.ordering import value_counts_running
from txnrisk.operators.quantiles import exact_quantiles
from txnrisk.settings import DEFAULTS, AlertBudget, Thresholds


def fit_thresholds(
    scores: DataFrame,
    p: str = "fraud_probability",
    budget: AlertBudget = DEFAULTS.budget,
    base: Thresholds = DEFAULTS.thresholds,
) -> Thresholds:
    """Probability thresholds that leave the budgeted shares of ``scores`` above them; ``base`` without any score."""
    high_at = 1.0 - budget.high_risk_pct / 100.0
    review_at = max(0.0, 1.0 - budget.budget_pct / 100.0)
    p_high, p_review = exact_quantiles(scores, p, [high_at, review_at])
    if p_high is None:
        return base
    return replace(
        base,
        p_review=round(max(p_review, 0.001), 4),
        p_high=round(max(p_high, p_review + 0.001, 0.01), 4),
    )


def thresholds_table(spark, thresholds: Thresholds) -> DataFrame:
    row = asdict(thresholds)
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))


def with_decision(
    df: DataFrame, thresholds: Thresholds, p: str = "p", novelty: str = "novelty"
) -> DataFrame:
    """Band, alert flag, rank and tags. Outputs are rounded after the decision."""
    pc, nc = C.clipped(F.col(p)), C.clipped(F.col(novelty))
    return (
        df.withColumns({"_p": pc, "_nov": nc})
        .withColumn("risk_band", C.risk_band(F.col("_p"), F.col("_nov"), thresholds))
        .withColumns(
            {
                "fraud_probability": F.round("_p", 4),
                "novelty_score": F.round("_nov", 4),
                "alert": C.is_alert(F.col("risk_band")),
                "rank_score": F.round(C.rank_score(F.col("_p"), F.col("_nov")), 6),
                "tags": C.risk_tags(F.col("risk_band"), F.col("_nov"), thresholds),
            }
        )
        .drop("_p", "_nov")
    )


def unbudgeted_status(df: DataFrame) -> DataFrame:
    return df.withColumn("budget_status", F.when(F.col("alert"), "alert").otherwise("log"))


def thresholds_for_budget(
    scored: DataFrame, budget_pct: float, base: Thresholds, high_share_pct: float = 70.0
) -> Thresholds:
    """Thresholds as the k-th highest probability: k is the budgeted number of rows
    for review and a share of that number for high risk."""
    counts = value_counts_running(scored, "fraud_probability", {"n": F.lit(1)})
    n = counts.agg(F.sum("n")).first()[0] or 0
    if not n:
        return base
    k_review = min(max(int(round(n * budget_pct / 100.0)), 1), n)
    k_high = min(max(int(round(k_review * high_share_pct / 100.0)), 1), n)

    def kth_highest(k: int):
        rank = n - k  # the same row counted from the lowest value
        holds = (F.col("before_n") <= rank) & (F.lit(rank) < F.col("before_n") + F.col("n"))
        return F.max(F.when(holds, F.col("fraud_probability")))

    p_review, p_high = counts.agg(kth_highest(k_review), kth_highest(k_high)).first()
    return replace(base, p_review=float(p_review), p_high=float(p_high))


def rebudgeted(scored: DataFrame, budget_pct: float, base: Thresholds = DEFAULTS.thresholds) -> DataFrame:
    """Bands and alerts of already scored rows under another alert budget."""
    t = thresholds_for_budget(scored, budget_pct, base)
    p, nov = F.col("fraud_probability"), F.col("novelty_score")
    out = scored.withColumn("risk_band", C.risk_band(p, nov, t))
    out = out.withColumns({"alert": C.is_alert(F.col("risk_band")), "rank_score": C.rank_score(p, nov)})
    return unbudgeted_status(out)


def top_alerts(scored: DataFrame, n: int | None = None, status: str = "budget_status") -> DataFrame:
    """Alerted rows, riskiest first; equal ranks in time order."""
    alerts = scored.filter(F.col(status) == "alert").orderBy(F.desc("rank_score"), "ts_sec", "transaction_id")
    return alerts.limit(n) if n else alerts
