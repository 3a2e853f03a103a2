import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SCHEMA, make_rows
from txnrisk.functions import columns as C
from txnrisk.operators import decide, reasons, splits
from txnrisk.operators.asof import TxnLog
from txnrisk.settings import MODEL_FEATURES, REASON_GROUPS, AlertBudget, Thresholds


@pytest.mark.parametrize(
    "p,novelty,band,tags",
    [(0.001, 0.95, "monitor", ["novel_pattern"]), (0.05, 0.95, "monitor", ["novel_pattern"]),
     (0.55, 0.30, "high-risk", ["high_probability"]), (0.80, 0.99, "high-risk", ["high_probability", "novel_pattern"]),
     (0.20, 0.10, "review", []), (0.02, 0.97, "review", ["novel_pattern"]), (0.01, 0.5, "normal", []),
     (1.7, -3.0, "high-risk", ["high_probability"])],
)
def test_decision_matrix(spark, p, novelty, band, tags):
    r = decide.with_decision(spark.createDataFrame([(p, novelty)], "p double, novelty double"), Thresholds()).first()
    assert (r.risk_band, r.tags, r.alert) == (band, tags, band in ("review", "high-risk"))
    clip = lambda v: min(1.0, max(0.0, v))
    assert r.rank_score == pytest.approx(0.7 * clip(p) + 0.3 * clip(novelty), abs=1e-6)


def test_outputs_are_rounded_after_the_decision(spark):
    r = decide.with_decision(spark.createDataFrame([(0.449996, 0.1)], "p double, novelty double"), Thresholds()).first()
    assert r.risk_band == "review" and r.fraud_probability == 0.45


def test_threshold_floors(spark):
    df = spark.createDataFrame([(0.0,)] * 50, "p double")
    t = decide.fit_thresholds(df, "p")
    assert (t.p_review, t.p_high) == (0.001, 0.01)
    values = np.random.default_rng(1).random(500)
    t = decide.fit_thresholds(spark.createDataFrame([(float(v),) for v in values], "p double"), "p", AlertBudget())
    assert t.p_review == round(float(np.quantile(values, 0.98)), 4) and t.p_high == round(float(np.quantile(values, 0.993)), 4)


def test_rebudget_takes_the_kth_probability(spark):
    ps = [round(i / 200, 4) for i in range(200)]
    df = spark.createDataFrame([(p, 0.0) for p in ps], "fraud_probability double, novelty_score double")
    t = decide.thresholds_for_budget(df, 5.0, Thresholds())
    assert t.p_review == sorted(ps)[-10] and t.p_high == sorted(ps)[-7]
    out = decide.rebudgeted(df, 5.0)
    assert out.filter("alert").count() == 10 and out.filter("risk_band = 'high-risk'").count() == 7


def test_time_split_by_position_and_holdout(spark):
    rows = make_rows(103)
    log = TxnLog.build(spark.createDataFrame(rows, SCHEMA), blocks=5)
    folds = splits.time_split(log)
    counts = {r.fold: r["count"] for r in folds.groupBy("fold").count().collect()}
    assert counts == {"train": int(103 * 0.6), "val": int(103 * (0.6 + 0.2)) - int(103 * 0.6), "test": 103 - int(103 * (0.6 + 0.2))}
    held = splits.holdout_customers(log.rows)
    assert held.count() == max(2, int(log.rows.select("customer_id").distinct().count() * 0.2))
    assert sorted(held.collect()) == sorted(splits.holdout_customers(log.rows).collect())
    left = splits.without_holdout(folds, held)
    inside = splits.members(left, held, "customer_id")
    assert inside.filter("fold = 'train'").count() == 0
    assert left.filter("fold <> 'train'").count() == counts["val"] + counts["test"]


def test_small_half_split_keeps_fifty_rows_for_fitting(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("i"))
    got = {r.half: r["count"] for r in splits.half_split(df, "i").groupBy("half").count().collect()}
    assert got == {"fit": 50, "eval": 10}


def test_tenure_keeps_young_customers_warm(spark):
    df = spark.createDataFrame([(0, 99.0), (4, 99.0), (9, 3.0), (9, 8.0)], "n int, d double")
    got = [r[0] for r in df.select(C.stratum_with_tenure(F.col("n"), F.col("d"))).collect()]
    assert got == ["cold", "warm", "warm", "established"]


# ------------------------------------------------------------------ reasons
def _row(spark, contributions):
    values = {f: 0.0 for f in MODEL_FEATURES}
    values.update(amount_z_shrunk=1.234, txn_count_5m=2.0, transaction_hour=3.0, is_night=1.0, new_device=1.0,
                  merchant_history_count=7.0, customer_history_count=4.0, customer_history_conf=0.444)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{f} double" for f in values))
    array = F.array(*[F.lit(float(contributions.get(f, 0.0))) for f in MODEL_FEATURES])
    return df.withColumn("contributions", array)


def test_reasons_are_grouped_sorted_and_cut(spark):
    r = reasons.with_reasons(_row(spark, {
        "txn_count_5m": 0.5, "txn_count_24h": 0.25, "amount_log": -0.3, "new_device": 0.00001, "is_night": 0.1, "customer_amount_z": 0.05,
    })).first()
    got = [(x.feature, x.effect, x.contribution) for x in r.top_contributing_features]
    assert got == [("velocity", "increases_risk", 0.75), ("amount", "decreases_risk", -0.25), ("time", "increases_risk", 0.1),
                   ("history", "increases_risk", 0.05)]
    assert r.explanation.startswith("Velocity elevated: 2 txns in last 5 min, 0 in 30 min, 0 in 24h (increases risk).; Amount is 1.2 sd above")
    assert "Transaction at 03:00 (night-time) (increases risk)." in r.explanation
    assert "Customer history: 4 prior txns, confidence 0.44 (increases risk)." in r.explanation
    assert len(r.positive_contributors) == 3 and len(r.negative_contributors) == 1


def test_two_features_count_in_two_families():
    flat = [f for g in REASON_GROUPS.values() for f in g]
    assert {f for f in flat if flat.count(f) == 2} == {"customer_amount_z", "merchant_amount_z"}
    assert set(MODEL_FEATURES) - set(flat) == {"customer_avg_amount_log"}


def test_linear_contributions_add_up(spark):
    weights = {"amount_z_shrunk": 2.0, "txn_count_5m": -0.5}
    means = {"amount_z_shrunk": 0.2, "txn_count_5m": 1.0}
    df = _row(spark, {}).withColumn("c", reasons.linear_contributions(weights, means))
    df = df.withColumn("m", reasons.linear_margin(weights, 0.7))
    r = df.first()
    assert sum(r.c) + (0.7 + 2.0 * 0.2 - 0.5 * 1.0) == pytest.approx(r.m)


def test_single_features_are_worded_once_they_are_chosen(spark):
    values = [0.3, None, -0.5, 0.0, 0.3] + [0.01 * i for i in range(35)]
    df = spark.createDataFrame([(values,)], "contributions array<double>")
    rows = reasons.with_reasons(df, grouped=False, k=4)
    top = rows.first()["top_contributing_features"]
    assert [r["reason"] for r in top] == ["contrib -0.500", "contrib +0.340", "contrib +0.330"]  # a missing one takes a place
    plan = rows.select("top_contributing_features")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string") == 1


def test_reasons_are_worked_out_once_for_a_row_each(spark):
    """An inner explode repeats the whole array in a filter at the scan."""
    rows = spark.range(3).select(
        F.col("id").alias("transaction_id"), *[(F.col("id") * 1.0).alias(f) for f in MODEL_FEATURES],
        F.array(*[F.col("id") * (i + 1.0) for i in range(len(MODEL_FEATURES))]).alias("contributions"),
    )
    flat = reasons.one_row_each(reasons.with_reasons(rows), "transaction_id")
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("array_sort") == 1
    got = {(r.transaction_id, r.place): r.r.feature for r in flat.collect()}
    assert sorted(got) == [(i, p) for i in (1, 2) for p in range(5)]  # nothing is shown of the row without contributions
    assert len({got[1, p] for p in range(5)}) == 5
