import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from txnrisk.operators import metrics as M
from txnrisk.operators.ordering import ordered_table


def sample(n=300, seed=4, levels=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.25)
        p = min(1.0, max(0.0, round(rng.randrange(levels) / levels + 0.1 * y, 4)))
        rows.append((f"T{i:04d}", i // 3, f"C{i % 9}", p, round(rng.random(), 4), y, int(i % 9 < 3), int(i % 9 == 4)))
    return rows


SCHEMA = "transaction_id string, ts_sec bigint, customer_id string, fraud_probability double, novelty_score double, is_fraud int, unseen_customer int, first_time_customer int"


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {"known_customer": 1 - F.col("unseen_customer"), "first_time_device": F.lit(0), "first_time_merchant": F.lit(1)}
    )
    return ordered_table(df, "ts_sec", "transaction_id", blocks=4)


def brute_auc(rows, at=3):
    pos, neg = [r[at] for r in rows if r[5]], [r[at] for r in rows if not r[5]]
    return sum((p > n) + 0.5 * (p == n) for p, n in product(pos, neg)) / (len(pos) * len(neg))


def brute_ap(rows):
    total, ap, before = sum(r[5] for r in rows), 0.0, 0.0
    for t in sorted({r[3] for r in rows}, reverse=True):
        hit = [r for r in rows if r[3] >= t]
        caught = sum(r[5] for r in hit)
        ap += (caught / total - before) * caught / len(hit)
        before = caught / total
    return ap


def brute_top(rows, k):
    top = sorted(rows, key=lambda r: (-r[3], r[1], r[0]))[:k]
    return sum(r[5] for r in top)


def test_ranking(table, rows):
    got = M.ranking_metrics(table, "fraud_probability").first()
    assert got.pr_auc == pytest.approx(brute_ap(rows)) and got.roc_auc == pytest.approx(brute_auc(rows))
    assert M.ranking_metrics(table, "novelty_score").first().roc_auc == pytest.approx(brute_auc(rows, 4))


def test_single_class_is_null(table):
    got = M.ranking_metrics(table.filter("is_fraud = 0"), "fraud_probability").first()
    assert got.pr_auc is None and got.roc_auc is None


def test_budget_grid_cuts_through_ties(table, rows):
    got = {r.budget_pct: r for r in M.at_budget(table, [0.01, 1.0, 7.0, 50.0, 100.0]).collect()}
    for pct, r in got.items():
        k = max(1, round(len(rows) * pct / 100))
        assert (r.alerts, r.tp) == (k, brute_top(rows, k))
        assert r.recall == pytest.approx(r.tp / sum(x[5] for x in rows))


def test_cohort_budget_uses_the_whole_table(table, rows):
    part = table.filter("unseen_customer = 1")
    r = M.at_budget(part, [40.0], n_total=len(rows)).first()
    mine = [x for x in rows if x[6]]
    k = min(len(mine), round(len(rows) * 0.4))
    assert r.alerts == k and r.tp == brute_top(mine, k)


def test_cohort_report(table, rows):
    got = {r.cohort: r for r in M.cohort_report(table, 10.0).collect()}
    assert set(got) == {"all", "known_customers", "unseen_customers", "first_time_customers", "new_merchants"}
    k = round(len(rows) * 0.1)
    for name, keep in (("all", lambda r: True), ("unseen_customers", lambda r: r[6]), ("first_time_customers", lambda r: r[7])):
        part = [r for r in rows if keep(r)]
        g = got[name]
        assert g.n_rows == len(part) and g.n_fraud == sum(r[5] for r in part)
        assert g.roc_auc == pytest.approx(brute_auc(part), abs=1e-4)
        assert g.recall_at_budget == pytest.approx(brute_top(part, k) / max(1, g.n_fraud), abs=1e-4)
        legit = [r for r in part if not r[5]]
        assert g.false_novelty_rate == pytest.approx(sum(r[4] >= 0.9 for r in legit) / len(legit), abs=1e-4)


def test_group_split_takes_the_budget_of_the_group(table, rows):
    got = {r.cohort: r for r in M.seen_unseen_split(table).collect()}
    for name, flag in (("Seen", 0), ("Unseen", 1)):
        part = [r for r in rows if r[6] == flag]
        k = min(max(round(len(part) * 0.02), 1), len(part))
        assert got[name].recall_at_2pct == pytest.approx(brute_top(part, k) / sum(r[5] for r in part), abs=1e-3)


def test_probability_one_counts_only_in_the_reliability_curve(spark):
    df = spark.createDataFrame([(1.0, 0), (0.05, 0), (0.15, 1)], "fraud_probability double, is_fraud int")
    assert M.calibration_error(df).first().ece == pytest.approx((0.05 + 0.85) / 3, abs=1e-5)
    assert M.reliability_summary(df).first().ece == pytest.approx((0.05 + 0.85 + 1.0) / 3, abs=1e-5)
    curve = {r.bin: r for r in M.reliability_curve(df).collect()}
    assert len(curve) == 10 and curve[9]["count"] == 1 and curve[5]["count"] == 0 and curve[5].predicted_mean is None


def test_confusion_without_alerts(spark):
    df = spark.createDataFrame([(1, False), (0, False)], "is_fraud int, alert boolean")
    assert tuple(M.confusion(df, F.col("alert")).first()) == (1, 0, 1, 0, 0.0, 0.0, 0.0)


def test_alert_metrics_and_false_positives(spark):
    df = spark.createDataFrame(
        [("high-risk", "alert", 1, 1), ("review", "alert", 0, 1), ("review", "log", 1, 0), ("monitor", "log", 0, 1)],
        "risk_band string, budget_status string, is_fraud int, first_time_customer int",
    ).withColumns({"first_time_device": F.lit(0), "first_time_merchant": F.lit(0), "first_time_any": F.col("first_time_customer")})
    r = M.alert_metrics(df).first()
    assert (r.alerts_generated, r.high_risk_alerts, r.review_alerts, r.monitor_logged) == (2, 1, 1, 1)
    assert (r.alert_rate_pct, r.alert_precision, r.alert_recall, r.alerts_per_caught_fraud) == (50.0, 0.5, 0.5, 2.0)
    assert M.alert_metrics(df.withColumn("budget_status", F.lit("log"))).first().alert_precision is None
    fp = {x.kind: tuple(x)[1:] for x in M.first_time_false_positives(df).collect()}
    assert fp["first_time_customer"] == (2, 1, 0.5) and fp["first_time_device"] == (0, 0, 0.0)


def test_leakage_audit_finds_a_changed_value(spark):
    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, 3.0)], "transaction_id string, f double, g double")
    b = spark.createDataFrame([("x", 1.0, None), ("y", 2.5, 3.0)], "transaction_id string, f double, g double")
    assert {r.feature: r.mismatches for r in M.leakage_audit(a, b, ["f", "g"]).collect()} == {"f": 1, "g": 0}


def test_curve_rounding_is_limited(table):
    with pytest.raises(ValueError):
        M.scores_at(table, "fraud_probability", digits=9)
