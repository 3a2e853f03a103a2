"""Training, scoring, evaluation and saved bundles from end to end on small data."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SCHEMA, make_rows
from txnrisk.operators import canonical, models
from txnrisk.operators.asof import TxnLog
from txnrisk.plans import evaluation, scoring
from txnrisk.settings import BANDS, AlertBudget
from txnrisk.sources import writers
from txnrisk.sources.artifacts import load_bundle, save_bundle

SMALL = models.TreeParams(forest_trees=5, forest_depth=3, forest_leaf=5, boost_rounds=4, boost_depth=3, boost_leaf=5)


@pytest.fixture(scope="module")
def trained(spark):
    log = TxnLog.build(spark.createDataFrame(make_rows(700, seed=21), SCHEMA), blocks=3)
    return scoring.train(log, size=SMALL, candidates=("logistic_regression", "boosted_trees"), forest_trees=10, forest_sample=64)


@pytest.fixture(scope="module")
def scored(trained):
    return scoring.score_fold(trained, budget=AlertBudget(20.0, 10.0, 50, 50), explain=True).cache()


def test_decisions_are_in_range_and_inside_the_budget(scored):
    rows = scored.collect()
    assert len(rows) == 700 - int(700 * 0.8)
    for r in rows:
        assert 0 <= r.fraud_probability <= 1 and 0 <= r.novelty_score <= 1 and r.risk_band in BANDS
        assert r.budget_status == "log" or r.alert
        assert len(r.top_contributing_features) <= 5
        assert r.explanation == "; ".join(x.reason for x in r.top_contributing_features)
    assert len({r.transaction_id for r in rows}) == len(rows)


def test_held_out_customers_never_train(trained):
    held = {r[0] for r in trained.holdout.collect()}
    seen = {r[0] for r in trained.fold("train").select("customer_id").distinct().collect()}
    assert held and not held & seen


def test_every_model_kind_is_explained(spark, trained):
    for stage in ("logistic_regression", "boosted_trees"):
        fit = {
            "logistic_regression": lambda: models.fit_logistic(trained.fold("train")),
            "boosted_trees": lambda: models.fit_boosting(trained.fold("train"), trained.fold("val"), size=SMALL),
        }[stage]()
        bundle = scoring.Bundle(**{**trained.bundle.__dict__, "model": fit, "model_name": stage})
        rows = models.with_raw_probability(fit, scoring.with_contributions(bundle, trained.fold("test")))
        margin = F.log(F.col("raw_probability") / (1 - F.col("raw_probability")))
        rest = rows.select((margin - F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)).alias("bias"))
        low, high = rest.agg(F.min("bias"), F.max("bias")).first()
        assert high - low < 1e-6  # contributions explain everything but a constant


def test_saved_bundle_scores_alike(spark, trained, tmp_path):
    path = str(tmp_path / "bundle")
    save_bundle(trained.bundle, path, spark)
    again = load_bundle(spark, path)
    assert again.thresholds == trained.bundle.thresholds and again.priors == trained.bundle.priors
    keep = ["transaction_id", "fraud_probability", "novelty_score", "risk_band", "rank_score"]
    a = scoring.score_features(trained.bundle, trained.fold("test")).select(*keep)
    b = scoring.score_features(again, trained.fold("test")).select(*keep)
    assert sorted(a.collect()) == sorted(b.collect())


def test_report(spark, trained, scored, tmp_path):
    known = trained.fold("train").select("customer_id").distinct()
    tables = evaluation.evaluate(scored.drop("fold"), known, trained.fold("test"))
    path = str(tmp_path / "report")
    writers.write_json(evaluation.as_report(tables), path)
    rows = spark.read.json(path).collect()
    assert {r.table for r in rows} >= {"ranking", "confusion", "cohorts", "alerts", "reliability", "pr_curve"}
    c = json.loads(next(r.row for r in rows if r.table == "confusion"))
    assert c["tn"] + c["fp"] + c["fn"] + c["tp"] == scored.count()


def test_exports(spark, scored, tmp_path):
    writers.write_csv(scored, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == [c for c in writers.EXPORT_COLUMNS if c in scored.columns] and back.count() == scored.count()
    assert json.loads(writers.as_json(scored.select("tags", "risk_band")).first()[0]).keys() == {"tags", "risk_band"}
    writers.write_scores(scored, str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores")).count() == scored.count()


def test_history_accumulates_and_answers_keep_request_order(spark, trained):
    rows = [
        ("r0", 1_714_555_500, "C-PIT", "M-1", "D-1", 20.0, 8, 0), ("r1", 1_714_550_400, "C-PIT", "M-1", "D-1", 10.0, 8, 0),
        ("r2", 1_714_550_700, "C-PIT", "M-2", "D-1", 12.0, 8, 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    index = df.select("transaction_id", F.substring("transaction_id", 2, 1).cast("int").alias("i"))
    answers = scoring.score_log(trained.bundle, TxnLog.build(df)).join(index, "transaction_id")
    got = canonical.in_request_order(answers, "i").collect()
    assert [r.transaction_id for r in got] == ["r0", "r1", "r2"]
    assert [r.customer_history_count for r in got] == [2, 0, 1]
