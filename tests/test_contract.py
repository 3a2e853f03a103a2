import os

import pytest

import __spark_entry__ as contract
from checks.compare import compare

FOLDER = "/root/testdata/sf0.001"

# one of each family; `python -m checks.compare <folder>` runs all of them
SAMPLE = [
    "canonical_raw", "foreign_adapter", "dq_describe", "time_split", "holdout_anti", "asof_supplied_lines",
    "velocity_lines", "feature_full", "segment_priors_cube", "thresholds_quantile", "risk_bands", "rebudget",
    "alert_budget", "reason_text", "cohort_report", "recall_at_budget", "leakage_audit", "score_hist", "csv_round_trip",
]

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def test_every_oracle_belongs_to_a_query():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 100 and len(oracles) > 100


@needs_tables
def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 1000 and "txn_count_24h" in df.columns


@needs_tables
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    line = compare(spark, FOLDER, name, contract.queries()[name], contract.oracle_sql()[name])
    assert line.startswith("ok"), line
