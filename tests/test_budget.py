"""The budget operator against a literal walk over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from txnrisk.operators import budget as B
from txnrisk.operators.ordering import ordered_table
from txnrisk.settings import AlertBudget
from txnrisk.streaming.budget import StreamingBudget

DAY = 86_400
SCHEMA = "transaction_id string, ts_sec bigint, risk_band string, rank_score double"


def walk(rows, b):
    alerts, volume, out = [], {}, {}
    for tid, ts, band, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        day = ts // DAY
        volume[day] = volume.get(day, 0) + 1
        out[tid] = "log"
        if band not in ("high-risk", "review"):
            continue
        cap = max(3, int(volume[day] * b.budget_pct / 100.0))
        high_cap = max(2, int(volume[day] * b.high_risk_pct / 100.0))
        today = [a for a in alerts if a[0] // DAY == day]
        if band == "high-risk" and sum(a[1] for a in today) >= high_cap:
            continue
        hour = sum(ts - a[0] <= 3600 for a in alerts)
        rolling = sum(ts - a[0] <= DAY for a in alerts)
        if hour < b.max_per_hour and rolling < b.max_per_day and len(today) < cap:
            alerts.append((ts, band == "high-risk"))
            out[tid] = "alert"
    return out


def make(n, seed, spread):
    rng = random.Random(seed)
    bands = ["normal"] * 5 + ["monitor"] + ["review"] * 3 + ["high-risk"] * 2
    base = 19_700 * DAY
    # a third of the rows falls into one second
    return [
        (f"T{i:05d}", base + (DAY + 77 if rng.random() < 0.33 else rng.randrange(spread)), rng.choice(bands), rng.random())
        for i in range(n)
    ]


CASES = [
    ("no rolling limit reached", AlertBudget(10.0, 4.0, 10_000, 10_000), 3 * DAY),
    ("hour limit", AlertBudget(20.0, 8.0, 4, 10_000), 3 * DAY),
    ("day limit across midnight", AlertBudget(30.0, 10.0, 10_000, 15), 4 * DAY),
    ("both", AlertBudget(40.0, 20.0, 5, 20), 2 * DAY),
]


@pytest.mark.parametrize("name,b,spread", CASES, ids=[c[0] for c in CASES])
def test_budget_equals_literal_walk(spark, name, b, spread):
    rows = make(600, len(name), spread)
    table = ordered_table(spark.createDataFrame(rows, SCHEMA), "ts_sec", "transaction_id", blocks=4)
    got = {r.transaction_id: r.budget_status for r in B.apply_budget(table, b).collect()}
    want = walk(rows, b)
    assert got == want
    assert "alert" in want.values()


def test_limited_days_are_folded_day_by_day(spark, monkeypatch):
    """Rolling limits that reach across every midnight need no pass over all days in one task."""
    rows = make(900, 11, 6 * DAY)
    b = AlertBudget(90.0, 60.0, 6, 25)
    table = ordered_table(spark.createDataFrame(rows, SCHEMA), "ts_sec", "transaction_id", blocks=4)
    monkeypatch.setattr(type(table), "coalesce", lambda *_: pytest.fail("all days in one task"))
    got = {r.transaction_id: r.budget_status for r in B.apply_budget(table, b).collect()}
    assert got == walk(rows, b)


def test_only_a_bounded_part_of_a_second_is_folded(spark):
    rows = [(f"T{i:05d}", 19_700 * DAY, "review", 0.5) for i in range(3000)]
    b = AlertBudget(50.0, 50.0, 5, 8)
    table = ordered_table(spark.createDataFrame(rows, SCHEMA), "ts_sec", "transaction_id", blocks=4)
    open_rows = B.candidates(B.with_volume(table, b), b)
    # caps stop growing at the daily limit, so most of the second is one cell
    assert open_rows.count() < 100
    got = {r.transaction_id: r.budget_status for r in B.apply_budget(table, b).collect()}
    assert got == walk(rows, b)


def test_burst_stays_inside_the_smallest_budget(spark):
    rows = [(f"T{i:02d}", 19_700 * DAY + i, "high-risk" if i % 2 else "review", 0.9) for i in range(60)]
    table = ordered_table(spark.createDataFrame(rows, SCHEMA), "ts_sec", "transaction_id")
    decided = B.apply_budget(table)
    assert decided.filter("budget_status = 'alert'").count() == 3
    assert tuple(B.budget_counters(decided).first()) == (1, 2, 3, 57)


def test_five_hourly_reviews(spark):
    rows = [(f"T{i}", 19_700 * DAY + 3600 * i, "review", 0.5) for i in range(5)]
    table = ordered_table(spark.createDataFrame(rows, SCHEMA), "ts_sec", "transaction_id")
    assert [r.budget_status for r in B.apply_budget(table).orderBy("seq").collect()] == ["alert"] * 3 + ["log"] * 2


def test_micro_batches_equal_one_pass(spark, tmp_path):
    b = AlertBudget(30.0, 10.0, 6, 25)
    rows = sorted(make(500, 3, 3 * DAY), key=lambda r: (r[1], r[0]))
    job = StreamingBudget(str(tmp_path / "budget"), b)
    cuts = [0, 120, 121, 300, 500]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame(rows[lo:hi], SCHEMA)
        job(part, i)
        if i == 1:
            job(part, i)  # a repeated batch changes nothing
    got = {r.transaction_id: r.budget_status for r in spark.read.parquet(str(tmp_path / "budget/decisions")).collect()}
    assert got == walk(rows, b)


def test_volume_counts_along_blocks(spark):
    rows = make(300, 5, 2 * DAY)
    table = ordered_table(spark.createDataFrame(rows, SCHEMA), "ts_sec", "transaction_id", blocks=5)
    seen = {}
    got = {r.transaction_id: r.day_volume for r in B.with_volume(table).select("transaction_id", F.col("day_volume")).collect()}
    for tid, ts, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        seen[ts // DAY] = seen.get(ts // DAY, 0) + 1
        assert got[tid] == seen[ts // DAY]
