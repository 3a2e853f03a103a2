import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from txnrisk.operators import asof, ordering
from txnrisk.sources import tables

LINES = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
)


def _folder(spark, path, odd=False):
    rng = random.Random(3)
    lines = [
        (rng.randrange(40), rng.randrange(9), rng.randrange(5), rng.randrange(1, 4), float(rng.randrange(9)), float(rng.randrange(90)),
         0.1, 0.2, "R", "O", datetime(2024, 1, rng.randrange(1, 28)))
        for _ in range(400)
    ]
    if odd:  # ids of eleven digits are cut to ten, and lines without a number share the missing id
        lines += [(k, 1, 1, n, 1.0, 5.0, 0.1, 0.2, "R", "O", datetime(2024, 2, 1)) for k, n in
                  ((12345678901, 1), (12345678902, 1), (1234567890, 1), (3, None), (4, None))]
    spark.createDataFrame(lines, LINES).write.parquet(f"{path}/lineitem.parquet")
    keys = {r[0] for r in lines}
    spark.createDataFrame([(k, k % 7) for k in sorted(keys)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{path}/orders.parquet")
    return str(path)


def _plain(spark, folder):
    rows = sorted(tables.line_rows(spark, folder).collect(), key=lambda r: tuple(r[c] for c in tables.LINE_ORDER))
    first = {}
    for r in rows:
        first.setdefault(r.transaction_id, (r.transaction_id, r.ts_sec, r.customer_id, r.merchant_id, r.device_id, r.amount))
    return sorted(first.values(), key=str)


def _got(rows):
    return sorted((tuple(r)[:6] for r in rows.collect()), key=str)


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("task_rows", [50, 500_000])
def test_first_line_of_each_id(spark, tmp_path, monkeypatch, odd, task_rows):
    monkeypatch.setattr(ordering, "TASK_ROWS", task_rows)
    folder = _folder(spark, tmp_path, odd)
    found = tables.line_transactions(spark, folder)
    assert [t[:2] for t in _got(found)] == [t[:2] for t in _plain(spark, folder)]
    if not odd:
        assert _got(found) == _plain(spark, folder)


def test_lines_move_once_and_in_pieces_that_a_task_can_sort(spark, tmp_path, monkeypatch):
    folder = _folder(spark, tmp_path)
    monkeypatch.setattr(ordering, "TASK_ROWS", 50)
    found = tables.line_transactions(spark, folder)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(transaction_id" not in plan and "hashpartitioning(l_orderkey#" in plan and ", 8)" in plan
    log = asof.TxnLog.build(found, blocks=tables.blocks_of(spark, folder, "lineitem"))
    assert log.parts is None or log.parts > 4
    assert log.rows.select(ordering.block_of()).distinct().count() > 4


@pytest.mark.parametrize("heavy_limit", [10, 1_000_000])
def test_history_is_the_same_in_more_partitions(spark, tmp_path, monkeypatch, heavy_limit):
    folder = _folder(spark, tmp_path)
    rows = tables.line_transactions(spark, folder)
    few = asof.TxnLog.build(rows, heavy_limit=heavy_limit)
    monkeypatch.setattr(ordering, "TASK_ROWS", 20)
    many = asof.TxnLog.build(rows, heavy_limit=heavy_limit)
    assert few.parts is None and many.parts > 4
    x = {"n": ("count", None), "m": ("mean", F.col("amount"))}
    for log in (few, many):
        both = asof.history(log, asof.customer_activity(log, log.rows), "merchant_id", x)
        kept = sorted(tuple(r) for r in both.select("transaction_id", "n", "m", "customer_history_count", "txn_count_24h", "amount_sum_24h").collect())
        plan = asof.running_global(log, log.rows)._jdf.queryExecution().executedPlan().toString()
        assert ("REPARTITION_BY_NUM" in plan) == (log is many)
        if log is few:
            first = kept
    assert kept == first


def test_partitions_count_what_adaptive_execution_leaves(spark, monkeypatch):
    """A session may ask for many partitions: adaptive execution still draws them together to one for each core."""
    cores, asked = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(ordering, "TASK_ROWS", 50)
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        assert ordering.task_parts(spark, 50 * cores) is None
        assert ordering.task_parts(spark, 50 * cores + 1) == cores + 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", asked)
