import random

import numpy as np
from pyspark.sql import functions as F

from txnrisk.operators.ordering import (
    blockwise, ordered_table, value_counts_running, with_row_index,
)
from txnrisk.operators.quantiles import exact_quantiles


def _table(spark, n=500, keys=5, blocks=7):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(keys)}", rng.randrange(100)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, k string, v bigint")
    return sorted(rows), ordered_table(df, "id", blocks=blocks)


def test_blocks_follow_the_order(spark):
    rows, table = _table(spark)
    got = [r.id for r in table.orderBy("seq").collect()]
    assert got == [r[0] for r in rows]
    assert table.select((F.col("seq").bitwiseAND(F.lit(-1)) / 2**33).cast("int").alias("b")).distinct().count() > 3


def test_blockwise_equals_a_plain_scan(spark):
    rows, table = _table(spark)
    bases = {"n": ("sum", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v"))}
    got = {r.id: (r.n, r.s, r.m) for r in blockwise(table, ["k"], bases).collect()}
    seen = {}
    for i, k, v in rows:
        past = seen.setdefault(k, [])
        assert got[i] == (len(past), sum(past), max(past, default=None))
        past.append(v)
    after = {r.id: r.lo for r in blockwise(table, ["k"], {}, after={"lo": ("min", F.col("v"))}).collect()}
    later = {}
    for i, k, v in reversed(rows):
        assert after[i] == min(later.get(k, []), default=None)
        later.setdefault(k, []).append(v)


def test_row_index(spark):
    rows, table = _table(spark)
    got = [r.row_index for r in with_row_index(table).orderBy("id").collect()]
    assert got == list(range(len(rows)))


def test_positions_of_a_whole_table_need_no_shuffle(spark):
    table = ordered_table(spark.range(1000).select((F.col("id") * 37 % 1000).alias("id")), "id", blocks=5)
    indexed = with_row_index(table)
    plan = indexed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange range" not in plan and "Window" not in plan
    assert [r.row_index for r in indexed.orderBy("id").collect()] == list(range(1000))
    part = with_row_index(table.filter("id % 3 = 0"))  # counted, as rows are missing
    assert [r.row_index for r in part.orderBy("id").collect()] == list(range(334))
    assert with_row_index(table.limit(0)).count() == 0


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(3)
    values = [round(rng.gauss(10, 4), 2) for _ in range(801)] + [5.0] * 400
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    probs = [0.0, 0.02, 0.25, 0.5, 0.993, 1.0]
    assert np.allclose(exact_quantiles(df, "x", probs), np.quantile(values, probs))
    assert exact_quantiles(df.filter("x > 1e9"), "x", [0.5]) == [None]


def test_running_value_counts(spark):
    df = spark.createDataFrame([(3,), (1,), (1,), (2,), (3,), (3,)], "v int")
    got = {r.v: (r.n, r.before_n) for r in value_counts_running(df, "v", {"n": F.lit(1)}).collect()}
    assert got == {1: (2, 0), 2: (1, 2), 3: (3, 3)}


def test_a_frequent_key_is_joined_in_many_tasks(spark):
    """One key holds half of the rows; no task of the join may hold them."""
    from txnrisk.operators.ordering import spread_join

    rows = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 3 == 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    table = spark.createDataFrame([("hot", 1), ("k3", 2), ("absent", 3)], "key string, value int")
    auto, adaptive = (spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        for df in (rows, ordered_table(rows, "id", blocks=16)):
            got = spread_join(df, table, "key")
            sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
            assert max(sizes) < 0.45 * 20_000 and sum(sizes) == 20_000
            want = df.join(table, "key", "left").select(*df.columns, "value")
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
            for how in ("left_semi", "left_anti"):
                assert spread_join(df, table.select("key"), "key", how).count() == df.join(table, "key", how).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_quantiles_of_many_columns_in_few_scans(spark, monkeypatch):
    import math
    import random

    from txnrisk.operators import quantiles as Q

    rng = random.Random(4)
    columns = {
        "gauss": [rng.gauss(0, 1) for _ in range(3000)],
        "ties": [rng.choice([0.0, 0.0, 0.0, 1.0, -0.5]) for _ in range(3000)],
        "scales": [math.exp(rng.uniform(-600, 600)) * rng.choice([-1, 1]) for _ in range(3000)],
        "huge": [rng.choice([-1.7e308, 1.7e308, 5e-324, 1e-323, 0.0]) for _ in range(3000)],
        "same": [7.0] * 3000,
        "gaps": [None if rng.random() < 0.5 else rng.random() for _ in range(3000)],
        "none": [None] * 3000,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    scans = []
    real = Q._bucket_counts
    monkeypatch.setattr(Q, "_bucket_counts", lambda *a: scans.append(1) or real(*a))
    probs = [0.0, 0.01, 0.25, 0.5, 0.7, 0.999, 1.0]
    got = Q.column_quantiles(df, list(columns), probs)
    few = len(scans)
    for c, values in columns.items():
        kept = sorted(v for v in values if v is not None)
        if not kept:
            assert got[c] == [None] * len(probs)
            continue
        for p, v in zip(probs, got[c], strict=True):
            at = p * (len(kept) - 1)
            low, high = kept[int(at)], kept[min(int(at) + 1, len(kept) - 1)]
            want = low if at == int(at) or low == high else low + (high - low) * (at - int(at))
            assert v == want, (c, p)
    scans.clear()
    Q.column_quantiles(df, ["scales"], probs)
    assert few <= len(scans) + 1 <= 9  # the hardest column alone takes as many
    odd = spark.createDataFrame([(v,) for v in [float("nan"), float("inf"), float("-inf"), 1.0, 2.0]], "x double")
    got = Q.exact_quantiles(odd, "x", [0.0, 0.25, 0.5, 0.75, 1.0])
    assert got[:4] == [float("-inf"), 1.0, 2.0, float("inf")] and math.isnan(got[4])
