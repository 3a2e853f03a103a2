import random

import pytest
from pyspark.sql import functions as F

from conftest import SCHEMA, in_order, make_rows
from txnrisk.operators import features, priors
from txnrisk.operators.asof import TxnLog
from txnrisk.settings import MODEL_FEATURES
from txnrisk.streaming import holding
from txnrisk.streaming import scoring as S
from txnrisk.streaming.features import FeatureStream, merged_summaries, summaries


def _comparable(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


def _write_batches(spark, folder, rows, cuts):
    """One parquet file for each micro-batch, written one after the other."""
    for lo, hi in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[lo:hi], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def rows():
    return in_order(make_rows(160, seed=11))


def _features(spark, rows):
    log = TxnLog.build(spark.createDataFrame(rows, SCHEMA))
    fitted = priors.fit_priors(log)
    return fitted, _comparable(features.point_in_time_features(log, fitted).select("transaction_id", *MODEL_FEATURES).collect())


@pytest.mark.parametrize("limits", [{}, {"heavy_limit": 15, "compact_every": 2}])
def test_stream_equals_batch_over_micro_batches(spark, rows, tmp_path, limits):
    """Several runs of one checkpoint, history before them; also with keys split over blocks and lines drawn together."""
    fitted, want = _features(spark, rows)
    history = spark.createDataFrame(rows[:60], SCHEMA)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lo, hi in ((60, 100), (100, 101), (101, 160)):
        _write_batches(spark, source, rows, [lo, hi])
        stream = S.read_stream(spark, source, SCHEMA, files_per_batch=100, glob="*")
        target = FeatureStream(out, fitted, history, **limits)  # a new process knows only what is written
        S.start_batches(stream, target, str(tmp_path / "checkpoint"), available_only=True).awaitTermination()
    got = _comparable(spark.read.parquet(f"{out}/features").select("transaction_id", *MODEL_FEATURES).collect())
    kept = {r[0] for r in rows[60:]}
    assert got == [r for r in want if r[0] in kept]


def test_a_repeated_batch_overwrites_its_own_output(spark, rows, tmp_path):
    fitted, want = _features(spark, rows)
    target = FeatureStream(str(tmp_path), fitted)
    parts = [spark.createDataFrame(rows[lo:hi], SCHEMA) for lo, hi in ((0, 80), (80, 160))]
    for batch in (0, 1, 1):
        target(parts[batch], batch)
    target(parts[0].limit(0), 2)
    got = spark.read.parquet(f"{tmp_path}/features").select("transaction_id", *MODEL_FEATURES)
    assert _comparable(got.collect()) == want
    lines = spark.read.parquet(f"{tmp_path}/summary").filter("key_name = 'customer_id' and key_value = 'C0'")
    assert lines.agg(F.max("n")).first()[0] == sum(r[2] == "C0" for r in rows)


def test_summaries_merge_exactly(spark):
    rows = [(f"T{i}", i, f"C{i % 3}", "M", "D", float(i % 7 + 1), 0, 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = merged_summaries(summaries(df.limit(0)), summaries(df.filter("ts_sec < 9")))
    got = merged_summaries(got, summaries(df.filter("ts_sec >= 9"))).orderBy("key_name", "key_value").collect()
    want = summaries(df).orderBy("key_name", "key_value").collect()
    for a, b in zip(got, want, strict=True):
        assert (a.key_name, a.key_value, a.n, a.last) == (b.key_name, b.key_value, b.n, b.last)
        assert [a.mean, a.m2, a.total] == pytest.approx([b.mean, b.m2, b.total], rel=1e-12)


def test_held_rows_come_in_order_and_late_ones_aside(spark, rows, tmp_path):
    """Arrivals out of order give the features of the history; what comes after its slot has gone is put aside."""
    fitted, _ = _features(spark, rows)
    shuffled = sorted(rows, key=lambda r: r[1] + random.Random(r[0]).randrange(7000))
    late = [(f"L{i}", rows[i][1], *rows[i][2:]) for i in (0, 3)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    beat = [(None, rows[-1][1] + 10**6, None, None, None, None, None, None)]
    for part in (shuffled[:90], shuffled[90:], late, beat):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = holding.held(S.read_stream(spark, source, SCHEMA, files_per_batch=100, glob="*"), 7200, slot=600, parts=3)
        S.start_batches(stream, FeatureStream(out, fitted), str(tmp_path / "checkpoint"), available_only=True).awaitTermination()
    aside = spark.read.parquet(f"{out}/late").collect()
    assert {r.transaction_id for r in aside} == {"L0", "L3"}
    assert {r.ts_sec for r in aside} == {rows[0][1], rows[3][1]}
    log = TxnLog.build(spark.createDataFrame(rows, SCHEMA))
    want = features.point_in_time_features(log, fitted).select("transaction_id", *MODEL_FEATURES)
    got = spark.read.parquet(f"{out}/features").select("transaction_id", *MODEL_FEATURES)
    assert _comparable(got.collect()) == _comparable(want.collect())


def test_held_rows_keep_nulls_and_wait_for_the_watermark(spark, tmp_path):
    schema = "transaction_id string, ts_sec bigint, amount double, flag boolean, code int, note string"
    source, seen = str(tmp_path / "in"), []
    parts = [
        [("a", 1000, None, True, None, "x"), ("b", 1001, 1.5, None, 7, None)],
        [("c", 9000, 2.0, False, 1, "y")],
        [(None, 10**6, None, None, None, None)],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = holding.held(S.read_stream(spark, source, schema, glob="*"), 3600)
        target = lambda df, batch: seen.append([tuple(r) for r in df.orderBy("transaction_id").collect()])
        S.start_batches(stream, target, str(tmp_path / "checkpoint"), available_only=True).awaitTermination()
    rows = [r for batch in seen for r in batch]
    assert rows == [(*r, False) for r in parts[0] + parts[1]]
    assert seen[0] == []


def test_daily_alert_counts(spark, tmp_path):
    rows = [(86_400 * d + 5, s) for d, s in [(10, "alert"), (10, "alert"), (10, "log"), (11, "alert"), (13, "alert")]]
    source = str(tmp_path / "in")
    rows.append((86_400 * 20, None))  # a heartbeat lets the last day out
    spark.createDataFrame(rows, "ts_sec bigint, budget_status string").coalesce(1).write.parquet(source)
    stream = S.read_stream(spark, source, "ts_sec bigint, budget_status string")
    out = str(tmp_path / "out")
    S.start(S.daily_alert_stream(stream, "0 seconds"), out, str(tmp_path / "cp"), available_only=True).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("day", "alerts").collect()) == [(10, 2), (11, 1), (13, 1)]


def test_a_check_stream_has_several_micro_batches_in_time_order(spark, tmp_path):
    from checks import inputs

    rows = spark.range(400).select(
        F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("transaction_id"), (F.col("id") * 7).alias("ts_sec")
    )
    spans = []

    def note(part, batch):
        spans.append(part.agg(F.min("ts_sec"), F.max("ts_sec"), F.count("*")).first())

    job = inputs.stream_of(spark, rows).writeStream.foreachBatch(note).option("checkpointLocation", f"{tmp_path}/c")
    job.trigger(availableNow=True).start().awaitTermination()
    assert len(spans) > 1 and sum(s[2] for s in spans) == 400
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
