"""One registered query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from txnrisk.functions import columns as C
from txnrisk.operators import (
    asof, density, attribution, budget, canonical, decide, describe, features, metrics, models, novelty, priors, quality,
    reasons, splits,
)
from txnrisk.operators.ordering import blockwise, ordered_table
from txnrisk.plans import evaluation, scoring
from txnrisk.settings import CATEGORICAL_SUMMARY, DEFAULTS, LABEL, MODEL_FEATURES, REQUIRED
from txnrisk.sources import adapters, artifacts, readers, tables, writers
from txnrisk.sources.scratch import materialise
from txnrisk.streaming import scoring as streams
from txnrisk.streaming.budget import StreamingBudget
from txnrisk.streaming.features import DecisionStream, FeatureStream
from txnrisk.streaming.holding import held

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ================================================================== cleaning
@query
def canonical_events(spark, d):
    return tables.event_transactions(spark, d)


@query
def canonical_lines_dedup(spark, d):
    return tables.line_transactions(spark, d)


@query
def canonical_raw(spark, d):
    out = canonical.canonicalise(I.raw_events(spark, d), keep_first_by=["line_no"])
    return rounded(out.drop("timestamp", "line_no"))


@query
def amount_repair(spark, d):
    raw = I.raw_events(spark, d)
    amount = C.repaired_amount(F.col("AMT"))
    return raw.select("line_no", F.round(amount, 2).alias("amount")).filter(F.col("amount").isNotNull())


@query
def timestamp_parse(spark, d):
    raw = I.raw_events(spark, d).select("line_no", C.parsed_epoch(F.col("Event_Time")).alias("ts_sec"))
    return raw.filter(F.col("ts_sec").isNotNull())


@query
def load_meta(spark, d):
    raw = I.raw_events(spark, d)
    return canonical.load_metadata(raw.withColumn("_arrival", F.struct("line_no")))


@query
def row_validation(spark, d):
    rows = canonical.coerced(canonical.renamed(I.raw_events(spark, d), canonical.map_schema(I.raw_events(spark, d).columns)))
    checked = canonical.validated(rows)
    return checked.groupBy(F.array_join("errors", "|").alias("errors"), "valid").agg(F.count(F.lit(1)).alias("rows"))


@query
def invalid_rows_routed(spark, d):
    raw = I.raw_events(spark, d)
    rows = canonical.coerced(canonical.renamed(raw, canonical.map_schema(raw.columns)))
    _, rejected = canonical.split_valid(rows)
    return rejected.select(
        "line_no", "risk_band", "alert", "budget_status", "fraud_probability", F.array_join("errors", "|").alias("errors")
    )


@query
def timestamp_formats(spark, d):
    """Times in several spellings; the column tells that the day comes first."""
    raw = I.dated_events(spark, d)
    order = canonical.date_order(raw)
    found = raw.select("line_no", C.parsed_epoch(F.col("timestamp"), order).alias("ts_sec"), F.lit(order).alias("date_order"))
    return found.filter(F.col("ts_sec").isNotNull())


@query
def header_mapping(spark, d):
    return canonical.header_mapping(I.raw_events(spark, d))


@query
def required_columns(spark, d):
    """Loads without one of the required columns are refused, whatever their rows."""
    raw = I.raw_events(spark, d)
    headers = canonical.map_schema(raw.columns).mapping
    refused = []
    for name in [*REQUIRED, LABEL]:
        try:
            canonical.canonicalise(raw.drop(headers[name]))
        except ValueError as e:
            refused.append((name, name in str(e)))
    table = spark.createDataFrame(refused, "column string, named boolean")
    rows = raw.agg(F.count(F.lit(1)).alias("rows_refused"), F.lit(True).alias("named"))
    return table.join(F.broadcast(rows), "named").select("column", "rows_refused")


@query
def unlabelled_load(spark, d):
    """A file without labels: every row counts as legitimate."""
    raw = I.raw_events(spark, d).drop("isFraud")
    rows = canonical.canonicalise(raw, require_label=False, keep_first_by=["line_no"])
    return rows.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("rows"))


@query
def amount_filter(spark, d):
    rows = canonical.with_amount(canonical.canonicalise(I.raw_events(spark, d), keep_first_by=["line_no"]))
    return rows.select("transaction_id", F.round("amount", 2).alias("amount"))


@query
def request_constraints(spark, d):
    """Single requests must keep the range of hours as well."""
    raw = I.raw_events(spark, d)
    rows = canonical.coerced(canonical.renamed(raw, canonical.map_schema(raw.columns)))
    rows = rows.withColumn("transaction_hour", (F.col("line_no") % 30 - 3).cast("int"))
    checked = canonical.validated(rows, request=True)
    return checked.groupBy(F.array_join("errors", "|").alias("errors"), "valid").agg(F.count(F.lit(1)).alias("rows"))


def _fixed_decisions(spark, d):
    fitted = I.prepared(spark, d).priors

    def score(log):
        rows = features.point_in_time_features(log, fitted)
        rows = rows.withColumns({"p": reasons.logistic(reasons.linear_margin(I.WEIGHTS, I.INTERCEPT)), "novelty": F.lit(0.0)})
        return decide.unbudgeted_status(decide.with_decision(rows, DEFAULTS.thresholds))

    return score


@query
def file_decisions(spark, d):
    """One answer for every row of a raw file, in its order: scored rows and rejected ones with their errors."""
    found, _ = scoring.file_decisions(I.raw_events(spark, d), _fixed_decisions(spark, d), "line_no", require_label=True)
    return found.select(
        "line_no", "transaction_id", F.array_join("errors", "|").alias("errors"), (F.col("risk_band") == "invalid").alias("rejected"),
        F.col("fraud_probability").isNotNull().alias("scored"), (F.col("alert") == (F.col("budget_status") == "alert")).alias("consistent"),
    )


@query
def load_report(spark, d):
    """Figures observed while the rows of a file are scored, and how many headers were found."""
    found, report = scoring.file_decisions(I.raw_events(spark, d), _fixed_decisions(spark, d), "line_no", require_label=True)
    answered = found.agg(F.count(F.lit(1)).alias("answers"))
    counts = report.counts
    return answered.select(
        "answers", *[F.lit(counts[c]).cast("bigint").alias(c) for c in ("rows", "unparseable_timestamps", "without_amount")],
        F.lit(len(report.mapping.mapping)).cast("bigint").alias("mapped"), F.lit(len(report.mapping.unmapped)).cast("bigint").alias("unmapped"),
    )


@query
def foreign_adapter(spark, d):
    out = adapters.adapt_payments(*_payment_tables(spark, d))
    return out.select(
        "transaction_id", C.epoch_seconds(F.col("timestamp")).alias("ts_sec"), "amount", "customer_id",
        "merchant_id", "device_id", "transaction_hour", "is_fraud",
    )


@query
def foreign_adapter_summary(spark, d):
    return adapters.adapter_summary(adapters.adapt_payments(*_payment_tables(spark, d)))


def _payment_tables(spark, d):
    """Orders as payments, customers as the sparse identity table."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    payments = o.select(
        F.col("o_orderkey").alias("TransactionID"),
        (F.col("o_orderstatus") == "F").cast("int").alias("isFraud"),
        (C.epoch_seconds(F.col("o_orderdate")) - 694_224_000 + F.col("o_orderkey") % 86_400).alias("TransactionDT"),
        F.col("o_totalprice").alias("TransactionAmt"),
        F.col("o_orderpriority").alias("ProductCD"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("card1"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 25).alias("addr1"),
    )
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment", "c_nationkey")
    identity = o.filter(F.col("o_totalprice") > 200_000).join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("TransactionID"),
        F.when(F.col("c_nationkey") < 15, F.col("c_mktsegment")).alias("DeviceType"),
        F.when(F.col("c_nationkey") % 3 != 0, F.concat(F.lit("N"), "c_nationkey")).alias("DeviceInfo"),
    )
    return payments, identity


@query
def file_preview(spark, d):
    return canonical.file_preview(tables.event_transactions(spark, d), labelled=True)


@query
def preview_rows(spark, d):
    return canonical.preview_rows(tables.event_transactions(spark, d).select("transaction_id", "ts_sec", "amount"))


@query
def request_order(spark, d):
    """Rows scored in time order, returned in the order of their request number."""
    rows = features.point_in_time_features(I.events_log(spark, d))
    index = F.xxhash64("transaction_id")  # stands for the place in the request
    answers = rows.select("transaction_id", "customer_history_count", "txn_count_24h", index.alias("i"))
    return canonical.in_request_order(answers, "i").drop("i")


@query
def source_row_cap(spark, d):
    n = 1_000
    return readers.first_rows(I.events_log(spark, d).rows, n).select("transaction_id", "ts_sec")


@query
def pruned_scan(spark, d):
    cols = ["event_id", "value"]
    return rounded(readers.read_parquet(spark, f"{d}/events.parquet", cols).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("total")), 4)


# ================================================================== quality
def _quality_input(spark, d):
    return canonical.coerced(
        canonical.renamed(I.raw_events(spark, d), canonical.map_schema(I.raw_events(spark, d).columns))
    )


@query
def dq_shape(spark, d):
    return quality.table_shape(_quality_input(spark, d).drop("timestamp"))


@query
def dq_nulls(spark, d):
    return quality.null_counts(_quality_input(spark, d))


@query
def class_distribution(spark, d):
    return quality.class_distribution(tables.event_transactions(spark, d))


@query
def dq_describe(spark, d):
    return quality.describe_numeric(I.events_log(spark, d).rows)


@query
def dq_describe_lines(spark, d):
    return quality.describe_numeric(I.lines_log(spark, d).rows, ["amount"])


@query
def dq_categories(spark, d):
    return quality.category_counts(features.supplied_columns(I.events_log(spark, d)), CATEGORICAL_SUMMARY)


@query
def dq_time_range(spark, d):
    return quality.time_range(tables.line_transactions(spark, d))


@query
def dq_entities(spark, d):
    return quality.entity_counts(tables.line_transactions(spark, d))


# ================================================================== splits
@query
def time_split(spark, d):
    return splits.time_split(I.events_log(spark, d)).select("transaction_id", "row_index", "fold")


@query
def time_split_lines(spark, d):
    folds = splits.time_split(I.lines_log(spark, d))
    return folds.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.min("transaction_id").alias("first_id"),
        F.min("ts_sec").alias("first_ts"), F.max("ts_sec").alias("last_ts"),
    )


@query
def holdout_customers(spark, d):
    return splits.holdout_customers(I.lines_log(spark, d).rows)


@query
def holdout_anti(spark, d):
    return I.prepared(spark, d).log.rows.select("transaction_id", "fold")


@query
def id_set_members(spark, d):
    p = I.prepared(spark, d)
    inside = splits.members(p.log.rows, p.holdout, "customer_id", True).groupBy("fold").agg(F.count(F.lit(1)).alias("held_out"))
    outside = splits.members(p.log.rows, p.holdout, "customer_id", False).groupBy("fold").agg(F.count(F.lit(1)).alias("others"))
    return outside.join(inside, "fold", "left").select("fold", F.coalesce("held_out", F.lit(0)).alias("held_out"), "others")


@query
def fold_union(spark, d):
    rows = I.prepared(spark, d).log.rows.select("transaction_id", "fold", "amount")
    parts = [rows.filter(F.col("fold") == f) for f in ("train", "val", "test")]
    return splits.union_folds(*parts)


@query
def first_time_flags(spark, d):
    rows = splits.first_time_flags(I.fitted_features(spark, d))
    return rows.select("transaction_id", "first_time_customer", "first_time_device", "first_time_merchant", "first_time_any")


@query
def strata_tiers(spark, d):
    log = I.lines_log(spark, d)
    rows = asof.history(log, log.rows, "customer_id", {"n_c": ("count", None), "first_c": ("min", F.col("ts_sec"))})
    rows = asof.history(log, rows, "merchant_id", {"n_m": ("count", None)})
    days = F.coalesce((F.col("ts_sec") - F.col("first_c")) / 86_400.0, F.lit(0.0))
    return rows.groupBy(
        C.stratum(F.col("n_c")).alias("stratum"), C.stratum_with_tenure(F.col("n_c"), days).alias("with_tenure"),
        C.merchant_tier(F.col("n_m")).alias("tier"),
    ).agg(F.count(F.lit(1)).alias("rows"))


@query
def half_split(spark, d):
    rows = I.events_log(spark, d).rows
    return splits.half_split(rows, "transaction_id").select("transaction_id", "half")


@query
def seeded_sample(spark, d):
    return splits.sample_rows(I.events_log(spark, d).rows, "transaction_id", 500).select("transaction_id")


@query
def asof_cut(spark, d):
    """History before the most suspicious test row that is a fraud."""
    pool = I.decided(spark, d).filter((F.col("is_fraud") == 1) & F.col("alert"))
    row = splits.extreme_row(pool, "rank_score", highest=True).first()
    at = row.ts_sec if row else 0
    return splits.before_moment(I.events_log(spark, d).rows, at).groupBy("customer_id").agg(F.count(F.lit(1)).alias("rows"))


@query
def extreme_pick(spark, d):
    rows = I.decided(spark, d)
    calm = splits.extreme_row(rows.filter((F.col("is_fraud") == 0) & (F.col("risk_band") == "normal")), "rank_score", False)
    worst = splits.extreme_row(rows.filter((F.col("is_fraud") == 1) & F.col("alert")), "rank_score", True)
    keep = ["transaction_id", "risk_band", "rank_score"]
    return calm.select(F.lit("normal").alias("example"), *keep).unionByName(
        worst.select(F.lit("suspicious").alias("example"), *keep)
    )


@query
def legit_subset(spark, d):
    return splits.legitimate(I.prepared(spark, d).log.rows).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))


# ================================================================== features
@query
def calendar_features(spark, d):
    rows = features.calendar_features(tables.event_transactions(spark, d))
    return rounded(rows.select("transaction_id", "amount_log", "transaction_hour", "day_of_week", "is_weekend", "is_night"))


def _history_counts(log):
    rows = features.entity_history(log, log.rows)
    flags = features._counts_and_flags(DEFAULTS.cold_kappa, DEFAULTS.baseline_min_n)
    names = [c for c in flags if c != "history_stratum"]
    counts = [f"{k}_history_count" for k in ("customer", "merchant", "device")]
    return rounded(rows.withColumns(flags).select("transaction_id", *counts, *names))


@query
def history_counts(spark, d):
    return _history_counts(I.events_log(spark, d))


@query
def history_counts_lines(spark, d):
    return _history_counts(I.lines_log(spark, d))


@query
def running_moments(spark, d):
    log = I.lines_log(spark, d)
    x = F.log1p("amount")
    rows = asof.history(log, log.rows, "customer_id", {"mean_c": ("mean", x), "sd_c": ("sd", x)})
    rows = asof.history(log, rows, "merchant_id", {"mean_m": ("mean", x), "sd_m": ("sd", x)})
    return rounded(rows.select("transaction_id", "mean_c", "sd_c", "mean_m", "sd_m"), 5)


def _activity(log, *names):
    return asof.customer_activity(log, log.rows).select("transaction_id", *names)


@query
def velocity(spark, d):
    return _activity(I.events_log(spark, d), "txn_count_5m", "txn_count_30m", "txn_count_24h")


@query
def velocity_lines(spark, d):
    return _activity(I.lines_log(spark, d), "txn_count_5m", "txn_count_30m", "txn_count_24h")


@query
def distinct_24h(spark, d):
    return _activity(I.events_log(spark, d), "distinct_merchants_24h", "distinct_devices_24h")


@query
def distinct_24h_lines(spark, d):
    return _activity(I.lines_log(spark, d), "distinct_merchants_24h", "distinct_devices_24h")


@query
def amount_sum_24h(spark, d):
    return rounded(_activity(I.events_log(spark, d), "amount_sum_24h"), 4)


@query
def amount_sum_24h_lines(spark, d):
    return rounded(_activity(I.lines_log(spark, d), "amount_sum_24h"), 4)


@query
def hot_key_state(spark, d):
    """Entity state with the limits of one task set so low that most customers, merchants
    and devices take the path for keys that do not fit one task."""
    log = asof.TxnLog.build(tables.line_transactions(spark, d), heavy_limit=20, blocks=6)
    rows = features.entity_history(log, log.rows)
    return rounded(rows.select(
        "transaction_id", "customer_history_count", "merchant_history_count", "device_history_count", "txn_count_5m",
        "txn_count_30m", "txn_count_24h", "distinct_merchants_24h", "distinct_devices_24h", "amount_sum_24h",
        F.col("_mu_c").alias("mean_c"), F.col("_sd_c").alias("sd_c"), F.col("_mu_m").alias("mean_m"), F.col("_last_d").alias("last_d"),
    ), 4)


@query
def hot_key_agreement(spark, d):
    """Largest relative difference of the unrounded state between the two paths, as a verdict per column."""
    lines = tables.line_transactions(spark, d)
    columns = ["_mu_c", "_sd_c", "_mu_m", "_sd_m"]
    plain, sliced = (
        features.entity_history(log, log.rows).select("transaction_id", *columns)
        for log in (asof.TxnLog.build(lines), asof.TxnLog.build(lines, heavy_limit=20, blocks=6))
    )
    both = plain.alias("a").join(sliced.alias("b"), "transaction_id")

    def apart(c):
        a, b = (F.coalesce(F.col(f"{side}.{c}"), F.lit(0.0)) for side in "ab")
        return F.max(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-6)))

    worst = both.agg(F.count(F.lit(1)).alias("n"), *[apart(c).alias(c) for c in columns])
    return worst.selectExpr("n", "stack(4, '_mu_c', _mu_c, '_sd_c', _sd_c, '_mu_m', _mu_m, '_sd_m', _sd_m) AS (name, apart)").select(
        "n", "name", (F.col("apart") < 1e-9).alias("agrees")
    )


@query
def time_since(spark, d):
    rows = I.fitted_features(spark, d)
    return rounded(rows.select("transaction_id", "time_since_customer_txn_log", "time_since_device_txn_log"))


@query
def running_global(spark, d):
    log = I.lines_log(spark, d)
    rows = asof.running_global(log, log.rows)
    # the amounts are exact decimals, so their mean is the same double everywhere
    return rows.select("transaction_id", "running_mean_amount", F.round("running_mean_log", 4).alias("running_mean_log"))


@query
def asof_supplied(spark, d):
    return features.supplied_columns(I.events_log(spark, d)).select(
        "transaction_id", "new_customer", "new_merchant", "new_device", "velocity_8min", "amount_spike",
        "customer_history_count", "merchant_history_count", "device_history_count",
    )


@query
def asof_supplied_lines(spark, d):
    return features.supplied_columns(I.lines_log(spark, d)).select(
        "transaction_id", "new_customer", "new_merchant", "new_device", "velocity_8min", "amount_spike",
        "customer_history_count", "merchant_history_count", "device_history_count",
    )


@query
def parity_rates(spark, d):
    """Supplied columns of the whole stream against those recomputed without the
    held-out training rows."""
    p = I.prepared(spark, d)
    supplied = features.supplied_columns(I.events_log(spark, d)).select("transaction_id", "velocity_8min", "amount_spike")
    log = p.log.over_rows(p.log.rows.join(supplied, "transaction_id"))
    return features.parity_rates(features.point_in_time_features(log, p.priors, parity=True))


@query
def feature_availability(spark, d):
    return features.feature_availability(I.fitted_features(spark, d))


@query
def amount_bucket(spark, d):
    return I.fitted_features(spark, d).groupBy("amount_bucket").agg(F.count(F.lit(1)).alias("rows"))


@query
def shrunk_z(spark, d):
    return rounded(I.fitted_features(spark, d).select(
        "transaction_id", "history_stratum", "customer_history_conf", "customer_amount_baseline",
        "segment_amount_baseline", "segment_risk_prior", "amount_z_shrunk", "customer_amount_z",
        "merchant_amount_z", "customer_avg_amount_log", "merchant_avg_amount_log"), 5)


@query
def feature_core(spark, d):
    rows = features.point_in_time_features(I.events_log(spark, d))
    return rounded(rows.select(
        "transaction_id", "ts_sec", "amount_log", "customer_history_count", "merchant_history_count",
        "device_history_count", "txn_count_5m", "txn_count_30m", "txn_count_24h", "distinct_merchants_24h",
        "distinct_devices_24h", "amount_sum_24h_log", "time_since_customer_txn_log", "time_since_device_txn_log",
    ), 5)


@query
def feature_full(spark, d):
    rows = I.fitted_features(spark, d).drop("seq")
    return rounded(features.numeric_fill(rows, ["amount_z_shrunk", "customer_amount_z"]), 5)


@query
def feature_vector(spark, d):
    """All 40 model inputs as one array in model order, summed per position."""
    rows = models.assembled(I.fitted_features(spark, d)).select(F.posexplode(vector_to_array("features")))
    return rounded(rows.groupBy("pos").agg(F.sum("col").alias("total")), 2)


# ================================================================== priors
@query
def segment_priors_cube(spark, d):
    train = I.prepared(spark, d).log.where(F.col("fold") == "train")
    return rounded(priors.segment_cube(priors.with_strata(train)))


@query
def global_prior(spark, d):
    return rounded(priors.global_prior(I.prepared(spark, d).log.rows.filter(F.col("fold") == "train")))


@query
def segment_lookup(spark, d):
    return rounded(I.prepared(spark, d).priors.table(spark))


@query
def amount_octiles(spark, d):
    edges = priors.amount_octiles(I.prepared(spark, d).log.rows.filter(F.col("fold") == "train"))
    return rounded(spark.createDataFrame(list(enumerate(edges, 1)), "octile int, edge double"))


# ================================================================== decisions
@query
def class_weights(spark, d):
    return rounded(models.class_weights(I.prepared(spark, d).log.rows.filter(F.col("fold") == "train")))


@query
def thresholds_quantile(spark, d):
    return decide.thresholds_table(spark, I.thresholds(spark, d))


@query
def fixed_scores(spark, d):
    return rounded(I.scored(spark, d).select("transaction_id", "fold", "p"))


@query
def ecdf_reference(spark, d):
    rows = I.with_deviation(I.fitted_features(spark, d)).filter((F.col("fold") == "val") & (F.col("is_fraud") == 0))
    return rounded(novelty.ecdf_table(rows.withColumn("deviation", F.round("deviation", 1)), "deviation"), 1)


@query
def ecdf_novelty(spark, d):
    return rounded(I.scored(spark, d).select("transaction_id", "novelty"))


@query
def risk_bands(spark, d):
    return I.decided(spark, d).select(
        "transaction_id", "fraud_probability", "novelty_score", "risk_band", "alert", "rank_score", "budget_status"
    )


@query
def risk_tags(spark, d):
    return I.decided(spark, d).select("transaction_id", F.array_join("tags", ",").alias("tags"))


@query
def rebudget(spark, d):
    rows = decide.rebudgeted(I.decided(spark, d), 3.0)
    return rounded(rows.select("transaction_id", "risk_band", "alert", "budget_status", "rank_score"))


@query
def alert_topk(spark, d):
    top = decide.top_alerts(I.decided(spark, d), 25)
    return top.select("transaction_id", "fraud_probability", "novelty_score", "risk_band", "rank_score")


@query
def alert_list(spark, d):
    return decide.top_alerts(I.decided(spark, d)).select("transaction_id", "risk_band", "rank_score")


@query
def budget_volume(spark, d):
    return budget.with_volume(I.decided(spark, d)).select("transaction_id", "day", "day_volume", "budget_cap", "high_cap")


@query
def alert_budget(spark, d):
    return I.budgeted(spark, d).select("transaction_id", "risk_band", "budget_status")


@query
def alert_budget_counters(spark, d):
    return budget.budget_counters(I.budgeted(spark, d))


# ================================================================== reasons
def _with_linear_contributions(spark, d):
    rows = I.fitted_features(spark, d)
    means = reasons.feature_means(rows.filter(F.col("fold") == "train"), MODEL_FEATURES)
    test = rows.filter(F.col("fold") == "test")
    return test.withColumn("contributions", reasons.linear_contributions(I.ALL_WEIGHTS, means))


@query
def linear_contrib(spark, d):
    rows = _with_linear_contributions(spark, d)
    at = {f: F.element_at("contributions", MODEL_FEATURES.index(f) + 1).alias(f) for f in I.WEIGHTS}
    return rounded(rows.select("transaction_id", *at.values()), 5)


@query
def linear_importance(spark, d):
    return rounded(reasons.global_importance(_with_linear_contributions(spark, d), MODEL_FEATURES))


@query
def reason_groups(spark, d):
    rows = reasons.with_reasons(_with_linear_contributions(spark, d))
    flat = reasons.one_row_each(rows, "transaction_id")
    return flat.select("transaction_id", "place", "r.feature", "r.effect", "r.contribution")


@query
def reason_text(spark, d):
    rows = reasons.with_reasons(_with_linear_contributions(spark, d))
    return rows.select(
        "transaction_id", "explanation",
        F.size("positive_contributors").alias("n_positive"), F.size("negative_contributors").alias("n_negative"),
    )


@query
def reasons_ungrouped(spark, d):
    rows = reasons.with_reasons(_with_linear_contributions(spark, d), grouped=False, k=3)
    return rows.select("transaction_id", F.array_join(F.transform("top_contributing_features", lambda r: r["feature"]), ",").alias("top"))


# ================================================================== metrics
def _flagged(spark, d):
    return metrics.cohort_flags(I.decided(spark, d), I.train_customers(spark, d), I.fitted_features(spark, d))


@query
def cohort_flags(spark, d):
    return _flagged(spark, d).select(
        "transaction_id", "unseen_customer", "known_customer", "first_time_customer", "first_time_device",
        "first_time_merchant", "first_time_any",
    )


@query
def avg_precision(spark, d):
    return rounded(metrics.ranking_metrics(I.decided(spark, d), "fraud_probability").select("pr_auc"))


@query
def roc_auc(spark, d):
    p = metrics.ranking_metrics(I.decided(spark, d), "fraud_probability").select(F.lit("probability").alias("score"), "roc_auc")
    n = metrics.ranking_metrics(I.decided(spark, d), "novelty_score").select(F.lit("novelty").alias("score"), "roc_auc")
    return rounded(p.unionByName(n))


@query
def pr_curve(spark, d):
    return rounded(metrics.pr_curve(I.decided(spark, d)))


@query
def confusion(spark, d):
    return metrics.confusion(I.decided(spark, d), F.col("alert"))


@query
def recall_at_budget(spark, d):
    return rounded(metrics.grid_at_budget(I.decided(spark, d)))


@query
def brier(spark, d):
    return rounded(I.decided(spark, d).agg(metrics.brier().alias("brier")))


@query
def ece(spark, d):
    return metrics.calibration_error(I.decided(spark, d))


@query
def reliability(spark, d):
    return rounded(metrics.reliability_curve(I.decided(spark, d)))


@query
def reliability_summary(spark, d):
    return metrics.reliability_summary(I.decided(spark, d))


@query
def cohort_report(spark, d):
    return metrics.cohort_report(_flagged(spark, d))


@query
def alert_metrics(spark, d):
    return metrics.alert_metrics(I.decided(spark, d))


@query
def first_time_fp(spark, d):
    return metrics.first_time_false_positives(_flagged(spark, d))


@query
def seen_unseen_split(spark, d):
    return metrics.seen_unseen_split(_flagged(spark, d))


@query
def cohort_table(spark, d):
    rows = _flagged(spark, d)
    return metrics.cohort_table(metrics.cohort_report(rows), metrics.first_time_false_positives(rows))


@query
def leakage_audit(spark, d):
    """Features of the stream cut at its 60 % point against those of the whole stream."""
    log = I.events_log(spark, d)
    folds = splits.time_split(log)
    part = log.over_rows(folds.filter(F.col("fold") == "train").select(*log.rows.columns))
    p = I.prepared(spark, d).priors
    return metrics.leakage_audit(
        features.point_in_time_features(log, p), features.point_in_time_features(part, p), MODEL_FEATURES
    )


# ================================================================== describe
@query
def fraud_by_hour(spark, d):
    return describe.rate_by(tables.event_transactions(spark, d), "transaction_hour")


@query
def fraud_by_newness(spark, d):
    rows = features.supplied_columns(I.lines_log(spark, d))
    return describe.rate_by_newness(rows, ["new_customer", "new_device"])


@query
def log_amount_hist(spark, d):
    return describe.histogram_by_class(tables.line_transactions(spark, d), F.log1p("amount"), 60)


@query
def score_hist(spark, d):
    rows = I.decided(spark, d)
    p = describe.histogram_by_class(rows, F.col("fraud_probability"), 40).withColumn("score", F.lit("probability"))
    n = describe.histogram_by_class(rows, F.col("novelty_score"), 40).withColumn("score", F.lit("novelty"))
    return p.unionByName(n)


@query
def prob_novelty_grid(spark, d):
    return describe.probability_novelty_grid(I.decided(spark, d))


@query
def band_counts(spark, d):
    return describe.band_counts(I.decided(spark, d))


@query
def daily_alerts(spark, d):
    return metrics.daily_alerts(I.decided(spark, d))


@query
def cold_vs_established(spark, d):
    return describe.cold_vs_established(I.fitted_features(spark, d))


@query
def novelty_summary(spark, d):
    return describe.novelty_summary(I.decided(spark, d))


@query
def file_report(spark, d):
    return describe.file_report(I.decided(spark, d))


@query
def tag_top3(spark, d):
    return describe.top_tags(I.decided(spark, d))


@query
def insight_facts(spark, d):
    return describe.insight_facts(_flagged(spark, d))


@query
def mean_amount(spark, d):
    return describe.mean_amount_by_class(tables.line_transactions(spark, d))


# ================================================================== fitted models
def _fold(spark, d, name):
    return I.fitted_features(spark, d).filter(F.col("fold") == name)


@query
def lr_scores(spark, d):
    model = models.fit_logistic(_fold(spark, d, "train"))
    return rounded(models.with_raw_probability(model, _fold(spark, d, "val")).select("transaction_id", "raw_probability"))


@query
def rf_scores(spark, d):
    rows = models.with_raw_probability(I.bagged(spark, d), _fold(spark, d, "val"))
    return rounded(rows.select("transaction_id", "raw_probability"))


@query
def lr_stationary(spark, d):
    """At the fitted coefficients the gradient of the penalised, weighted loss vanishes."""
    train = _fold(spark, d, "train")
    model = models.fit_logistic(train)
    fit = model.stages[-1]
    w = models.class_weights(train).first()
    rows = model.transform(train).select(
        F.when(F.col("is_fraud") == 1, w.balanced_pos).otherwise(w.balanced_neg).alias("w"), vector_to_array("scaled").alias("x"),
        (vector_to_array("probability")[1] - F.col("is_fraud")).alias("gap"),
    )
    n = len(MODEL_FEATURES)
    sums = rows.agg(F.sum("w"), F.sum(F.col("w") * F.col("gap")), *[F.sum(F.col("w") * F.col("gap") * F.col("x")[i]) for i in range(n)]).first()
    pull = [fit.getRegParam() * c for c in fit.coefficients.toArray()]
    gradient = [sums[1] / sums[0], *[sums[2 + i] / sums[0] + pull[i] for i in range(n)]]
    counted = train.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("rows", F.lit(len(gradient)).cast("bigint").alias("parameters"), F.lit(max(map(abs, gradient)) < 1e-4).alias("stationary"))


@query
def forest_contrib(spark, d):
    """Contributions of the forest and the bias add up to its probability: the difference of both, row by row."""
    model = I.bagged(spark, d)
    found = attribution.tree_attribution(spark, model.stages[-1])
    test = found.with_contributions(_fold(spark, d, "test"))
    total = F.aggregate("contributions", F.lit(found.bias), lambda a, b: a + b)
    rows = models.with_raw_probability(model, test)
    return rounded(rows.select("transaction_id", F.abs(total - F.col("raw_probability")).alias("difference")), 6)


@query
def isolation_walk(spark, d):
    """Anomaly scores of the rows whose number is divisible by 20 against a walk over the node table by joins."""
    forest = novelty.fit_isolation_forest(splits.legitimate(_fold(spark, d, "train")))
    val = _fold(spark, d, "val").filter(F.substring("transaction_id", 2, 10).cast("bigint") % 20 == 0)
    nodes = forest.table(spark).withColumnRenamed("tree", "t").withColumnRenamed("node", "at")
    n = F.col("size").cast("double")
    depth = F.when(n > 2, 2 * (F.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n).when(n == 2, 1.0).otherwise(0.0)
    table = F.broadcast(nodes.withColumn("expected", depth))  # trees x sample nodes at most
    x = F.array(*[F.nanvl(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in forest.features])
    walk = val.select("transaction_id", x.alias("x"), forest.deviation(spark).alias("score"))
    walk = walk.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(int(forest.nodes["tree"].max()))))).withColumn("node", F.lit(0))
    for _ in range(int(forest.nodes["depth"].max())):
        step = walk.join(table, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("at")))
        down = F.when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("low")).otherwise(F.col("high"))
        walk = step.select("transaction_id", "x", "score", "tree", F.when(F.col("feature") < 0, F.col("node")).otherwise(down).alias("node"))
    ends = walk.join(table, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("at")))
    roots = F.broadcast(nodes.withColumn("norm", depth).filter("at = 0").select(F.col("t").alias("r"), "norm"))
    share = (F.col("depth") + F.col("expected")) / F.col("norm")
    found = ends.join(roots, F.col("tree") == F.col("r")).groupBy("transaction_id").agg(F.avg(share).alias("share"), F.max("score").alias("score"))
    gap = F.abs(F.pow(F.lit(2.0), -F.col("share")) - 0.5 - F.col("score"))
    return found.select("transaction_id", (gap < 1e-9).alias("equal"))


def _raw_val(spark, d):
    """What a calibration reads of the validation rows, scored once."""
    rows = models.with_raw_probability(I.boosted(spark, d), _fold(spark, d, "val"))
    return materialise(rows.select("transaction_id", "is_fraud", "raw_probability"), "val")


@query
def calibration_checks(spark, d):
    """What both calibrations must keep on the half they are fitted on, and that the better one was chosen."""
    val = _raw_val(spark, d)
    halves = splits.half_split(val, "transaction_id", DEFAULTS.seed)
    fitting, held_out = halves.filter(F.col("half") == "fit"), halves.filter(F.col("half") == "eval")
    fits = {"platt": models.fit_platt(fitting), "isotonic": models.fit_isotonic(fitting)}
    facts, lost = {}, {}
    for name, fit in fits.items():
        p, y = fit.transform(fitting).agg(F.avg("p"), F.avg("is_fraud")).first()
        facts[f"{name}_keeps_mean"] = abs(p - y) < 1e-3
        lost[name] = fit.transform(held_out).agg(metrics.brier("p")).first()[0]
    ranked = ordered_table(fits["isotonic"].transform(val).select("raw_probability", "p"), "raw_probability")
    before = blockwise(ranked, [], {"highest": ("max", F.col("p"))})
    facts["isotonic_rises"] = before.filter(F.col("p") < F.col("highest") - 1e-12).isEmpty()
    facts["better_chosen"] = models.fit_calibrator(val).method == min(lost, key=lost.get)
    return val.agg(F.count(F.lit(1)).alias("rows")).select("rows", *[F.lit(v).alias(k) for k, v in facts.items()])


@query
def stream_fresh_state(spark, d):
    """A stream without history against the features of the same rows as a table: rows that differ."""
    log = I.events_log(spark, d)
    fitted = I.prepared(spark, d).priors
    target = FeatureStream(I.new_folder(spark, "features"), fitted)
    out = rounded(I.run_batches(spark, I.stream_of(spark, _canonical(log.rows)), target, "features"), 6)
    batch = rounded(features.point_in_time_features(log, fitted).select(*out.columns), 6)
    missing = batch.exceptAll(out).unionByName(out.exceptAll(batch))
    return missing.agg(F.count(F.lit(1)).alias("differing_rows"))


@query
def gbt_scores(spark, d):
    rows = models.with_raw_probability(I.boosted(spark, d), _fold(spark, d, "val"))
    return rounded(rows.select("transaction_id", "raw_probability"))


@query
def model_comparison(spark, d):
    return rounded(I.trained(spark, d).bundle.comparison)


@query
def calibrated(spark, d):
    val = _raw_val(spark, d)
    return rounded(models.fit_calibrator(val).transform(val).select("transaction_id", "raw_probability", "p"))


@query
def isolation_novelty(spark, d):
    forest = novelty.fit_isolation_forest(splits.legitimate(_fold(spark, d, "train")))
    val = _fold(spark, d, "val").withColumn("deviation", forest.deviation(spark))
    ecdf = novelty.fit_ecdf(splits.legitimate(val), "deviation")
    return rounded(novelty.ecdf_rank(val, "deviation", ecdf).select("transaction_id", "deviation", "novelty"))


@query
def novelty_variants(spark, d):
    legit = splits.legitimate(_fold(spark, d, "train"))
    forest = novelty.fit_isolation_forest(legit)
    val = I.local_density(spark, d).deviation(_fold(spark, d, "val"), name="density")
    val = val.withColumns(
        {"forest": forest.deviation(spark), "gaussian": novelty.gaussian_deviation(novelty.fit_gaussian(legit))}
    )
    variants = {"isolation_forest": "forest", "gaussian_distance": "gaussian", "local_density": "density"}
    return novelty.compare_variants(materialise(val, "variants"), variants, F.col("is_fraud") == 0)


@query
def local_density(spark, d):
    """How thin the legitimate training rows are around every test row, compared with their neighbours."""
    found = I.local_density(spark, d).deviation(_fold(spark, d, "test"))
    return found.select("transaction_id", F.round("deviation", 4).alias("deviation"))


@query
def density_recall(spark, d):
    """Neighbours found of the test rows whose number is divisible by 20, against all reference rows."""
    fit = I.local_density(spark, d)
    asked = _fold(spark, d, "test").filter(F.substring("transaction_id", 2, 10).cast("bigint") % 20 == 0)
    exact = density.exact_neighbours(density.points(asked, fit.features), fit.refs.filter("tree = 0"), fit.k)
    return density.recall(fit.found(asked), exact).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query
def gaussian_novelty(spark, d):
    """Distance of test rows from legitimate training rows, features independent."""
    fit = novelty.fit_gaussian(splits.legitimate(_fold(spark, d, "train")))
    return rounded(_fold(spark, d, "test").select("transaction_id", novelty.gaussian_deviation(fit).alias("deviation")), 4)


@query
def tree_contrib(spark, d):
    """Contributions of a boosted model and the bias add up to its log-odds margin: the
    difference of both, row by row."""
    model = I.boosted(spark, d)
    found = attribution.tree_attribution(spark, model.stages[-1])
    test = _fold(spark, d, "test").withColumn("contributions", found.contributions(spark))
    total = F.aggregate("contributions", F.lit(found.bias), lambda a, b: a + b)
    rows = models.with_raw_probability(model, test)
    p = F.col("raw_probability")
    return rounded(rows.select("transaction_id", F.abs(total - F.log(p / (1 - p))).alias("difference")), 6)


@query
def tree_importance(spark, d):
    found = attribution.tree_attribution(spark, I.boosted(spark, d).stages[-1])
    test = _fold(spark, d, "test")
    return rounded(reasons.global_importance(test.withColumn("contributions", found.contributions(spark)), MODEL_FEATURES))


@query
def permutation_influence(spark, d):
    return rounded(attribution.permutation_influence(I.boosted(spark, d), _fold(spark, d, "test")))


@query
def scored_test_fold(spark, d):
    rows = I.test_scores(spark, d)
    return rows.select("transaction_id", "fraud_probability", "novelty_score", "risk_band", "budget_status", "explanation")


@query
def evaluation_report(spark, d):
    t = I.trained(spark, d)
    known = t.fold("train").select("customer_id").distinct()
    tables_ = evaluation.evaluate(I.test_scores(spark, d).drop("fold"), known, t.fold("test"))
    return evaluation.as_report(tables_)


@query
def saved_bundle_scores(spark, d):
    """A bundle written and read again scores like the original: differing rows."""
    t = I.trained(spark, d)
    path = I.new_folder(spark, "bundle")
    artifacts.save_bundle(t.bundle, path, spark)
    again = scoring.score_features(artifacts.load_bundle(spark, path), t.fold("test"))
    first = scoring.score_features(t.bundle, t.fold("test"))
    keep = ["transaction_id", "fraud_probability", "novelty_score", "risk_band"]
    return again.select(*keep).exceptAll(first.select(*keep)).agg(F.count(F.lit(1)).alias("differing_rows"))


@query
def file_scored_alone(spark, d):
    """A file scored with a fitted bundle while its own rows are the only history."""
    log = I.lines_log(spark, d)
    return scoring.score_log(I.trained(spark, d).bundle, log).select("transaction_id", "risk_band", "budget_status")


# ================================================================== sinks
@query
def parquet_sink(spark, d):
    path = I.new_folder(spark, "features")
    writers.write_features(I.fitted_features(spark, d), path)
    return spark.read.parquet(path).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))


@query
def csv_sink(spark, d):
    path = I.new_folder(spark, "export")
    writers.write_csv(I.decided(spark, d), path)
    back = readers.read_csv_text(spark, path)
    return back.select("transaction_id", F.col("fraud_probability").cast("double").alias("fraud_probability"), "risk_band")


@query
def csv_round_trip(spark, d):
    """Canonical rows written as text and loaded again through the raw-file path."""
    path = I.new_folder(spark, "raw")
    rows = tables.event_transactions(spark, d)
    rows.withColumn("timestamp", C.utc_wall(F.col("ts_sec")).cast("string")).drop("ts_sec").write.option("header", True).csv(path)
    keep = ["transaction_id", "ts_sec", "customer_id", "merchant_id", "device_id", "amount", "transaction_hour", "is_fraud"]
    return readers.read_transactions(spark, path).select(*keep)


@query
def json_sink(spark, d):
    path = I.new_folder(spark, "json")
    writers.write_json(I.decided(spark, d).select("transaction_id", "risk_band", "tags"), path)
    back = spark.read.schema("transaction_id string, risk_band string, tags array<string>").json(path)
    return back.select("transaction_id", "risk_band", F.size("tags").alias("n_tags"))


# ================================================================== streams
def _canonical(rows: DataFrame) -> DataFrame:
    return rows.select(
        "transaction_id", "ts_sec", "customer_id", "merchant_id", "device_id", "amount", "transaction_hour", "is_fraud"
    )


@query
def stream_features(spark, d):
    """The test fold as a stream in several micro-batches, state seeded with all earlier rows."""
    p = I.prepared(spark, d)
    rows = p.log.rows
    history = _canonical(rows.filter(F.col("fold") != "test"))
    test = _canonical(rows.filter(F.col("fold") == "test"))
    target = FeatureStream(I.new_folder(spark, "features"), p.priors, history)
    return rounded(I.run_batches(spark, I.stream_of(spark, test), target, "features"), 4)


def _late_arrivals(rows: DataFrame) -> DataFrame:
    """Rows with the micro-batch in which they arrive: up to 50 minutes after their time, and one in 17 two
    days after it."""
    number = F.substring("transaction_id", 2, 10).cast("bigint")
    delay = F.when(number % 17 == 0, 2 * 86_400).otherwise(number % 3000)
    at = F.col("ts_sec") + delay
    low, high = rows.agg(F.min("ts_sec"), F.max("ts_sec")).first()
    span = F.lit(high - low + 2 * 86_400 + 1)
    return rows.withColumn("arrival", F.floor(4 * (at - low) / span).cast("int"))


@query
def stream_held_order(spark, d):
    """The test fold arriving out of order, put in order by the watermark: features as of the batch."""
    I.stateful_streams(spark)
    p = I.prepared(spark, d)
    rows = p.log.rows
    history = _canonical(rows.filter(F.col("fold") != "test"))
    test = _late_arrivals(_canonical(rows.filter(F.col("fold") == "test")))
    target = FeatureStream(I.new_folder(spark, "features"), p.priors, history)
    I.run_arrivals(spark, test, lambda stream: held(stream, 3 * 86_400), target)
    return rounded(I.written(spark, target.path, "features"), 4)


@query
def stream_late_rows(spark, d):
    """Rows that arrive when the watermark has passed them go to a side output."""
    I.stateful_streams(spark)
    p = I.prepared(spark, d)
    test = _late_arrivals(_canonical(p.log.rows.filter(F.col("fold") == "test")))
    target = FeatureStream(I.new_folder(spark, "features"), p.priors)
    I.run_arrivals(spark, test, lambda stream: held(stream, 3600), target)
    sides = [I.written(spark, target.path, side).select("transaction_id", F.lit(side == "late").alias("late")) for side in ("late", "rows")]
    return sides[0].unionByName(sides[1])


@query
def stream_decisions(spark, d):
    """Decisions of a stream that differ from those of the same rows in a table."""
    t = I.trained(spark, d)
    rows = t.log.rows
    history = _canonical(rows.filter(F.col("fold") != "test"))
    target = DecisionStream(I.new_folder(spark, "decisions"), t.bundle, history)
    out = I.run_batches(spark, I.stream_of(spark, _canonical(rows.filter(F.col("fold") == "test"))), target, "decisions")
    keep = ["transaction_id", "fraud_probability", "novelty_score", "risk_band", "tags"]
    batch = scoring.score_features(t.bundle, t.fold("test")).select(*keep)
    missing = batch.exceptAll(out.select(*keep)).unionByName(out.select(*keep).exceptAll(batch))
    return missing.agg(F.count(F.lit(1)).alias("differing_rows"))


@query
def novelty_index(spark, d):
    """Ranks looked up in the static index of the reference, in both orientations."""
    rows = I.with_deviation(I.fitted_features(spark, d)).filter(F.col("fold") != "train")
    reference = rows.filter((F.col("fold") == "val") & (F.col("is_fraud") == 0))
    index = novelty.RankIndex.fit(novelty.fit_ecdf(reference, "deviation"), bin_size=64)
    test = rows.filter(F.col("fold") == "test").select("transaction_id", "deviation")
    both = index.rank(index.rank(test, "deviation"), "deviation", "survival", "survival")
    return both.select("transaction_id", F.round("novelty", 6).alias("novelty"), F.round("survival", 6).alias("survival"))


@query
def stream_budget(spark, d):
    """The alert budget over micro-batches of decided rows."""
    keep = ["transaction_id", "ts_sec", "risk_band", "rank_score"]
    source = I.stream_of(spark, I.decided(spark, d).select(*keep))
    path = I.new_folder(spark, "budget")
    job = source.writeStream.foreachBatch(StreamingBudget(path)).option(
        "checkpointLocation", I.new_folder(spark, "checkpoint")
    )
    job.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/decisions").select("transaction_id", "risk_band", "budget_status")


@query
def stream_daily_alerts(spark, d):
    """Alerts per day from a stream that ends with a heartbeat."""
    rows = I.decided(spark, d).select("ts_sec", "transaction_id", "budget_status")
    end = rows.agg((F.max("ts_sec") + 2 * 86_400).alias("ts_sec"))
    beat = end.select("ts_sec", F.lit(None).cast("string").alias("transaction_id"), F.lit(None).cast("string").alias("budget_status"))
    return I.run_stream(spark, streams.daily_alert_stream(I.stream_of(spark, rows.unionByName(beat)), "0 seconds"))
