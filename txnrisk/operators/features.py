"""The 40 point-in-time model features and the columns used to check them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import columns as C
from txnrisk.operators.asof import TxnLog, customer_activity, history, running_global
from txnrisk.operators.priors import NO_PRIORS, Priors, segment_lookup
from txnrisk.settings import DEFAULTS, MODEL_FEATURES, PARITY_SPAN, PASSTHROUGH, SPANS

MIN_SPREAD = 1e-6  # fixed value: smallest deviation a z-score is divided by


def calendar_features(df: DataFrame) -> DataFrame:
    hour = F.coalesce(F.col("transaction_hour"), F.lit(0)).cast("int")
    day = C.day_of_week(F.col("ts_sec"))
    return df.withColumns(
        {
            "amount_log": F.log1p("amount"),
            "transaction_hour": hour,
            "day_of_week": day,
            "is_weekend": C.weekend_flag(day),
            "is_night": C.night_flag(hour),
        }
    )


def entity_history(log: TxnLog, df: DataFrame, spans: dict[str, int] = SPANS) -> DataFrame:
    """Raw state of customer, merchant and device before each row: three shuffles,
    one for each key."""
    x = F.log1p("amount")
    rows = customer_activity(log, df, spans=spans)
    rows = history(
        log, rows, "merchant_id",
        {"merchant_history_count": ("count", None), "_mu_m": ("mean", x), "_sd_m": ("sd", x)},
    )
    return history(
        log, rows, "device_id", {"device_history_count": ("count", None), "_last_d": ("max", F.col("ts_sec"))}
    )


def _counts_and_flags(kappa: float, min_n: int) -> dict[str, Column]:
    n_c, n_m, n_d = (F.col(f"{k}_history_count") for k in ("customer", "merchant", "device"))
    return {
        "customer_history_count_log": F.log1p(n_c),
        "merchant_history_count_log": F.log1p(n_m),
        "device_history_count_log": F.log1p(n_d),
        "first_time_customer": (n_c == 0).cast("int"),
        "new_merchant": (n_m == 0).cast("int"),
        "new_device": (n_d == 0).cast("int"),
        "customer_history_available": (n_c >= min_n).cast("int"),
        "merchant_history_available": (n_m >= min_n).cast("int"),
        "device_history_available": (n_d >= 1).cast("int"),
        "history_stratum": C.stratum_code(n_c),
        "customer_history_conf": n_c / (n_c + F.lit(float(kappa))),
    }


def hours_since(ts: Column, last: Column) -> Column:
    # never negative in a batch; a late row of a stream may lie before the last one
    return F.log1p(F.greatest(F.coalesce((ts - last) / 3600.0, F.lit(0.0)), F.lit(0.0)))


def _amount_deviation(min_n: int, global_mean: Column) -> dict[str, Column]:
    """Baselines and z-scores; thin customer history is shrunk toward its segment."""
    x, conf = F.col("amount_log"), F.col("customer_history_conf")
    n_c, n_m = F.col("customer_history_count"), F.col("merchant_history_count")
    mu_c, sd_c, mu_s, sd_s = F.col("_mu_c"), F.col("_sd_c"), F.col("mu_seg"), F.col("sd_seg")
    known = n_c > 0
    mu = F.when(known, conf * mu_c + (1 - conf) * mu_s).otherwise(mu_s)
    spread = F.when(
        known,
        conf * sd_c * sd_c + (1 - conf) * sd_s * sd_s + conf * (1 - conf) * (mu_c - mu_s) * (mu_c - mu_s),
    ).otherwise(sd_s * sd_s)
    z = (x - mu) / F.sqrt(F.greatest(spread, F.lit(1e-6)))
    own = F.when(sd_c > MIN_SPREAD, (x - mu_c) / sd_c).otherwise(F.lit(0.0))
    of_merchant = F.when((n_m >= min_n) & (F.col("_sd_m") > MIN_SPREAD), (x - F.col("_mu_m")) / F.col("_sd_m"))
    return {
        "customer_amount_baseline": mu,
        "segment_amount_baseline": mu_s,
        "global_amount_baseline": global_mean,
        "segment_risk_prior": F.col("risk_seg"),
        "amount_z_shrunk": z,
        "customer_amount_z": F.when(n_c >= min_n, own).otherwise(z),
        "merchant_amount_z": F.coalesce(of_merchant, F.lit(0.0)),
        "customer_avg_amount_log": F.when(known, mu_c).otherwise(mu_s),
        "merchant_avg_amount_log": F.when(n_m >= 1, F.col("_mu_m")).otherwise(global_mean),
    }


def point_in_time_features(
    log: TxnLog,
    priors: Priors | None = None,
    parity: bool = False,
    kappa: float = DEFAULTS.cold_kappa,
    min_n: int = DEFAULTS.baseline_min_n,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Passthrough columns, ``seq`` and the 40 model features of every row in the log,
    and the further log columns named in ``keep``.

    Without priors the segment baselines fall back to the running global mean of
    the log amount. ``parity`` adds the two recomputed supplied columns.
    """
    rows = log.rows
    if parity or priors is None:
        rows = running_global(log, rows)
    # supplied look-alikes of computed features would collide with them
    computed = {f for f in MODEL_FEATURES if f not in PASSTHROUGH}
    rows = rows.drop(*[c for c in rows.columns if c in computed])
    spans = dict(SPANS, **({"8m": PARITY_SPAN} if parity else {}))
    rows = finished_features(entity_history(log, calendar_features(rows), spans), priors, kappa, min_n)
    extra = []
    if parity:
        rows = rows.withColumns(
            {"_parity_velocity_8min": F.col("txn_count_8m"), "_parity_amount_spike": amount_spike(min_n)}
        )
        extra = ["_parity_velocity_8min", "_parity_amount_spike"]
    passed = [c for c in PASSTHROUGH if c in rows.columns]
    return rows.select("seq", *keep, *passed, *[c for c in MODEL_FEATURES if c not in passed], *extra)


def finished_features(
    rows: DataFrame, priors: Priors | None, kappa: float = DEFAULTS.cold_kappa, min_n: int = DEFAULTS.baseline_min_n
) -> DataFrame:
    """Model features from calendar columns and entity state. Row by row, so the same
    code finishes batch rows and rows of a stream."""
    fitted = priors is not None
    rows = rows.withColumns(
        {
            "stratum": C.stratum(F.col("customer_history_count")),
            "tier": C.merchant_tier(F.col("merchant_history_count")),
            **_counts_and_flags(kappa, min_n),
            "amount_bucket": C.bucket_of(F.col("amount_log"), priors.edges if fitted else []),
            "time_since_customer_txn_log": hours_since(F.col("ts_sec"), F.col("_last_c")),
            "time_since_device_txn_log": hours_since(F.col("ts_sec"), F.col("_last_d")),
            "amount_sum_24h_log": F.log1p("amount_sum_24h"),
            **{f"txn_count_{s}_log": F.log1p(f"txn_count_{s}") for s in SPANS},
        }
    )
    rows = segment_lookup(rows, priors if fitted else NO_PRIORS)
    global_mean = F.lit(priors.mean) if fitted else F.coalesce(F.col("running_mean_log"), F.lit(0.0))
    if not fitted:
        rows = rows.withColumn("mu_seg", global_mean)
    return rows.withColumns(_amount_deviation(min_n, global_mean))


def amount_spike(min_n: int = DEFAULTS.baseline_min_n) -> Column:
    """Amount of at least twice the baseline: the customer's own mean with enough
    history, else the mean of all earlier rows, else the amount itself."""
    n = F.col("customer_history_count")
    baseline = F.coalesce(
        F.when(n >= min_n, F.col("_sum_c") / n), F.col("running_mean_amount"), F.col("amount")
    )
    return ((baseline > 0) & (F.col("amount") >= 2.0 * baseline)).cast("int")


def supplied_columns(log: TxnLog, min_n: int = DEFAULTS.baseline_min_n) -> DataFrame:
    """As-of columns that a raw event table is delivered with: newness flags, history
    counts, 8-minute velocity and the amount spike."""
    rows = entity_history(log, running_global(log, log.rows), {"8m": PARITY_SPAN, "24h": SPANS["24h"]})
    return rows.select(
        *log.rows.columns,
        *[(F.col(f"{k}_history_count") == 0).cast("int").alias(f"new_{k}") for k in ("customer", "merchant", "device")],
        F.col("txn_count_8m").cast("int").alias("velocity_8min"),
        amount_spike(min_n).alias("amount_spike"),
        *[F.col(f"{k}_history_count").cast("int").alias(f"{k}_history_count") for k in ("customer", "merchant", "device")],
    )


def numeric_fill(df: DataFrame, columns: list[str] = MODEL_FEATURES) -> DataFrame:
    """Anything that is not a number becomes 0, so a model can read the row."""
    def filled(c: str) -> Column:
        x = F.col(c).try_cast("double")
        return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x).alias(c)

    return df.select(*[filled(c) if c in columns else F.col(c) for c in df.columns])


def parity_rates(features: DataFrame) -> DataFrame:
    """Share of rows in which the recomputed columns equal the supplied ones."""
    def rate(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.round(F.avg(F.when(both, (F.col(a) == F.col(b)).cast("double"))), 4)

    return features.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        rate("velocity_8min", "_parity_velocity_8min").alias("velocity_8min_match_rate"),
        rate("amount_spike", "_parity_amount_spike").alias("amount_spike_match_rate"),
    )


# fixed values: flags whose mean is reported as availability
AVAILABILITY = ["customer_history_available", "first_time_customer", "new_device", "new_merchant"]


def feature_availability(features: DataFrame) -> DataFrame:
    return features.agg(*[F.round(F.avg(c), 4).alias(f"{c}_rate") for c in AVAILABILITY])
