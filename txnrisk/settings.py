"""Default parameters, column names and word lists.

Everything in this module is a fixed value: results depend on it, so it is
stated plainly instead of being derived.
"""

from __future__ import annotations

from dataclasses import dataclass, field

DAY = 86_400

# ---- fixed values: canonical columns and the header spellings accepted for them
ALIASES: dict[str, list[str]] = {
    "transaction_id": ["transaction_id", "txn_id", "id", "transactionid"],
    "timestamp": ["timestamp", "event_time", "time", "transactiontime", "tx_time"],
    "customer_id": ["customer_id", "customer_key", "cid", "user_id"],
    "merchant_id": ["merchant_id", "merchant_key", "mid", "merchant"],
    "device_id": ["device_id", "device_key", "did", "device"],
    "amount": ["amount", "amt", "transaction_amount"],
    "transaction_hour": ["transaction_hour", "hour", "hr"],
    "is_night": ["is_night", "night", "night_flag"],
    "is_fraud": ["is_fraud", "fraud", "label", "isfraud", "class"],
    "new_customer": ["new_customer", "is_new_customer"],
    "new_merchant": ["new_merchant", "is_new_merchant"],
    "new_device": ["new_device", "is_new_device"],
    "velocity_8min": ["velocity_8min", "velocity", "txns_8min"],
    "amount_spike": ["amount_spike", "spike", "amount_flag"],
    "customer_history_count": ["customer_history_count", "cust_hist_count", "customer_count"],
    "merchant_history_count": ["merchant_history_count", "merch_hist_count", "merchant_count"],
    "device_history_count": ["device_history_count", "device_hist_count", "device_count"],
}
REQUIRED = ["transaction_id", "timestamp", "amount", "customer_id", "merchant_id", "device_id"]
LABEL = "is_fraud"

# supplied integer columns that are optional in a raw file
OPTIONAL_INTEGERS = [
    "transaction_hour", "is_night", "new_customer", "new_merchant", "new_device",
    "velocity_8min", "amount_spike", "customer_history_count",
    "merchant_history_count", "device_history_count",
]

# ---- fixed values: columns summarised by the data-quality report
NUMERIC_SUMMARY = ["amount", "transaction_hour"]
CATEGORICAL_SUMMARY = [
    "is_night", "new_customer", "new_merchant", "new_device", "is_fraud",
    "velocity_8min", "amount_spike", "customer_history_count",
    "merchant_history_count", "device_history_count",
]

# ---- fixed values: model inputs, in model order
MODEL_FEATURES = [
    "amount_log", "transaction_hour", "day_of_week", "is_weekend", "is_night",
    "amount_bucket", "amount_z_shrunk", "customer_amount_z", "merchant_amount_z",
    "txn_count_5m", "txn_count_5m_log", "txn_count_30m", "txn_count_30m_log",
    "txn_count_24h", "txn_count_24h_log", "distinct_merchants_24h",
    "distinct_devices_24h", "amount_sum_24h_log",
    "customer_history_count", "merchant_history_count", "device_history_count",
    "customer_history_count_log", "merchant_history_count_log",
    "device_history_count_log",
    "customer_avg_amount_log", "merchant_avg_amount_log",
    "time_since_customer_txn_log", "time_since_device_txn_log",
    "new_device", "new_merchant", "first_time_customer",
    "customer_history_available", "merchant_history_available",
    "device_history_available", "customer_history_conf", "history_stratum",
    "customer_amount_baseline", "segment_amount_baseline",
    "global_amount_baseline", "segment_risk_prior",
]
NOVELTY_FEATURES = [
    "amount_log", "amount_z_shrunk", "transaction_hour", "is_night", "is_weekend",
    "txn_count_5m_log", "txn_count_30m_log", "txn_count_24h_log",
    "new_device", "new_merchant", "first_time_customer",
    "time_since_customer_txn_log", "time_since_device_txn_log",
    "customer_history_count_log", "merchant_history_count_log",
    "device_history_count_log",
    "distinct_devices_24h", "distinct_merchants_24h",
    "customer_history_conf", "amount_sum_24h_log",
]
PASSTHROUGH = [
    "transaction_id", "timestamp", "ts_sec", "customer_id", "merchant_id",
    "device_id", "amount", "transaction_hour", "is_night", "day_of_week",
    "is_weekend", "is_fraud", "new_customer", "velocity_8min", "amount_spike",
]

# ---- fixed values: look-back spans of the velocity features, in seconds
SPANS = {"5m": 300, "30m": 1_800, "24h": DAY}
PARITY_SPAN = 480

# ---- fixed values: reason families and the features each one adds up
REASON_GROUPS: dict[str, list[str]] = {
    "velocity": ["txn_count_5m", "txn_count_30m", "txn_count_24h",
                 "txn_count_5m_log", "txn_count_30m_log", "txn_count_24h_log",
                 "amount_sum_24h_log", "distinct_merchants_24h", "distinct_devices_24h"],
    "amount": ["amount_log", "amount_z_shrunk", "customer_amount_z",
               "merchant_amount_z", "amount_bucket"],
    "time": ["transaction_hour", "day_of_week", "is_weekend", "is_night"],
    "device": ["new_device", "device_history_count", "device_history_count_log",
               "device_history_available", "time_since_device_txn_log"],
    "merchant": ["new_merchant", "merchant_history_count", "merchant_history_count_log",
                 "merchant_amount_z", "merchant_avg_amount_log", "merchant_history_available"],
    "history": ["customer_history_count", "customer_history_count_log",
                "customer_history_available", "customer_history_conf", "history_stratum",
                "first_time_customer", "time_since_customer_txn_log",
                "customer_amount_baseline", "segment_amount_baseline",
                "global_amount_baseline", "segment_risk_prior", "customer_amount_z"],
}

BANDS = ["normal", "monitor", "review", "high-risk"]
STRATA = ["cold", "warm", "established"]
TIERS = ["rare", "low", "mid", "high"]


@dataclass(frozen=True)
class Thresholds:
    p_review: float = 0.15
    p_high: float = 0.45
    novelty_high: float = 0.90
    novelty_very_high: float = 0.97
    p_floor_for_novelty: float = 0.02


@dataclass(frozen=True)
class AlertBudget:
    budget_pct: float = 2.0
    high_risk_pct: float = 0.7
    max_per_hour: int = 250
    max_per_day: int = 3_000


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    train_frac: float = 0.6
    val_frac: float = 0.2
    unseen_customer_frac: float = 0.2
    cold_kappa: float = 5.0
    baseline_min_n: int = 3
    smoothing: float = 20.0
    budget_grid: tuple[float, ...] = (0.5, 1.0, 2.0, 3.0, 5.0)
    importance_sample: int = 2_000
    thresholds: Thresholds = field(default_factory=Thresholds)
    budget: AlertBudget = field(default_factory=AlertBudget)


DEFAULTS = Settings()
