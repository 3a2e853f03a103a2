"""Adapter from an anonymised card-payment export to the canonical schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import columns as C

# ---- fixed values: columns read from the two wide source files, time origin
PAYMENT_COLUMNS = [
    "TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD",
    "card1", "card2", "card5", "addr1", "addr2", "dist1", "P_emaildomain", "R_emaildomain",
]
IDENTITY_COLUMNS = ["TransactionID", "DeviceType", "DeviceInfo"]
KEPT_AS_IS = ["ProductCD", "card2", "card5", "addr2", "dist1", "P_emaildomain", "R_emaildomain"]
ORIGIN_SEC = 1_509_408_000  # 2017-10-31 00:00:00 UTC
NO_DEVICE = "NA_DEVICE"


def adapt_payments(payments: DataFrame, identity: DataFrame | None) -> DataFrame:
    """Join the optional identity table and build canonical ids.

    Both inputs are pruned to the listed columns first, so a columnar source
    reads only those.
    """
    rows = payments.select(*[c for c in PAYMENT_COLUMNS if c in payments.columns])
    if identity is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in IDENTITY_COLUMNS[1:]})
    else:
        rows = rows.join(identity.select(*IDENTITY_COLUMNS), "TransactionID", "left")
    offset = F.col("TransactionDT").cast("bigint")
    device = F.regexp_replace(
        F.concat(F.coalesce("DeviceInfo", F.lit("")), F.lit("|"), F.coalesce("DeviceType", F.lit(""))),
        r"^\|+|\|+$", "",
    )

    def prefixed(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.coalesce(F.col(column).cast("string"), F.lit("-1")))

    return rows.select(
        F.col("TransactionID").cast("string").alias("transaction_id"),
        C.utc_wall(offset + ORIGIN_SEC).alias("timestamp"),
        F.col("TransactionAmt").cast("double").alias("amount"),
        prefixed("card_", "card1").alias("customer_id"),
        prefixed("addr_", "addr1").alias("merchant_id"),
        F.coalesce(F.nullif(device, F.lit("")), F.lit(NO_DEVICE)).alias("device_id"),
        F.pmod(F.floor(offset / 3600), F.lit(24)).cast("int").alias("transaction_hour"),
        F.coalesce(F.col("isFraud").cast("int"), F.lit(0)).alias("is_fraud"),
        *[c for c in KEPT_AS_IS if c in rows.columns],
    )


def adapter_summary(adapted: DataFrame) -> DataFrame:
    return adapted.agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg("is_fraud") * 100, 4).alias("fraud_rate_pct"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.countDistinct("merchant_id").alias("unique_merchants"),
        F.countDistinct("device_id").alias("unique_devices"),
        F.round(F.avg((F.col("device_id") != NO_DEVICE).cast("double")) * 100, 2).alias("pct_with_device"),
        C.epoch_seconds(F.min("timestamp")).alias("first_ts"),
        C.epoch_seconds(F.max("timestamp")).alias("last_ts"),
    )
