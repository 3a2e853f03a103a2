"""Folds, holdouts, strata and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import columns as C
from txnrisk.operators.asof import TxnLog
from txnrisk.operators.ordering import ordered_table, spread_join, with_row_index
from txnrisk.settings import DEFAULTS


def time_split(log: TxnLog, train: float = DEFAULTS.train_frac, val: float = DEFAULTS.val_frac) -> DataFrame:
    """Log rows with ``fold``: cut by position in time order, never shuffled."""
    n = log.rows.count()
    first, second = int(n * train), int(n * (train + val))
    index = F.col("row_index")
    fold = F.when(index < first, "train").when(index < second, "val").otherwise("test")
    return with_row_index(log.rows).withColumn("fold", fold)


def hash_ranked(df: DataFrame, id_col: str, seed: int = DEFAULTS.seed) -> DataFrame:
    """Rows with ``hash_rank``: their position in a seeded pseudo-random order."""
    hashed = df.withColumn("_hash", C.seeded_hash(F.col(id_col), seed))
    ranked = with_row_index(ordered_table(hashed, "_hash", id_col, seq="_hseq"), "_hseq", "hash_rank")
    return ranked.drop("_hash", "_hseq")


def holdout_customers(rows: DataFrame, frac: float = DEFAULTS.unseen_customer_frac, seed: int = DEFAULTS.seed) -> DataFrame:
    """A seeded share of all customers, two at least."""
    customers = rows.select("customer_id").distinct()
    n = max(2, int(customers.count() * frac))
    return hash_ranked(customers, "customer_id", seed).filter(F.col("hash_rank") < n).select("customer_id")


def without_holdout(folds: DataFrame, holdout: DataFrame) -> DataFrame:
    """Held-out customers leave the training fold only."""
    marked = spread_join(folds, holdout.withColumn("_held", F.lit(True)), "customer_id")
    keep = (F.col("fold") != "train") | F.col("_held").isNull()
    return marked.filter(keep).select(*folds.columns)


def members(df: DataFrame, ids: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Rows whose key is among ``ids``, or isn't."""
    return spread_join(df, ids.select(key).distinct(), key, "left_semi" if inside else "left_anti")


def union_folds(*folds: DataFrame) -> DataFrame:
    """Folds on top of each other; their order key is kept in ``seq``."""
    out = folds[0]
    for f in folds[1:]:
        out = out.unionByName(f)
    return out


def first_time_flags(df: DataFrame) -> DataFrame:
    new = {k: (F.col(f"{k}_history_count") == 0).cast("int") for k in ("customer", "device", "merchant")}
    flags: dict[str, Column] = {f"first_time_{k}": flag for k, flag in new.items()}
    flags["first_time_any"] = F.greatest(*new.values())
    return df.withColumns(flags)


def half_split(df: DataFrame, id_col: str, seed: int = DEFAULTS.seed) -> DataFrame:
    """Rows with ``half``: 'fit' or 'eval', by seeded order. Small tables (half below
    200 rows) give the fitting half 50 rows at least."""
    n = df.count()
    half = n // 2
    if half < 200:
        half = max(50, half)
    return hash_ranked(df, id_col, seed).withColumn("half", F.when(F.col("hash_rank") < half, "fit").otherwise("eval")).drop("hash_rank")


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = DEFAULTS.seed) -> DataFrame:
    """A seeded sample of ``n`` rows (a bounded top-n)."""
    return df.orderBy(C.seeded_hash(F.col(id_col), seed), id_col).limit(n)


def before_moment(log_rows: DataFrame, ts_sec: int) -> DataFrame:
    """All history strictly before a moment; rows of the same second are left out."""
    return log_rows.filter(F.col("ts_sec") < ts_sec)


def extreme_row(pool: DataFrame, score: str, highest: bool) -> DataFrame:
    """The row with the lowest or highest score, earliest first among equals."""
    order = F.col(score).desc() if highest else F.col(score).asc()
    return pool.orderBy(order, "ts_sec", "transaction_id").limit(1)


def legitimate(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_fraud") == 0)
