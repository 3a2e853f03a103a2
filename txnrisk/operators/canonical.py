"""Raw tables to the canonical transaction schema, row validation and file preview."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnrisk.functions import columns as C
from txnrisk.settings import ALIASES, LABEL, OPTIONAL_INTEGERS, REQUIRED

ARRIVAL = "_arrival"
IDS = ["customer_id", "merchant_id", "device_id"]


@dataclass(frozen=True)
class SchemaMap:
    """Which raw column feeds which canonical column."""

    mapping: dict[str, str]
    unmapped: list[str]
    missing: list[str]


def map_schema(columns: list[str], aliases: dict[str, list[str]] = ALIASES, require_label: bool = True) -> SchemaMap:
    """Match headers, trimmed and in lower case, against the accepted spellings."""
    by_header = {str(c).strip().lower(): c for c in columns}
    mapping = {}
    for name, spellings in aliases.items():
        hit = next((by_header[s.lower()] for s in spellings if s.lower() in by_header), None)
        if hit is not None:
            mapping[name] = hit
    needed = REQUIRED + ([LABEL] if require_label else [])
    return SchemaMap(
        mapping=mapping,
        unmapped=[n for n in aliases if n not in mapping],
        missing=[n for n in needed if n not in mapping],
    )


def require_columns(schema: SchemaMap) -> None:
    if schema.missing:
        raise ValueError("required columns missing after alias mapping: " + ", ".join(schema.missing))


def renamed(df: DataFrame, schema: SchemaMap) -> DataFrame:
    """Rename mapped columns; columns without a mapping are kept as they are."""
    names = {raw: canonical for canonical, raw in schema.mapping.items()}
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def keep_first(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in the stated order. Spark applies a row-number limit
    on the map side too, so copies of a frequent key are dropped before the shuffle."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_nth", nth).filter(F.col("_nth") == 1).drop("_nth")


def date_order(df: DataFrame, column: str = "timestamp") -> str:
    """Whether dates such as 05/01/2024 give the day or the month first, from those of the column that allow one
    reading only. Month first without any such date; ``mixed`` if there are both, and then only these are read."""
    if dict(df.dtypes)[column] != "string":
        return C.MONTH_FIRST
    found = df.agg(*C.date_order_counts(F.col(column))).first()
    if found.day_first and found.month_first:
        return C.MIXED
    return C.DAY_FIRST if found.day_first else C.MONTH_FIRST


def coerced(df: DataFrame, order: str = C.MONTH_FIRST) -> DataFrame:
    """Typed canonical columns. Rows whose timestamp cannot be read keep a null
    ``ts_sec``, and unreadable or non-positive amounts become null."""
    out = df
    if LABEL not in out.columns:
        out = out.withColumn(LABEL, F.lit(0))
    types = dict(out.dtypes)
    ts = F.col("timestamp")
    if types["timestamp"] == "timestamp_ntz":
        ts_sec = C.epoch_seconds(ts)
    elif types["timestamp"] == "timestamp":
        ts_sec = F.floor(F.unix_micros(ts) / F.lit(1_000_000)).cast("bigint")
    else:
        ts_sec = C.parsed_epoch(ts, order)
    out = out.withColumns(
        {
            "transaction_id": F.col("transaction_id").cast("string"),
            "ts_sec": ts_sec,
            "amount": C.repaired_amount(F.col("amount")),
            LABEL: C.coerced_label(F.col(LABEL)),
            **{k: F.col(k).cast("string") for k in IDS},
            **{k: F.col(k).try_cast("int") for k in OPTIONAL_INTEGERS if k in out.columns},
        }
    ).withColumn("timestamp", C.utc_wall(F.col("ts_sec")))
    hour = C.hour_of(F.col("ts_sec"))
    if "transaction_hour" in out.columns:
        hour = F.coalesce(F.col("transaction_hour"), hour)
    out = out.withColumn("transaction_hour", hour)
    if "is_night" not in out.columns:
        out = out.withColumn("is_night", C.night_flag(F.col("transaction_hour")))
    return out


def canonicalise(df: DataFrame, require_label: bool = True, keep_first_by: list[str] | None = None) -> DataFrame:
    """Header mapping, duplicate removal, coercion and the timestamp filter.

    ``keep_first_by`` states which of several rows with one id comes first;
    a scan made by ``read_transactions`` carries its file order for it.
    """
    out = first_copies(df, require_label, keep_first_by)
    return coerced(out, date_order(out)).filter(F.col("ts_sec").isNotNull()).drop(ARRIVAL)


def first_copies(df: DataFrame, require_label: bool = True, keep_first_by: list[str] | None = None) -> DataFrame:
    """Rows under canonical names, one per transaction_id. Where no order is known, the copy with the least values stays."""
    schema = map_schema([c for c in df.columns if c != ARRIVAL], require_label=require_label)
    require_columns(schema)
    out = renamed(df, schema)
    order = keep_first_by or ([ARRIVAL] if ARRIVAL in df.columns else ["timestamp", *sorted(set(out.columns) - {"timestamp"})])
    return keep_first(out, "transaction_id", order)


def with_amount(df: DataFrame) -> DataFrame:
    return df.filter(F.col("amount").isNotNull())


def load_metadata(df: DataFrame, require_label: bool = True, order: str = C.MONTH_FIRST) -> DataFrame:
    """Row counts of the load: read, duplicates dropped, unreadable timestamps, kept.

    One aggregate over one row per id: all copies of an id but the first go, so the
    number of rows per id is enough. The timestamp test looks at the kept copy.
    """
    schema = map_schema([c for c in df.columns if c != ARRIVAL], require_label=require_label)
    require_columns(schema)
    out = renamed(df, schema)
    arrival = F.struct(ARRIVAL) if ARRIVAL in out.columns else F.struct("timestamp")
    per_id = out.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min_by(F.col("timestamp").cast("string"), arrival).alias("timestamp"),
    )
    bad = C.parsed_epoch(F.col("timestamp"), order).isNull().cast("bigint")
    return per_id.agg(
        F.sum("copies").cast("bigint").alias("rows_read"),
        F.sum(F.col("copies") - 1).cast("bigint").alias("duplicate_txns_dropped"),
        F.sum(bad).cast("bigint").alias("unparseable_timestamps"),
        F.sum(1 - bad).cast("bigint").alias("rows_loaded"),
    )


def header_mapping(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """(column, header, required): every canonical column with the header that feeds it, null without one."""
    schema = map_schema([c for c in df.columns if c != ARRIVAL], aliases)
    rows = [(name, schema.mapping.get(name), name in REQUIRED or name == LABEL) for name in aliases]
    return df.sparkSession.createDataFrame(rows, "column string, header string, required boolean")


@dataclass
class LoadReport:
    """Figures of a load that fill in while its rows are read for the first time; nothing is read twice for them."""

    mapping: SchemaMap
    date_order: str
    _observed: Observation

    @property
    def counts(self) -> dict[str, int]:
        """Rows after duplicates went, unreadable times, and rows kept; waits for the first action on the rows."""
        return dict(self._observed.get)


def loaded(df: DataFrame, require_label: bool = True, keep_first_by: list[str] | None = None) -> tuple[DataFrame, LoadReport]:
    """Typed rows, those that can't be scored included, and the report of the load."""
    schema = map_schema([c for c in df.columns if c != ARRIVAL], require_label=require_label)
    out = first_copies(df, require_label, keep_first_by)
    order = date_order(out)
    observed = Observation("load")
    rows = coerced(out, order).observe(
        observed, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ts_sec").isNull()).alias("unparseable_timestamps"),
        F.count_if(F.col("amount").isNull()).alias("without_amount"),
    )
    return rows, LoadReport(schema, order, observed)


# ------------------------------------------------------------------ validation
def validation_errors(request: bool = False) -> Column:
    """Array of error texts of a row; empty if it may be scored.

    ``request`` adds the hour range that single requests must keep.
    """
    amount = F.col("amount").try_cast("double")
    checks = [
        F.when(amount.isNull() | F.isnan(amount) | (amount <= 0), "amount must be a positive number"),
        F.when(F.col("ts_sec").isNull(), "timestamp required"),
    ]
    for k in IDS:
        checks.append(F.when(F.coalesce(F.col(k), F.lit("")) == "", f"{k} required"))
    if request:
        hour = F.col("transaction_hour")
        checks.append(F.when(~hour.between(0, 23), "transaction_hour must be 0..23"))
    return F.array_compact(F.array(*checks))


def validated(df: DataFrame, request: bool = False) -> DataFrame:
    errors = validation_errors(request)
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def split_valid(df: DataFrame, request: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to score, rows in the shape of an unscored decision)."""
    checked = validated(df, request)
    rejected = checked.filter(~F.col("valid")).withColumns(
        {
            "fraud_probability": F.lit(None).cast("double"),
            "novelty_score": F.lit(None).cast("double"),
            "risk_band": F.lit("invalid"),
            "alert": F.lit(False),
            "budget_status": F.lit("log"),
            "rank_score": F.lit(None).cast("double"),
        }
    )
    return checked.filter("valid"), rejected


def in_request_order(scored: DataFrame, index: str) -> DataFrame:
    """Answers in the order the requests came in."""
    return scored.orderBy(index)


# ------------------------------------------------------------------ preview
def file_preview(df: DataFrame, labelled: bool) -> DataFrame:
    """One row of facts about a canonical file, without scoring it."""
    rate = F.round(F.avg(LABEL) * 100, 4) if labelled else F.lit(None).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        rate.alias("fraud_rate_pct"),
        F.min("ts_sec").alias("first_ts"),
        F.max("ts_sec").alias("last_ts"),
    )


def preview_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """The earliest rows, for display."""
    return df.orderBy("ts_sec", "transaction_id").limit(n)
