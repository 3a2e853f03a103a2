"""Inputs of the registered queries: the driver tables in canonical form, and a
scored table whose scores come from fixed weights so that SQL can repeat them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.functions import columns as C
from txnrisk.operators import budget, decide, density, features, models, novelty, priors, reasons, splits
from txnrisk.operators.asof import TxnLog
from txnrisk.plans import scoring
from txnrisk.settings import MODEL_FEATURES, Thresholds
from txnrisk.sources import tables
from txnrisk.sources.scratch import materialise, scratch_root
from txnrisk.streaming import scoring as streams

# weights of the fixed scoring rule; features not listed weigh nothing
WEIGHTS = {
    "amount_z_shrunk": 0.9,
    "merchant_amount_z": 0.1,
    "txn_count_24h": 0.15,
    "distinct_devices_24h": 0.2,
    "is_night": 0.4,
    "new_device": 0.7,
    "first_time_customer": 0.3,
    "segment_risk_prior": 1.5,
}
INTERCEPT = -2.2
ALL_WEIGHTS = {f: WEIGHTS.get(f, 0.0) for f in MODEL_FEATURES}

_memo: dict[tuple, object] = {}


def forget() -> None:
    """Drop shared inputs, so that the next query builds its own."""
    _memo.clear()


def _once(spark: SparkSession, folder: str, name: str, build):
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _memo:
        _memo[key] = build()
    return _memo[key]


def events_log(spark: SparkSession, folder: str) -> TxnLog:
    return _once(spark, folder, "events", lambda: TxnLog.build(
        tables.event_transactions(spark, folder), blocks=tables.blocks_of(spark, folder, "events")))


def lines_log(spark: SparkSession, folder: str) -> TxnLog:
    return _once(spark, folder, "lines", lambda: TxnLog.build(
        tables.line_transactions(spark, folder), blocks=tables.blocks_of(spark, folder, "lineitem")))


@dataclass(frozen=True)
class Prepared:
    """Folds without held-out training rows, and the baselines fitted on 'train'."""

    log: TxnLog
    holdout: DataFrame
    priors: priors.Priors


def prepared(spark: SparkSession, folder: str) -> Prepared:
    def build() -> Prepared:
        log = events_log(spark, folder)
        folds = splits.time_split(log)
        holdout = materialise(splits.holdout_customers(log.rows), "holdout")
        rows = materialise(splits.without_holdout(folds, holdout), "folds")
        log = log.over_rows(rows)
        return Prepared(log, holdout, priors.fit_priors(log.where(F.col("fold") == "train")))

    return _once(spark, folder, "prepared", build)


def fitted_features(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        p = prepared(spark, folder)
        return materialise(features.point_in_time_features(p.log, p.priors, keep=("fold",)), "features")

    return _once(spark, folder, "features", build)


def with_fixed_score(rows: DataFrame, ecdf: DataFrame) -> DataFrame:
    """Probability from the fixed weights; novelty is the rank of the amount deviation."""
    out = rows.withColumn("p", reasons.logistic(reasons.linear_margin(WEIGHTS, INTERCEPT)))
    return novelty.ecdf_rank(out, "deviation", ecdf)


def with_deviation(rows: DataFrame) -> DataFrame:
    return rows.withColumn("deviation", F.round(F.abs("amount_z_shrunk"), 6))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Validation and test rows with probability and novelty, before any decision."""

    def build() -> DataFrame:
        rows = with_deviation(fitted_features(spark, folder)).filter(F.col("fold") != "train")
        reference = rows.filter((F.col("fold") == "val") & (F.col("is_fraud") == 0))
        return materialise(with_fixed_score(rows, novelty.fit_ecdf(reference, "deviation")), "scored")

    return _once(spark, folder, "scored", build)


def thresholds(spark: SparkSession, folder: str) -> Thresholds:
    def build() -> Thresholds:
        val = scored(spark, folder).filter(F.col("fold") == "val").select(F.round("p", 6).alias("p"))
        return decide.fit_thresholds(val, "p")

    return _once(spark, folder, "thresholds", build)


def decided(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows with bands, alerts and the alert flag as status."""

    def build() -> DataFrame:
        test = scored(spark, folder).filter(F.col("fold") == "test")
        return materialise(
            decide.unbudgeted_status(decide.with_decision(test, thresholds(spark, folder))), "decided"
        )

    return _once(spark, folder, "decided", build)


def budgeted(spark: SparkSession, folder: str) -> DataFrame:
    return budget.apply_budget(decided(spark, folder).drop("budget_status"))


def train_customers(spark: SparkSession, folder: str) -> DataFrame:
    return prepared(spark, folder).log.rows.filter(F.col("fold") == "train").select("customer_id").distinct()


def trained(spark: SparkSession, folder: str) -> scoring.Trained:
    return _once(spark, folder, "trained", lambda: scoring.train(events_log(spark, folder)))


def test_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The test fold scored by the fitted bundle under the alert budget, with reasons."""
    return _once(
        spark, folder, "test_scores",
        lambda: materialise(scoring.score_fold(trained(spark, folder), explain=True), "test_scores"),
    )


def boosted(spark: SparkSession, folder: str):
    rows = fitted_features(spark, folder)
    return _once(
        spark, folder, "boosted",
        lambda: models.fit_boosting(rows.filter(F.col("fold") == "train"), rows.filter(F.col("fold") == "val")),
    )


def bagged(spark: SparkSession, folder: str):
    rows = fitted_features(spark, folder)
    return _once(spark, folder, "bagged", lambda: models.fit_forest(rows.filter(F.col("fold") == "train")))


def local_density(spark: SparkSession, folder: str) -> density.LocalDensity:
    train = fitted_features(spark, folder).filter(F.col("fold") == "train")
    return _once(spark, folder, "density", lambda: density.fit_local_density(splits.legitimate(train)))


def stateful_streams(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store; that is the application's choice."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, rows: DataFrame, batches: int = 4) -> DataFrame:
    """Write rows as files that each hold a range of time, and read them back in this order as a
    stream of about ``batches`` micro-batches."""
    folder = new_folder(spark, "stream")
    files = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(files, "ts_sec", "transaction_id").write.parquet(folder)
    # a stream takes files by their time of change; the writing tasks end in any order
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(p for f in fs.listStatus(path) if (p := f.getPath().getName()).startswith("part-"))
    first = fs.getFileStatus(path).getModificationTime() - 1000 * len(parts)
    for i, name in enumerate(parts):
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(folder, name), first + 1000 * i, -1)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return streams.read_stream(spark, folder, schema, files_per_batch=max(1, -(-len(parts) // batches)))


def run_stream(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all available files and read its result table."""
    out = new_folder(spark, "result")
    streams.start(df, out, new_folder(spark, "checkpoint"), available_only=True, mode=mode).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def written(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}").drop("batch")


def run_batches(spark: SparkSession, df: DataFrame, target, table: str) -> DataFrame:
    """Run a stream over all available files into a target for micro-batches, and read a table that it wrote."""
    streams.start_batches(df, target, new_folder(spark, "checkpoint"), available_only=True).awaitTermination()
    return written(spark, target.path, table)


def run_arrivals(spark: SparkSession, rows: DataFrame, job, target) -> None:
    """Run ``job`` once for every value of ``arrival``: new files, then the stream goes on from its checkpoint. A
    heartbeat at the end releases what is held."""
    rows = materialise(rows, "arrivals")
    source, checkpoint = new_folder(spark, "stream"), new_folder(spark, "checkpoint")
    last, end = rows.agg(F.max("arrival"), F.max("ts_sec")).first()
    plain = rows.drop("arrival")
    beat = spark.range(1).select(*[F.lit(end + 30 * 86_400 if n == "ts_sec" else None).cast(t).alias(n) for n, t in plain.dtypes])
    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes)
    for arrival in [*range(last + 1), None]:
        part = beat if arrival is None else rows.filter(F.col("arrival") == arrival).drop("arrival")
        part.write.mode("append").parquet(source)
        stream = streams.read_stream(spark, source, schema, files_per_batch=1_000_000)
        streams.start_batches(job(stream), target, checkpoint, available_only=True).awaitTermination()


# ------------------------------------------------------------------ messy text
def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a hand-made export: odd headers, amounts and times as text in
    several spellings, some unreadable, and repeated ids."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    cents = F.round(F.col("value") * 100).cast("bigint") * 4321
    whole, frac = F.expr("div(_cents, 100)"), F.lpad(F.expr("cast(_cents % 100 as string)"), 2, "0")
    thousands = F.expr("div(div(_cents, 100), 1000)")
    last3 = F.lpad(F.expr("cast(div(_cents, 100) % 1000 as string)"), 3, "0")
    kind = F.col("event_id") % 6
    amount = (
        F.when(kind == 0, F.concat(whole, F.lit("."), frac))
        .when(kind == 1, F.concat(thousands, F.lit(","), last3, F.lit("."), frac))
        .when(kind == 2, F.concat(F.lit("1,"), F.lpad((thousands % 1000).cast("string"), 3, "0"), F.lit(","), last3))
        .when(kind == 3, F.concat(F.lit("-"), whole))
        .when(kind == 4, "n/a")
        .otherwise(F.concat(F.lit(" "), whole, F.lit(" ")))
    )
    sec = C.epoch_seconds(F.col("ts"))
    # digits of the wall clock, without going through the session zone
    wall = F.concat_ws(
        " ", F.col("ts").cast("date").cast("string"),
        F.concat_ws(":", *[F.lpad(F.pmod(F.floor(sec / d), F.lit(m)).cast("string"), 2, "0") for d, m in ((3600, 24), (60, 60), (1, 60))]),
    )
    style = F.col("event_id") % 7
    time = (
        F.when(style == 0, F.concat(F.translate(wall, " ", "T"), F.lit("Z")))
        .when(style == 1, F.concat(wall, F.lit("+02:00")))
        .when(style == 2, F.concat(wall, F.lit(".750")))
        .when(style == 3, "not a time")
        .otherwise(wall)
    )
    base = e.withColumn("_cents", cents)
    return base.select(
        F.concat(F.lit("R"), F.expr("div(event_id, 3) * 3 + least(event_id % 3, 1)")).alias(" Txn_ID "),
        time.alias("Event_Time"),
        amount.alias("AMT"),
        F.concat(F.lit("C"), "user_id").alias("CID"),
        F.concat(F.lit("M"), F.get_json_object("props", "$.k")).alias("Merchant"),
        F.concat(F.lit("D"), "user_id").alias("device"),
        F.when(F.col("event_type") == "error", "1").when(F.col("event_type") == "view", "0.0").when(
            F.col("event_type") == "click", "?"
        ).otherwise("0").alias("isFraud"),
        F.col("event_id").alias("line_no"),
    )


def dated_events(spark: SparkSession, folder: str) -> DataFrame:
    """(line_no, style, text): event times in several spellings, numbers with the day first."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    sec = C.epoch_seconds(F.col("ts"))
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(sec / 86_400).cast("int"))
    hour, minute, second = (F.pmod(F.floor(sec / d), F.lit(m)) for d, m in ((3600, 24), (60, 60), (1, 60)))
    y, m, d = (f(date).cast("string") for f in (F.year, F.month, F.dayofmonth))

    def two(x):
        return F.lpad(x.cast("string"), 2, "0")

    name = F.get(F.array(*[F.lit(n.title()) for n in C.MONTHS]), F.month(date) - 1)
    clock = F.concat_ws(":", two(hour), two(minute), two(second))
    half = F.when(hour < 12, "AM").otherwise("PM")
    style = (F.col("event_id") % 8).cast("int")
    texts = [
        F.concat_ws(" ", date.cast("string"), clock),
        F.concat_ws(" ", F.concat_ws("/", two(d), two(m), y), clock),
        F.concat_ws(" ", F.concat_ws(".", d, m, y), F.concat_ws(":", two(hour), two(minute))),
        F.concat_ws(" ", F.concat_ws("/", y, m, d), clock),
        F.concat_ws(" ", d, name, y, clock),
        F.concat(name, F.lit(" "), d, F.lit(", "), y, F.lit(" "), F.pmod(hour + 11, F.lit(12)) + 1, F.lit(":"), two(minute), F.lit(":"), two(second), F.lit(" "), half),
        F.concat_ws("-", two(d), two(m), y),
        F.lit("31/31/2024 10:00"),
    ]
    text = texts[-1]
    for i, t in enumerate(texts[:-1]):
        text = F.when(style == i, t).otherwise(text)
    return e.select(F.col("event_id").alias("line_no"), style.alias("style"), text.alias("timestamp"))
