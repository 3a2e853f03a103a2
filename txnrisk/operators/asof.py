"""Point-in-time aggregates: what was known about a key strictly before each row."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnrisk.functions import columns as C
from txnrisk.operators.ordering import SEQ, blockwise, by_key, ordered_table, task_parts
from txnrisk.settings import DAY, SPANS
from txnrisk.sources.scratch import materialise

KEYS = ["customer_id", "merchant_id", "device_id"]
DEFAULT_HEAVY_LIMIT = 1_000_000


@dataclass(frozen=True)
class TxnLog:
    """Canonical transactions in their total order, with the keys too frequent for one task.

    ``heavy`` is a written table of the (key_name, key_value) pairs with more than ``limit`` rows, the
    most that one task should sort. The limit doesn't rise with the table, so the list may: at most
    rows / limit values per key column. It is joined, and Spark broadcasts it only if it is small. ``parts`` is
    the number of partitions for shuffles on a key, where the session's would be too few for the rows.
    """

    rows: DataFrame
    heavy: DataFrame | None
    limit: int
    parts: int | None = None

    @classmethod
    def build(cls, df: DataFrame, heavy_limit: int = DEFAULT_HEAVY_LIMIT, blocks: int | None = None) -> TxnLog:
        """Order canonical rows. A missing id is one unknown entity with an empty id; rows without an
        amount are no part of any history and are left out."""
        known = df.filter(F.col("amount").isNotNull()).withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in KEYS})
        return cls.over(ordered_table(known, "ts_sec", "transaction_id", blocks=blocks), heavy_limit)

    @classmethod
    def over(cls, rows: DataFrame, heavy_limit: int = DEFAULT_HEAVY_LIMIT) -> TxnLog:
        n = rows.count()
        parts = task_parts(rows.sparkSession, n)
        if n <= heavy_limit:
            return cls(rows, None, heavy_limit, parts)
        pairs = rows.select(F.explode(F.create_map(*[x for k in KEYS for x in (F.lit(k), F.col(k))])))
        counts = pairs.toDF("key_name", "key_value").groupBy("key_name", "key_value").count()
        heavy = materialise(counts.filter(F.col("count") > heavy_limit).select("key_name", "key_value"), "heavy")
        return cls(rows, None if heavy.isEmpty() else heavy, heavy_limit, parts)

    def where(self, condition: Column) -> TxnLog:
        """A part of the log in the same order; heavy keys stay marked."""
        return replace(self, rows=self.rows.filter(condition))

    def over_rows(self, rows: DataFrame) -> TxnLog:
        return replace(self, rows=rows)

    def split(self, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
        """(rows of ordinary keys, rows of heavy keys or None)."""
        if self.heavy is None:
            return df, None
        heavy = self.heavy.filter(F.col("key_name") == key).select(F.col("key_value").alias(key))
        return df.join(heavy, key, "left_anti").select(*df.columns), df.join(heavy, key, "left_semi").select(*df.columns)


# --------------------------------------------------------------- whole history
Aggs = dict[str, tuple[str, Column | None]]


def history(log: TxnLog, df: DataFrame, key: str, aggs: Aggs) -> DataFrame:
    """Add aggregates over all earlier rows with the same key.

    ``aggs`` maps a new column to (kind, input), kind being count, sum, min, max, mean
    or sd (population, 0 for fewer than two rows). Ordinary keys take one window,
    heavy keys the block-wise form of the same aggregates.
    """
    ordinary, heavy = log.split(df, key)
    if log.parts:
        ordinary = by_key(ordinary, log.parts, key)
    before = W.partitionBy(key).orderBy(SEQ).rowsBetween(W.unboundedPreceding, -1)
    one = {
        "count": lambda x: F.count(F.lit(1)).over(before),
        "sum": lambda x: F.coalesce(F.sum(x).over(before), F.lit(0)),
        "min": lambda x: F.min(x).over(before),
        "max": lambda x: F.max(x).over(before),
        "mean": lambda x: F.avg(x).over(before),
        "sd": lambda x: F.coalesce(F.stddev_pop(x).over(before), F.lit(0.0)),
    }
    out = ordinary.select("*", *[one[kind](x).alias(name) for name, (kind, x) in aggs.items()])
    if heavy is None:
        return out
    return out.unionByName(_sliced_history(heavy, [key], aggs, SEQ, log.parts))


def _sliced_history(df: DataFrame, keys: list[str], aggs: Aggs, seq: str, parts: int | None = None) -> DataFrame:
    """The block-wise form. Deviations are summed around the key's first value: any centre gives the same
    result, and this one is part of every history, so rounding stays within n times that of one number."""
    bases: dict[str, tuple[str, Column]] = {}
    columns = df.columns
    spread = {name: x for name, (kind, x) in aggs.items() if kind == "sd"}
    if spread:
        finite = {name: (x, F.when(F.abs(x) < F.lit(float("inf")), F.col(seq))) for name, x in spread.items()}
        centres = df.groupBy(*keys).agg(*[F.coalesce(F.min_by(*by), F.lit(0.0)).alias(f"_{name}_c") for name, by in finite.items()])
        df = df.join(centres, keys)
    for name, (kind, x) in aggs.items():
        if kind in ("sum", "min", "max"):
            bases[f"_{name}"] = (kind, x)
        else:
            present = F.lit(1) if x is None else x.isNotNull().cast("int")
            bases[f"_{name}_n"] = ("sum", present.cast("bigint"))
            if kind == "sd":
                x = x - F.col(f"_{name}_c")
                bases[f"_{name}_2"] = ("sum", x * x)
            if kind in ("mean", "sd"):
                bases[f"_{name}_1"] = ("sum", x)
    rows = blockwise(df, keys, bases, seq, parts=parts)

    def finished(name: str, kind: str) -> Column:
        if kind in ("sum", "min", "max"):
            return F.col(f"_{name}")
        n = F.col(f"_{name}_n")
        if kind == "count":
            return n
        mean = F.when(n > 0, F.col(f"_{name}_1") / n)
        if kind == "mean":
            return mean
        variance = F.col(f"_{name}_2") / n - mean * mean
        return F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(F.lit(0.0))

    return rows.select(*columns, *[finished(name, kind).alias(name) for name, (kind, _) in aggs.items()])


def running_global(log: TxnLog, df: DataFrame) -> DataFrame:
    """Mean amount and mean log amount of all earlier rows; null for the first row."""
    bases = {
        "_n": ("sum", F.lit(1).cast("bigint")),
        "_amount": ("sum", C.exact(F.col("amount"))),
        "_log": ("sum", F.log1p("amount").cast("decimal(20,12)")),
    }
    rows = blockwise(df, [], bases, parts=log.parts)
    n = F.col("_n")
    return rows.withColumns(
        {
            "running_mean_amount": F.when(n > 0, F.col("_amount").cast("double") / n),
            "running_mean_log": F.when(n > 0, F.col("_log").cast("double") / n),
        }
    ).drop("_n", "_amount", "_log")


# ------------------------------------------------------------- recent activity
# Sliding look-backs are computed as a sweep. Every transaction *enters* at its own
# place and *expires* one second after its span has passed; a running sum of +1 / -1
# over both kinds of event is then the number of transactions inside the span.
# Work is linear in the rows, however many of them one span holds.
#
# Distinct partners use the same sum: a transaction adds 1 only if its partner was
# not active in the day before, and takes 1 away at its expiry only if the partner
# did not come back within a day.

_AT, _ORD, _ROW = "_at", "_ord", "_row"
PARTNERS = {"merchants": "merchant_id", "devices": "device_id"}


def _partner_returns(df: DataFrame, key: str, sliced: bool, parts: int | None = None) -> DataFrame:
    """Seconds of the previous and the next transaction of each (key, partner) pair."""
    out = df
    for name, partner in PARTNERS.items():
        if sliced:
            seconds = F.col("ts_sec")
            previous, following = {f"_prev_{name}": ("max", seconds)}, {f"_next_{name}": ("min", seconds)}
            out = blockwise(out, [key, partner], previous, after=following, parts=parts)
        else:
            pair = W.partitionBy(key, partner).orderBy(SEQ)
            out = out.select(
                "*",
                F.lag("ts_sec").over(pair).alias(f"_prev_{name}"),
                F.lead("ts_sec").over(pair).alias(f"_next_{name}"),
            )
    return out


def _deltas(spans: dict[str, int], span: str | None, counts: dict[str, Column]) -> list[Column]:
    """Delta columns of one kind of event; ``span`` is None for an entering row."""
    out = [
        (counts["n"] if span in (None, s) else F.lit(0).cast("bigint")).alias(f"_d_{s}") for s in spans
    ]
    daily = span in (None, "24h")
    for p in PARTNERS:
        out.append((counts[p] if daily else F.lit(0).cast("bigint")).alias(f"_d_{p}"))
    zero = F.lit(0).cast("decimal(20,6)")
    out.append((counts["amount"] if daily else zero).cast("decimal(30,6)").alias("_d_amount"))
    return out


def customer_activity(
    log: TxnLog, df: DataFrame, key: str = "customer_id", spans: dict[str, int] = SPANS
) -> DataFrame:
    """History and recent activity of the row's customer before the row.

    Adds customer_history_count, _mu_c, _sd_c, _last_c, _sum_c (mean, deviation,
    last second, summed amount), txn_count_<span>, distinct_merchants_24h,
    distinct_devices_24h and amount_sum_24h. Ordinary customers take one shuffle.
    """
    ordinary, heavy = log.split(df, key)
    # count() of a column skips the expiry events, whose row is null
    aggs: Aggs = {
        "customer_history_count": ("count", F.col("_x")),
        "_mu_c": ("mean", F.col("_x")),
        "_sd_c": ("sd", F.col("_x")),
        "_last_c": ("max", F.col("_ts")),
        "_sum_c": ("sum", F.col("_a")),
        **{f"txn_count_{s}": ("sum", F.col(f"_d_{s}")) for s in spans},
        **{f"distinct_{p}_24h": ("sum", F.col(f"_d_{p}")) for p in PARTNERS},
        "_amount_24h": ("sum", F.col("_d_amount")),
    }
    # one shuffle on the key; the pair windows, the explode and the sweep reuse it
    rows = _partner_returns(by_key(ordinary, log.parts, key), key, sliced=False)
    payload = [c for c in df.columns if c != key]
    expire = {
        "n": F.lit(-1).cast("bigint"),
        "amount": -C.exact(F.col("amount")),
        **{p: -_gone_after_a_day(p) for p in PARTNERS},
    }
    events = F.array(
        _event(F.col("ts_sec"), F.col(SEQ), payload, True, _deltas(spans, None, _entering())),
        *[
            _event(F.col("ts_sec") + seconds + 1, F.lit(-1).cast("bigint"), payload, False, _deltas(spans, s, expire))
            for s, seconds in spans.items()
        ],
    )
    swept = rows.select(key, F.explode(events).alias("_e")).select(key, "_e.*")
    before = W.partitionBy(key).orderBy(_AT, _ORD).rowsBetween(W.unboundedPreceding, -1)
    one = {
        "count": lambda x: F.count(x).over(before),
        "sum": lambda x: F.coalesce(F.sum(x).over(before), F.lit(0)),
        "max": lambda x: F.max(x).over(before),
        "mean": lambda x: F.avg(x).over(before),
        "sd": lambda x: F.coalesce(F.stddev_pop(x).over(before), F.lit(0.0)),
    }
    out = swept.select("*", *[one[kind](x).alias(name) for name, (kind, x) in aggs.items()])
    out = _finished(out, df.columns, key, aggs)
    if heavy is not None:
        out = out.unionByName(_heavy_activity(heavy, key, spans, payload, aggs, df.columns, log.parts))
    return out


def _entering() -> dict[str, Column]:
    def first_in_a_day(p: str) -> Column:
        back = F.col(f"_prev_{p}") >= F.col("ts_sec") - DAY
        return F.when(back, 0).otherwise(1).cast("bigint")

    return {
        "n": F.lit(1).cast("bigint"),
        "amount": C.exact(F.col("amount")),
        **{p: first_in_a_day(p) for p in PARTNERS},
    }


def _gone_after_a_day(p: str) -> Column:
    returns = F.col(f"_next_{p}") <= F.col("ts_sec") + DAY
    return F.when(returns, 0).otherwise(1).cast("bigint")


def _event(at: Column, order: Column, payload: list[str], enters: bool, deltas: list[Column]) -> Column:
    row = F.struct(*payload)
    return F.struct(
        at.alias(_AT),
        order.alias(_ORD),
        F.when(F.lit(enters), row).alias(_ROW),
        F.when(F.lit(enters), F.log1p("amount")).alias("_x"),
        F.when(F.lit(enters), F.col("ts_sec")).alias("_ts"),
        F.when(F.lit(enters), C.exact(F.col("amount"))).alias("_a"),
        *deltas,
    )


def _finished(swept: DataFrame, columns: list[str], key: str, aggs: Aggs) -> DataFrame:
    kept = swept.filter(F.col(_ROW).isNotNull())
    names = [n for n in aggs if n != "_amount_24h"]
    return kept.select(
        *[F.col(key) if c == key else F.col(f"{_ROW}.{c}").alias(c) for c in columns],
        *[F.col(n) for n in names],
        F.col("_amount_24h").cast("double").alias("amount_sum_24h"),
    ).withColumn("_sum_c", F.col("_sum_c").cast("double"))


def _heavy_activity(
    heavy: DataFrame, key: str, spans: dict[str, int], payload: list[str], aggs: Aggs, columns: list[str],
    parts: int | None = None,
) -> DataFrame:
    """The same sweep for keys that do not fit one task: expiries of one second are
    added up first, and the events are put in blocks of their own order."""
    rows = materialise(_partner_returns(heavy, key, sliced=True, parts=parts), "heavy")  # read twice below
    entering = rows.select(
        key, F.inline(F.array(_event(F.col("ts_sec"), F.col(SEQ), payload, True, _deltas(spans, None, _entering()))))
    )
    per_second = rows.groupBy(key, "ts_sec").agg(
        (-F.count(F.lit(1))).alias("n"),
        (-F.sum(C.exact(F.col("amount")))).alias("_amount"),
        *[(-F.sum(_gone_after_a_day(p))).alias(p) for p in PARTNERS],
    )
    counts = {"n": F.col("n"), "amount": F.col("_amount"), **{p: F.col(p) for p in PARTNERS}}
    shape = entering.schema
    nothing = [F.lit(None).cast(shape[c].dataType).alias(c) for c in (_ROW, "_x", "_ts", "_a")]
    expiries = [
        F.struct(
            (F.col("ts_sec") + seconds + 1).alias(_AT), F.lit(-1).cast("bigint").alias(_ORD), *nothing,
            *_deltas(spans, s, counts),
        )
        for s, seconds in spans.items()
    ]
    expiring = per_second.select(key, F.inline(F.array(*expiries)))
    events = ordered_table(entering.unionByName(expiring), _AT, _ORD, key, seq="_sweep")
    return _finished(_sliced_history(events, [key], aggs, "_sweep", parts), columns, key, aggs)
