"""Ranking, calibration, alert and cohort metrics.

Curves are built from one row per distinct score. Decisions carry scores rounded
to 4 decimals, so that table has at most 10,001 rows (per cohort) however many
transactions were scored, and a window over it is safe. ``scores_at`` states the
rounding; raw scores are rounded to ``digits`` places first, 6 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnrisk.functions import columns as C
from txnrisk.operators.ordering import SEQ, blockwise, spread_join, value_counts_running
from txnrisk.operators.splits import first_time_flags
from txnrisk.settings import DEFAULTS
from txnrisk.sources.scratch import materialise


def scores_at(df: DataFrame, score: str, by: list[str] | None = None, label: str = "is_fraud", digits: int = 4) -> DataFrame:
    """One row per (group, distinct score): rows ``n`` and positives ``pos``."""
    if digits > 6:
        raise ValueError("at most 6 decimals: the curve table must stay small")
    return (
        df.groupBy(*(by or []), F.round(score, digits).alias("score"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    )


def _curve(counts: DataFrame, by: list[str]) -> DataFrame:
    """Points of the curve from one row per (group, distinct score) with n and pos."""
    down = W.partitionBy(*by).orderBy(F.desc("score"))
    upto = down.rowsBetween(W.unboundedPreceding, 0)
    all_rows = W.partitionBy(*by)
    points = counts.select(
        *by, "score", "n", "pos",
        F.sum("n").over(upto).alias("alerted"),
        F.sum("pos").over(upto).alias("caught"),
        F.sum("pos").over(all_rows).alias("positives"),
        F.sum("n").over(all_rows).alias("rows"),
    )
    return points.withColumns(
        {
            "precision": F.col("caught") / F.col("alerted"),
            "recall": F.when(F.col("positives") > 0, F.col("caught") / F.col("positives")),
        }
    )


def curve_points(df: DataFrame, score: str, by: list[str] | None = None, label: str = "is_fraud", digits: int = 4) -> DataFrame:
    """Precision and recall when everything scored at or above a value is alerted."""
    return _curve(scores_at(df, score, by, label, digits), by or [])


def pr_curve(df: DataFrame, score: str = "fraud_probability", digits: int = 4) -> DataFrame:
    return curve_points(df, score, digits=digits).select("score", "alerted", "caught", "precision", "recall")


def ranking_metrics(
    df: DataFrame, score: str, by: list[str] | None = None, label: str = "is_fraud", digits: int = 4
) -> DataFrame:
    """Average precision (step form) and area under the ROC curve (ties count half)
    per group; null for a group with one class."""
    return _ranking(curve_points(df, score, by, label, digits), by or [])


def _ranking(pts: DataFrame, by: list[str]) -> DataFrame:
    neg = F.col("n") - F.col("pos")
    negatives = F.col("rows") - F.col("positives")
    # negatives ranked strictly below this score, and half of the tied ones
    below = negatives - (F.col("alerted") - F.col("caught"))
    both = (F.max("positives") > 0) & (F.max(negatives) > 0)
    return pts.groupBy(*by).agg(
        F.when(both, F.sum(F.col("pos") * F.col("precision")) / F.max("positives")).alias("pr_auc"),
        F.when(
            both, F.sum(F.col("pos") * (below + neg / 2.0)) / (F.max("positives") * F.max(negatives))
        ).alias("roc_auc"),
    )


def exact_ranking_metrics(df: DataFrame, score: str, label: str = "is_fraud") -> DataFrame:
    """``ranking_metrics`` of all rows on the scores as they are: the counts per distinct score stay spread over blocks."""
    rows = df.select(F.col(score).cast("double").alias("score"), F.col(label).cast("bigint").alias("_y"))
    pts = value_counts_running(rows, "score", {"n": F.lit(1).cast("bigint"), "pos": F.col("_y")})
    size, positives = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    both = F.lit(0 < positives < size)
    precision = (F.lit(positives) - F.col("before_pos")) / (F.lit(size) - F.col("before_n"))
    below = F.col("before_n") - F.col("before_pos") + (F.col("n") - F.col("pos")) / 2.0
    pairs = float(positives) * float(size - positives)
    return pts.agg(
        F.when(both, F.sum(F.col("pos") * precision) / F.lit(max(1, positives))).alias("pr_auc"),
        F.when(both, F.sum(F.col("pos") * below) / F.lit(max(1.0, pairs))).alias("roc_auc"),
    )


def confusion(df: DataFrame, alert: Column, label: str = "is_fraud") -> DataFrame:
    y = F.col(label) == 1
    counts = df.agg(
        F.count_if(~y & ~alert).alias("tn"),
        F.count_if(~y & alert).alias("fp"),
        F.count_if(y & ~alert).alias("fn"),
        F.count_if(y & alert).alias("tp"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns(
        {"f1": F.round(ratio(2 * p * r, p + r), 4), "precision": F.round(p, 4), "recall": F.round(r, 4)}
    )


def budget_size(n_total: int, budget_pct: float) -> int:
    return max(1, int(round(n_total * budget_pct / 100.0)))


def at_budget(
    df: DataFrame, budget_pcts: list[float], score: str = "fraud_probability",
    n_total: int | None = None, label: str = "is_fraud", digits: int = 4,
) -> DataFrame:
    """Recall and precision when the top share of rows by score is alerted.

    Equal scores are taken in row order. ``n_total`` sets the size of the budget
    and is the whole table even when ``df`` is a cohort of it. The rows of the one
    score the budget ends in are counted along their blocks, never gathered.
    """
    counts = materialise(scores_at(df, score, label=label, digits=digits), "counts")
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = [(float(pct), min(budget_size(n if n_total is None else n_total, pct), n)) for pct in budget_pcts]
    budgets = F.array(*[F.struct(F.lit(pct).alias("budget_pct"), F.lit(k).cast("bigint").alias("k")) for pct, k in sizes])
    start = F.col("alerted") - F.col("n")
    edges = _curve(counts, []).select("*", F.inline(budgets)).filter((start < F.col("k")) & (F.col("alerted") >= F.col("k")))
    edges = materialise(
        edges.select("budget_pct", "k", "positives", (F.col("k") - start).alias("_take"), (F.col("caught") - F.col("pos")).alias("_above"), F.col("score").alias("_score")),
        "edges",
    )  # one row per budget
    tied = df.select(SEQ, F.col(label).alias("y"), F.round(score, digits).alias("_s"))
    tied = tied.join(F.broadcast(edges.select(F.col("budget_pct"), "_score", "_take")), F.col("_s") == F.col("_score"))
    ranked = blockwise(tied, ["budget_pct"], {"_i": ("sum", F.lit(1).cast("bigint"))})
    caught = ranked.filter(F.col("_i") < F.col("_take")).groupBy("budget_pct").agg(F.sum("y").alias("_tied"))
    every = df.sparkSession.createDataFrame(sizes, "budget_pct double, alerts bigint")
    out = every.join(F.broadcast(edges.drop("k")), "budget_pct", "left").join(F.broadcast(caught), "budget_pct", "left").select(
        "budget_pct", "alerts",
        (F.coalesce("_above", F.lit(0)) + F.coalesce("_tied", F.lit(0))).cast("bigint").alias("tp"),
        F.coalesce("positives", F.lit(0)).cast("bigint").alias("positives"),
    )
    return out.select(
        "budget_pct",
        "alerts",
        (F.col("tp") / F.greatest(F.col("positives"), F.lit(1))).alias("recall"),
        F.when(F.col("alerts") > 0, F.col("tp") / F.col("alerts")).otherwise(F.lit(0.0)).alias("precision"),
        "tp",
        (F.col("alerts") - F.col("tp")).alias("fp"),
    )


# ------------------------------------------------------------------ calibration
def brier(p: str = "fraud_probability", label: str = "is_fraud") -> Column:
    d = F.col(p) - F.col(label)
    return F.avg(d * d)


def _bin(p: Column, bins: int, close_last: bool) -> Column:
    """Equal-width bin by comparing with the bin edges; null outside every bin."""
    upper = F.size(F.filter(F.array(*[F.lit(i / bins) for i in range(1, bins)]), lambda e: e <= p))
    inside = (p >= 0) & ((p <= 1.0) if close_last else (p < 1.0))
    return F.when(inside, upper)


def _binned(df: DataFrame, p: str, label: str, bins: int, close_last: bool) -> DataFrame:
    return (
        df.groupBy(_bin(F.col(p), bins, close_last).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"), F.avg(p).alias("predicted_mean"), F.avg(label).alias("observed_mean"))
    )


def calibration_error(df: DataFrame, p: str = "fraud_probability", label: str = "is_fraud", bins: int = 10) -> DataFrame:
    """Expected calibration error over half-open bins: a probability of exactly 1 is
    counted as a row but falls in no bin."""
    gap = F.abs(F.col("predicted_mean") - F.col("observed_mean"))
    weighted = F.sum(F.when(F.col("bin").isNotNull(), F.col("count") * gap))
    binned = _binned(df, p, label, bins, False)
    return binned.agg(F.round(F.coalesce(weighted, F.lit(0.0)) / F.sum("count"), 5).alias("ece"))


def reliability_curve(df: DataFrame, p: str = "fraud_probability", label: str = "is_fraud", bins: int = 10) -> DataFrame:
    """All bins, the last one closed, empty ones with a zero count."""
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    found = _binned(df, p, label, bins, True)
    return every.join(F.broadcast(found), "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def reliability_summary(df: DataFrame, p: str = "fraud_probability", label: str = "is_fraud", bins: int = 10) -> DataFrame:
    gap = F.abs(F.col("predicted_mean") - F.col("observed_mean"))
    curve = _binned(df, p, label, bins, True)
    total = F.sum("count")
    ece = F.sum(F.when(F.col("bin").isNotNull(), F.col("count") * gap)) / total
    return curve.agg(F.round(ece, 5).alias("ece"), total.alias("rows"))


# ------------------------------------------------------------------ cohorts
def cohort_flags(scored: DataFrame, train_customers: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """unseen / known customer and, with features, the first-time flags.

    ``train_customers`` is joined by key and block, not collected, so a frequent customer is no task of its own.
    """
    seen = train_customers.select("customer_id").distinct().withColumn("_seen", F.lit(1))
    out = spread_join(scored, seen, "customer_id")
    out = out.withColumn("known_customer", F.coalesce("_seen", F.lit(0))).drop("_seen")
    out = out.withColumn("unseen_customer", 1 - F.col("known_customer"))
    if features is not None:
        counts = [f"{k}_history_count" for k in ("customer", "device", "merchant")]
        out = out.drop(*counts).join(features.select("transaction_id", *counts), "transaction_id", "left")
    return first_time_flags(out) if "customer_history_count" in out.columns else out


def _cohort_names() -> Column:
    return F.array_compact(
        F.array(
            F.lit("all"),
            F.when(F.col("known_customer") == 1, "known_customers"),
            F.when(F.col("unseen_customer") == 1, "unseen_customers"),
            F.when(F.col("first_time_customer") == 1, "first_time_customers"),
            F.when(F.col("first_time_device") == 1, "new_devices"),
            F.when(F.col("first_time_merchant") == 1, "new_merchants"),
        )
    )


def cohort_cube(flagged: DataFrame) -> DataFrame:
    """Counts per (cohorts, score kind, score): one scan of the rows, from which every figure of the cohorts follows.
    At most 2^5 sets of cohorts x 2 x 10,001 scores."""
    legit = F.col("is_fraud") == 0
    gap = F.col("fraud_probability") - F.col("is_fraud")
    kinds = F.array(
        F.struct(F.lit("p").alias("kind"), F.round("fraud_probability", 4).alias("score")),
        F.struct(F.lit("novelty").alias("kind"), F.round("novelty_score", 4).alias("score")),
    )
    rows = flagged.select(
        _cohort_names().alias("cohorts"), F.col("is_fraud").cast("bigint").alias("y"), (gap * gap).alias("loss"),
        legit.cast("bigint").alias("legit"), (legit & (F.col("novelty_score") >= 0.9)).cast("bigint").alias("novel"), F.inline(kinds),
    )
    return rows.groupBy("cohorts", "kind", "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.sum("loss").alias("loss"), F.sum("legit").alias("legit"), F.sum("novel").alias("novel")
    )


def cohort_report(flagged: DataFrame, budget_pct: float = 2.0) -> DataFrame:
    """One row per non-empty cohort; ranking metrics of a single-class cohort are null. The rows are read for the cube,
    and those of the one score in which a cohort's budget ends for their order."""
    cube = materialise(cohort_cube(flagged), "cube")
    total = cube.filter("kind = 'p'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    k = budget_size(total, budget_pct)
    sums = [F.sum(c).alias(c) for c in ("n", "pos", "loss", "legit", "novel")]
    counts = cube.withColumn("cohort", F.explode("cohorts")).groupBy("cohort", "kind", "score").agg(*sums)
    of_p, of_novelty = (counts.filter(F.col("kind") == kind) for kind in ("p", "novelty"))
    base = of_p.groupBy("cohort").agg(
        F.sum("n").alias("n_rows"), F.sum("pos").alias("n_fraud"), (F.sum("loss") / F.sum("n")).alias("brier"),
        (F.sum("novel") / F.nullif(F.sum("legit"), F.lit(0))).alias("false_novelty_rate"),
    )
    pts = _curve(of_p, ["cohort"])
    by_novelty = _ranking(_curve(of_novelty, ["cohort"]), ["cohort"]).select("cohort", F.col("roc_auc").alias("novelty_auroc"))
    rows = flagged.select(F.explode(_cohort_names()).alias("cohort"), SEQ, "fraud_probability", "is_fraud")
    budget = _group_budget(rows, pts.withColumn("_k", F.lit(k).cast("bigint")), "cohort")
    both = (F.col("n_fraud") > 0) & (F.col("n_fraud") < F.col("n_rows"))
    joined = base.join(_ranking(pts, ["cohort"]), "cohort").join(by_novelty, "cohort").join(budget, "cohort")
    return joined.select(
        "cohort",
        "n_rows",
        "n_fraud",
        F.round(F.col("n_fraud") / F.col("n_rows"), 4).alias("fraud_rate"),
        F.round("pr_auc", 4).alias("pr_auc"),
        F.round("roc_auc", 4).alias("roc_auc"),
        F.when(both, F.round("brier", 4)).alias("brier"),
        F.round("novelty_auroc", 4).alias("novelty_auroc"),
        F.round(F.col("tp") / F.greatest("n_fraud", F.lit(1)), 4).alias("recall_at_budget"),
        F.round(F.col("tp") / F.least(F.lit(k), F.col("n_rows")), 4).alias("precision_at_budget"),
        F.round("false_novelty_rate", 4).alias("false_novelty_rate"),
    )


def _group_budget(rows: DataFrame, pts: DataFrame, by: str) -> DataFrame:
    """(by, tp): positives among the first ``_k`` rows of every group by score, then row order."""
    start = F.col("alerted") - F.col("n")
    whole = F.sum(F.when(F.col("alerted") <= F.col("_k"), F.col("pos")))
    above = pts.groupBy(by).agg(F.coalesce(whole, F.lit(0)).alias("whole"))
    edge = pts.filter((start < F.col("_k")) & (F.col("alerted") > F.col("_k"))).select(
        F.col(by).alias("_group"), F.col("score").alias("_score"), (F.col("_k") - start).alias("_take")
    )
    tied = rows.join(
        F.broadcast(edge),  # one row per group at most
        (F.col(by) == F.col("_group")) & (F.round("fraud_probability", 4) == F.col("_score")),
    ).select(by, SEQ, "is_fraud", "_take")
    ranked = blockwise(tied, [by], {"_i": ("sum", F.lit(1).cast("bigint"))})
    part = ranked.filter(F.col("_i") < F.col("_take")).groupBy(by).agg(F.sum("is_fraud").alias("part"))
    return above.join(part, by, "left").select(by, (F.col("whole") + F.coalesce("part", F.lit(0))).cast("bigint").alias("tp"))


def alert_metrics(scored: DataFrame, status: str = "budget_status") -> DataFrame:
    alert = F.col(status) == "alert"
    hit = alert & (F.col("is_fraud") == 1)
    counts = scored.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(alert).alias("alerts_generated"),
        F.count_if(alert & (F.col("risk_band") == "high-risk")).alias("high_risk_alerts"),
        F.count_if(alert & (F.col("risk_band") == "review")).alias("review_alerts"),
        F.count_if(F.col("risk_band") == "monitor").alias("monitor_logged"),
        F.count_if(hit).alias("_tp"),
        F.count_if(F.col("is_fraud") == 1).alias("_fraud"),
    )
    alerts, tp = F.col("alerts_generated"), F.col("_tp")
    one = F.lit(1)
    return counts.withColumns(
        {
            "alert_rate_pct": F.round(100.0 * alerts / F.greatest("total_transactions", one), 4),
            "alert_precision": F.when(alerts > 0, F.round(tp / alerts, 4)),
            "alert_recall": F.when(alerts > 0, F.round(tp / F.greatest("_fraud", one), 4)),
            "alerts_per_caught_fraud": F.when(alerts > 0, F.round(alerts / F.greatest(tp, one), 2)),
        }
    ).drop("_tp", "_fraud")


FIRST_TIME = ["first_time_customer", "first_time_device", "first_time_merchant", "first_time_any"]


def first_time_false_positives(flagged: DataFrame, status: str = "budget_status") -> DataFrame:
    kinds = F.array_compact(F.array(*[F.when(F.col(f) == 1, f) for f in FIRST_TIME]))
    legit = flagged.filter(F.col("is_fraud") == 0).select(
        F.explode(kinds).alias("kind"), (F.col(status) == "alert").alias("alerted")
    )
    found = legit.groupBy("kind").agg(
        F.count(F.lit(1)).alias("legit_first_time_rows"), F.count_if("alerted").alias("fp_alerts")
    )
    every = flagged.sparkSession.createDataFrame([(f,) for f in FIRST_TIME], "kind string")
    rows = F.coalesce("legit_first_time_rows", F.lit(0))
    alerts = F.coalesce("fp_alerts", F.lit(0))
    return every.join(F.broadcast(found), "kind", "left").select(
        "kind",
        rows.alias("legit_first_time_rows"),
        alerts.alias("fp_alerts"),
        F.when(rows > 0, F.round(alerts / rows, 4)).otherwise(F.lit(0.0)).alias("false_positive_rate"),
    )


def seen_unseen_split(flagged: DataFrame) -> DataFrame:
    """Ranking quality for seen and unseen customers; the 2 % budget is taken from the
    group itself. Single-class groups are left out."""
    group = ["unseen_customer"]
    counts = materialise(scores_at(flagged, "fraud_probability", group), "counts")
    sizes = counts.groupBy(*group).agg(F.sum("n").alias("rows"), F.sum("pos").alias("fraud"))
    # bround: halves go to the even number, as in the definition of k
    k = F.least(F.greatest(F.bround(F.col("rows") * F.lit(0.02)).cast("bigint"), F.lit(1)), F.col("rows"))
    sizes = sizes.withColumn("_k", k).filter((F.col("fraud") > 0) & (F.col("fraud") < F.col("rows")))
    pts = _curve(counts, group)
    budget = _group_budget(flagged, pts.join(F.broadcast(sizes.select(*group, "_k")), group), group[0])
    joined = sizes.join(budget, group).join(_ranking(pts, group), group)
    return joined.select(
        F.when(F.col("unseen_customer") == 1, "Unseen").otherwise("Seen").alias("cohort"),
        "rows",
        "fraud",
        F.round("pr_auc", 3).alias("pr_auc"),
        F.round("roc_auc", 3).alias("roc_auc"),
        F.round(F.col("tp") / F.col("fraud"), 3).alias("recall_at_2pct"),
    )


def cohort_table(report: DataFrame, false_positives: DataFrame) -> DataFrame:
    """Wide summary: three cohorts, then one row per first-time kind."""
    main = report.filter(F.col("cohort").isin("all", "known_customers", "unseen_customers")).select(
        "cohort", "pr_auc", "roc_auc", "recall_at_budget"
    )
    first = false_positives.select(
        F.col("kind").alias("cohort"),
        F.col("kind").alias("first_time_kind"),
        F.col("false_positive_rate").alias("fpr_first_time"),
    )
    return main.unionByName(first, allowMissingColumns=True)


def leakage_audit(full: DataFrame, prefix: DataFrame, columns: list[str], digits: int = 8) -> DataFrame:
    """Features computed with and without later rows, compared on the rows of the
    shorter run: mismatches per column. Anything but zero means a leak."""
    def comparable(df: DataFrame, c: str) -> Column:
        return F.round(F.col(c).cast("double"), digits).alias(c)

    a = full.select("transaction_id", *[comparable(full, c) for c in columns]).alias("a")
    b = prefix.select("transaction_id", *[comparable(prefix, c) for c in columns]).alias("b")
    both = a.join(b, "transaction_id")
    counts = both.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(c) for c in columns],
    )
    return counts.unpivot(["rows"], columns, "feature", "mismatches")


def grid_at_budget(df: DataFrame, score: str = "fraud_probability") -> DataFrame:
    return at_budget(df, list(DEFAULTS.budget_grid), score)


def daily_alerts(scored: DataFrame, status: str = "budget_status") -> DataFrame:
    day = C.day_number(F.col("ts_sec")).alias("day")
    return scored.filter(F.col(status) == "alert").groupBy(day).agg(F.count(F.lit(1)).alias("alerts"))
