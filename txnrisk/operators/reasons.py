"""Why a row scored as it did: contributions, reason families and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.settings import MODEL_FEATURES, REASON_GROUPS

SMALLEST = 1e-4  # fixed value: weaker reasons are not shown


# ------------------------------------------------------------------ linear models
def linear_margin(weights: dict[str, float], intercept: float) -> Column:
    terms = [F.lit(float(w)) * F.col(f).cast("double") for f, w in weights.items()]
    return sum(terms, F.lit(float(intercept)))


def logistic(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def linear_contributions(weights: dict[str, float], means: dict[str, float]) -> Column:
    """Array in feature order: weight times the distance from the feature's mean.
    Together with the margin at the means they add up to the margin of the row."""
    return F.array(
        *[F.lit(float(w)) * (F.col(f).cast("double") - F.lit(float(means[f]))) for f, w in weights.items()]
    )


def feature_means(df: DataFrame, features: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    return {f: float(row[f] or 0.0) for f in features}


def global_importance(df: DataFrame, features: list[str], contributions: str = "contributions") -> DataFrame:
    """Mean absolute contribution of every feature, strongest first."""
    sizes = df.agg(
        *[F.avg(F.abs(F.element_at(contributions, i + 1))).alias(f) for i, f in enumerate(features)]
    )
    return sizes.unpivot([], features, "feature", "mean_abs_contribution").orderBy(
        F.desc("mean_abs_contribution"), "feature"
    )


# ------------------------------------------------------------------ families
def group_sums(features: list[str], contributions: str = "contributions") -> dict[str, Column]:
    """Family totals. A feature that belongs to two families counts in both."""
    at = {f: F.element_at(contributions, i + 1) for i, f in enumerate(features)}
    return {g: sum((at[f] for f in members if f in at), F.lit(0.0)) for g, members in REASON_GROUPS.items()}


# ---- fixed values: reason sentences
def _sentences(c: Column) -> dict[str, Column]:
    up = F.when(c >= 0, "increases risk").otherwise("reduces risk")
    z = F.col("amount_z_shrunk")

    def count(name: str) -> Column:
        return F.col(name).cast("int")

    return {
        "velocity": F.format_string(
            "Velocity %s: %d txns in last 5 min, %d in 30 min, %d in 24h (%s).",
            F.when(c >= 0, "elevated").otherwise("low"),
            count("txn_count_5m"), count("txn_count_30m"), count("txn_count_24h"), up,
        ),
        "amount": F.when(
            z > 0.5,
            F.format_string("Amount is %.1f sd above the historical baseline (z=%.2f) (%s).", F.abs(z), z, up),
        ).when(
            z < -0.5,
            F.format_string("Amount is %.1f sd below the historical baseline (z=%.2f) (%s).", F.abs(z), z, up),
        ).otherwise(F.format_string("Amount close to the historical baseline (z=%.2f) (%s).", z, up)),
        "time": F.format_string(
            "Transaction at %02d:00 %s (%s).",
            count("transaction_hour"), F.when(F.col("is_night") == 1, "(night-time)").otherwise(""), up,
        ),
        "device": F.when(
            F.col("new_device") == 1, F.format_string("The device has not been observed previously (%s).", up)
        ).otherwise(F.format_string("Device seen %d time(s) before; behaviour %s.", count("device_history_count"), up)),
        "merchant": F.when(
            F.col("new_merchant") == 1, F.format_string("The merchant has not been observed previously (%s).", up)
        ).otherwise(
            F.format_string("Merchant seen %d time(s) before; behaviour %s.", count("merchant_history_count"), up)
        ),
        "history": F.when(
            F.col("first_time_customer") == 1,
            F.format_string("First transaction for this customer; using segment-level baseline (%s).", up),
        ).otherwise(
            F.format_string(
                "Customer history: %d prior txns, confidence %.2f (%s).",
                count("customer_history_count"), F.col("customer_history_conf"), up,
            )
        ),
    }


def _effect(c: Column) -> Column:
    return F.when(c >= 0, "increases_risk").otherwise("decreases_risk")


def with_reasons(
    df: DataFrame, features: list[str] = MODEL_FEATURES, k: int = 5, grouped: bool = True,
    contributions: str = "contributions",
) -> DataFrame:
    """Add top_contributing_features, positive_contributors, negative_contributors and
    explanation: the ``k`` strongest families (or single features), strongest first."""
    if grouped:
        sums = group_sums(features, contributions)
        rows = df.withColumns({f"_g_{g}": c for g, c in sums.items()})
        entries = [
            F.struct(
                (-F.abs(F.col(f"_g_{g}"))).alias("size"), F.lit(i).alias("place"), F.lit(g).alias("feature"),
                F.col(f"_g_{g}").alias("value"), _sentences(F.col(f"_g_{g}"))[g].alias("reason"),
            )
            for i, g in enumerate(sums)
        ]

        def reason(e: Column) -> Column:
            return e["reason"]
    else:
        rows = df
        entries = []
        for i, f in enumerate(features):
            c = F.element_at(contributions, i + 1)
            entries.append(
                F.struct((-F.abs(c)).alias("size"), F.lit(i).alias("place"), F.lit(f).alias("feature"), c.alias("value"))
            )

        def reason(e: Column) -> Column:  # written for the features that are shown, not for all
            return F.format_string("contrib %+.3f", e["value"])
    strongest = F.slice(F.array_sort(F.array(*entries)), 1, k)
    shown = F.filter(strongest, lambda e: -e["size"] >= SMALLEST)
    reasons = F.transform(
        shown,
        lambda e: F.struct(
            e["feature"].alias("feature"),
            _effect(e["value"]).alias("effect"),
            F.round(e["value"], 4).alias("contribution"),
            reason(e).alias("reason"),
        ),
    )
    top = F.col("top_contributing_features")
    return (
        rows.withColumn("top_contributing_features", reasons)
        .withColumns(
            {
                "positive_contributors": F.filter(top, lambda r: r["contribution"] > 0),
                "negative_contributors": F.filter(top, lambda r: r["contribution"] < 0),
                "explanation": F.array_join(F.transform(top, lambda r: r["reason"]), "; "),
            }
        )
        .drop(*[f"_g_{g}" for g in REASON_GROUPS])
    )


def one_row_each(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` with ``place`` and ``r``: a row for every reason shown. An inner explode has Spark filter on the length of
    its array first, down at the scan, where all reasons would be worked out once more from expressions written out in full."""
    return df.select(*columns, F.posexplode_outer("top_contributing_features").alias("place", "r")).filter(F.col("place").isNotNull())
