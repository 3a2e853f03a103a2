"""Amount and risk baselines fitted on training rows only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import columns as C
from txnrisk.operators.asof import TxnLog, history
from txnrisk.operators.quantiles import exact_quantiles
from txnrisk.settings import DEFAULTS, STRATA, TIERS

MIN_SD = 0.05  # fixed value: stands in for a deviation of exactly zero
EMPTY_SD = 0.3  # fixed value: deviation assumed when nothing was fitted


@dataclass(frozen=True)
class Priors:
    """Fitted baselines: at most 20 segment rows, the global row and seven edges."""

    segments: list[tuple[str, str, float, float, int, float]]
    mean: float
    sd: float
    n: int
    risk: float
    edges: list[float]

    def lookup(self, stratum: str, tier: str) -> tuple[float, float, float]:
        """(mean, sd, risk) of the closest fitted segment."""
        table = {(s, t): (m, d, r) for s, t, m, d, _, r in self.segments}
        for key in ((stratum, tier), (stratum, "any"), ("any", tier)):
            if key in table:
                return table[key]
        return self.mean, self.sd, self.risk

    def table(self, spark) -> DataFrame:
        """Resolved look-up table: one row for each of the 12 stratum and tier pairs."""
        rows = [(s, t, *self.lookup(s, t)) for s in STRATA for t in TIERS]
        return spark.createDataFrame(rows, "stratum string, tier string, mu_seg double, sd_seg double, risk_seg double")


NO_PRIORS = Priors([], 0.0, EMPTY_SD, 0, 0.0, [])


def with_strata(log: TxnLog) -> DataFrame:
    """History stratum of the customer and tier of the merchant before each row."""
    rows = history(log, log.rows, "customer_id", {"_n_c": ("count", None)})
    rows = history(log, rows, "merchant_id", {"_n_m": ("count", None)})
    return rows.withColumns(
        {"stratum": C.stratum(F.col("_n_c")), "tier": C.merchant_tier(F.col("_n_m"))}
    ).drop("_n_c", "_n_m")


def segment_cube(stratified: DataFrame, smoothing: float = DEFAULTS.smoothing) -> DataFrame:
    """Baselines of every stratum and tier pair, of each alone, and of all rows."""
    x = F.log1p("amount")
    cube = stratified.cube("stratum", "tier").agg(
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("sd"),
        F.count(F.lit(1)).alias("n"),
        F.sum("is_fraud").alias("frauds"),
    )
    # the all-rows line of the cube carries the base rate; it is one row
    base = F.broadcast(
        cube.filter(F.col("stratum").isNull() & F.col("tier").isNull()).select(
            (F.col("frauds") / F.col("n")).alias("base"), F.lit("any").alias("_j")
        )
    )
    named = cube.withColumns(
        {"stratum": F.coalesce("stratum", F.lit("any")), "tier": F.coalesce("tier", F.lit("any")), "_j": F.lit("any")}
    )
    return named.join(base, "_j").select(
        "stratum",
        "tier",
        "mean",
        F.when(F.col("sd") == 0, MIN_SD).otherwise(F.col("sd")).alias("sd"),
        "n",
        ((F.col("frauds") + smoothing * F.col("base")) / (F.col("n") + smoothing)).alias("risk"),
    )


def global_prior(train: DataFrame) -> DataFrame:
    x = F.log1p("amount")
    return train.agg(
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
        F.when(F.stddev_pop(x) > 0, F.stddev_pop(x)).otherwise(MIN_SD).alias("sd"),
        F.count(F.lit(1)).alias("n"),
        (F.coalesce(F.sum("is_fraud"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("risk"),
    )


def amount_octiles(train: DataFrame) -> list[float]:
    """Seven inner edges of the log amount."""
    x = train.select(F.log1p("amount").alias("x"))
    return exact_quantiles(x, "x", [i / 8 for i in range(1, 8)])


def fit_priors(train: TxnLog) -> Priors:
    segments = [tuple(r) for r in segment_cube(with_strata(train)).collect()]  # 20 rows at most
    g = global_prior(train.rows).first()
    edges = amount_octiles(train.rows) if g.n else []
    return Priors(segments, g.mean, g.sd, g.n, g.risk, edges)


def segment_lookup(df: DataFrame, priors: Priors) -> DataFrame:
    """Add mu_seg, sd_seg and risk_seg to rows holding ``stratum`` and ``tier``."""
    table = priors.table(df.sparkSession)
    return df.join(F.broadcast(table), ["stratum", "tier"], "left")
