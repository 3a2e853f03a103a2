"""Behavioural novelty: anomaly scores and their rank among legitimate traffic."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.operators.metrics import exact_ranking_metrics
from txnrisk.operators.ordering import spread_join, value_counts_running
from txnrisk.settings import DEFAULTS, NOVELTY_FEATURES
from txnrisk.sources.scratch import materialise

# ------------------------------------------------------------------ ECDF
HUGE = 1e9  # fixed value: stands in for infinite scores


def finite(x: Column) -> Column:
    inf = F.lit(float("inf"))
    return (
        F.when(x.isNull() | F.isnan(x), 0.0).when(x == inf, HUGE).when(x == -inf, -HUGE).otherwise(x)
    )


def fit_ecdf(reference: DataFrame, value: str) -> DataFrame:
    """Reference distribution: one row per distinct score with its count."""
    return reference.select(finite(F.col(value)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("ref"))


def ecdf_table(reference: DataFrame, value: str) -> DataFrame:
    """Distinct reference scores with the number of reference rows at or below each."""
    counts = value_counts_running(fit_ecdf(reference, value), "v", {"ref": F.col("ref")})
    return counts.select("v", "ref", (F.col("before_ref") + F.col("ref")).alias("at_or_below"))


def ecdf_rank(
    df: DataFrame, value: str, ecdf: DataFrame, name: str = "novelty", orientation: str = "rank"
) -> DataFrame:
    """Share of reference rows at or below each score (exact).

    ``orientation='rank'``: high means atypical. ``'survival'`` gives one minus
    that share. Query scores join the reference as zero-count values, so one
    ordered pass over distinct scores ranks them all.
    """
    rows = df.withColumn("_v", finite(F.col(value)))
    asked = rows.select(F.col("_v").alias("v")).distinct().withColumn("ref", F.lit(0).cast("bigint"))
    counts = value_counts_running(ecdf.select("v", "ref").unionByName(asked), "v", {"ref": F.col("ref")})
    total = ecdf.agg(F.sum("ref")).first()[0]
    if not total:
        raise ValueError("the reference distribution is empty")
    share = (F.col("before_ref") + F.col("ref")) / F.lit(total)
    if orientation == "survival":
        share = 1.0 - share
    return spread_join(rows, counts.select(F.col("v").alias("_v"), share.alias(name)), "_v").drop("_v")


MOST_BINS = 1 << 16


@dataclass(frozen=True)
class RankIndex:
    """A static index of a reference distribution, for rows that can't be ranked together.

    The distinct reference scores lie in bins of equally many; ``edges`` holds the first score of each bin (at most
    ``MOST_BINS``, whatever the reference), ``bins`` per bin the sorted scores with the number of reference
    rows at or below each. A score finds its bin in the edges, the bin by an equality join, and its place by halving,
    so the share is the one that ``ecdf_rank`` gives, and a stream can be joined with the index.
    """

    edges: list[float]
    bins: DataFrame
    total: int
    steps: int  # halvings that the largest bin takes

    @classmethod
    def fit(cls, ecdf: DataFrame, bin_size: int = 1024) -> RankIndex:
        sums = {"ref": F.col("ref"), "one": F.lit(1).cast("bigint")}
        counts = value_counts_running(ecdf, "v", sums)
        total, distinct = ecdf.agg(F.sum("ref"), F.count(F.lit(1))).first()
        if not total:
            raise ValueError("the reference distribution is empty")
        n = min(MOST_BINS, -(-distinct // bin_size))
        number = F.expr(f"div(before_one * {n}, {distinct})").cast("int")
        at = F.struct("v", (F.col("before_ref") + F.col("ref")).alias("n"))
        grouped = counts.groupBy(number.alias("_bin")).agg(F.array_sort(F.collect_list(at)).alias("a"), F.min("before_ref").alias("_below"))
        table = materialise(
            grouped.select("_bin", "_below", F.col("a.v").alias("_values"), F.col("a.n").alias("_counts")), "ranks"
        )
        edges = [r[0] for r in table.orderBy("_bin").select(F.col("_values")[0]).collect()]
        return cls(edges, table, total, (-(-distinct // n) + 1).bit_length())

    def rank(self, df: DataFrame, value: str, name: str = "novelty", orientation: str = "rank") -> DataFrame:
        edges = np.asarray(self.edges)

        @F.pandas_udf("int")
        def bin_of(x: pd.Series) -> pd.Series:
            return pd.Series(np.maximum(np.searchsorted(edges, x.to_numpy(dtype=float), side="right") - 1, 0).astype("int32"))

        rows = df.withColumn("_v", finite(F.col(value))).withColumn("_bin", bin_of("_v"))
        table = F.broadcast(self.bins) if len(self.edges) * (2 << self.steps) <= 1 << 20 else self.bins
        rows = rows.join(table, "_bin")

        def halved(span: Column, _: Column) -> Column:
            low, high = span["low"], span["high"]
            middle = F.floor((low + high) / 2).cast("int")
            below = F.get("_values", middle) <= F.col("_v")
            return F.struct(
                F.when(low >= high, low).when(below, middle + 1).otherwise(low).alias("low"),
                F.when(low >= high, high).when(below, high).otherwise(middle).alias("high"),
            )

        start = F.struct(F.lit(0).alias("low"), F.size("_values").alias("high"))
        at = F.aggregate(F.sequence(F.lit(1), F.lit(self.steps)), start, halved)["low"]
        below = F.coalesce(F.get("_counts", at - 1), F.col("_below"))
        share = below / F.lit(self.total)
        if orientation == "survival":
            share = 1.0 - share
        return rows.withColumn(name, share).drop("_v", "_bin", "_below", "_values", "_counts")


# ------------------------------------------------------------------ isolation forest
NODE_SCHEMA = "tree int, node int, feature int, threshold double, low int, high int, size int, depth int"


def _expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 2.0)
    value = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Random splits until a node holds one point, equal points, or is ``limit`` deep."""
    nodes: list[list] = []
    todo = [(points, 0, None, None)]
    while todo:
        part, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent][side] = me
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or not len(usable):
            nodes.append([-1, 0.0, -1, -1, len(part), depth])
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        left = part[:, f] <= cut
        if left.all():  # the draw hit the maximum
            cut = float(np.nextafter(high[f], low[f]))
            left = part[:, f] <= cut
        nodes.append([f, cut, -1, -1, len(part), depth])
        todo.append((part[~left], depth + 1, me, 3))
        todo.append((part[left], depth + 1, me, 2))
    return [tuple(n) for n in nodes]


@dataclass(frozen=True)
class _Walk:
    """One tree for walking down: the high child of a node follows its low one, and a leaf is its own low child."""

    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    path: np.ndarray  # depth and expected depth below
    levels: int
    norm: float  # a root's size is what its tree was grown from


def _walks(nodes: pd.DataFrame) -> list[_Walk]:
    out = []
    for _, part in nodes.sort_values(["tree", "node"]).groupby("tree"):
        feature, low, high, size = (part[c].to_numpy() for c in ("feature", "low", "high", "size"))
        inner = feature >= 0
        old = np.concatenate([[0], np.stack([low[inner], high[inner]], axis=1).ravel()])  # new place -> node
        new = np.empty(len(old), np.int64)
        new[old] = np.arange(len(old))
        child = np.where(inner, new[np.where(inner, low, 0)], new)[old]
        path = part["depth"].to_numpy() + _expected_depth(size)
        out.append(_Walk(
            np.where(inner, feature, 0)[old], np.where(inner, part["threshold"].to_numpy(), np.inf)[old], child, path[old],
            int(part["depth"].max()), float(_expected_depth(size[0])),
        ))
    return out


def _deviations(walks: list[_Walk], points: np.ndarray) -> np.ndarray:
    """All rows go down one tree after the other, whose table stays in the processor's cache."""
    share = np.ones((len(points), len(walks)))
    flat, base = points.ravel(), np.arange(len(points)) * points.shape[1]
    for i, t in enumerate(walks):
        at = np.zeros(len(points), np.int64)
        for _ in range(t.levels):
            at = t.low[at] + (flat[base + t.feature[at]] > t.threshold[at])
        if t.norm > 0:
            share[:, i] = t.path[at] / t.norm
    return 2.0 ** -share.mean(axis=1) - 0.5


@dataclass(frozen=True)
class IsolationForest:
    """Node table of the forest; its size depends on trees x sample only."""

    features: list[str]
    nodes: pd.DataFrame
    sample: int

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE_SCHEMA)

    def deviation(self, spark) -> Column:
        """Anomaly axis, higher = more unusual: 2^(-mean of depth / expected) - 0.5, the
        expected depth by the sample of each tree."""
        shared = spark.sparkContext.broadcast(_walks(self.nodes))

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            return pd.Series(_deviations(shared.value, np.nan_to_num(x.to_numpy(dtype=float))))

        return score(F.struct(*[F.col(f).cast("double").alias(f) for f in self.features]))


def fit_isolation_forest(
    df: DataFrame, id_col: str = "transaction_id", features: list[str] = NOVELTY_FEATURES,
    trees: int = 200, sample: int = 4096, seed: int = DEFAULTS.seed,
) -> IsolationForest:
    """Every tree is grown in its own task from a seeded sample of ``sample`` rows,
    drawn for each tree from all rows: by one rule at every size."""
    n = df.count()
    if not n:
        raise ValueError("no rows to fit on")
    size = min(sample, n)
    rate = min(1.0, 1.2 * size / n + 16.0 / n)  # slack, so that a sample is rarely short
    columns = F.struct(*[F.col(f).cast("double").alias(f) for f in features]).alias("x")

    def unit(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), *parts), F.lit(1 << 30)) / F.lit(float(1 << 30))

    # only the trees that drew a row get its features
    places = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), unit(t).alias("place")))
    drawn = df.select(F.explode(F.filter(places, lambda p: p["place"] < rate)).alias("_p"), columns).select("_p.*", "x")
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable").head(size)
        names = [c for c in rows.columns if c not in ("tree", "place")]
        points = np.nan_to_num(rows[names].to_numpy(dtype=float))
        tree = int(key[0])
        grown = _grow(points, np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame(
            [(tree, i, *n) for i, n in enumerate(grown)],
            columns=["tree", "node", "feature", "threshold", "low", "high", "size", "depth"],
        )

    grown = drawn.select("tree", "place", "x.*").groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    return IsolationForest(list(features), grown.toPandas(), size)


# ------------------------------------------------------------------ Gaussian distance
def fit_gaussian(df: DataFrame, features: list[str] = NOVELTY_FEATURES) -> dict[str, tuple[float, float]]:
    row = df.agg(
        *[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in features}


def gaussian_deviation(fit: dict[str, tuple[float, float]]) -> Column:
    """Distance from the mean in standard deviations, features taken as independent."""
    terms = [((F.col(c) - m) / s) ** 2 for c, (m, s) in fit.items() if s > 1e-12]
    return F.sqrt(sum(terms, F.lit(0.0)))


# ------------------------------------------------------------------ comparison
def compare_variants(scored: DataFrame, deviations: dict[str, str], reference: Column) -> DataFrame:
    """Area under the ROC curve of every variant's novelty, ranked among reference rows."""
    out = None
    for variant, column in deviations.items():
        ranked = ecdf_rank(scored, column, fit_ecdf(scored.filter(reference), column))
        part = exact_ranking_metrics(ranked, "novelty").select(
            F.lit(variant).alias("variant"), F.round("roc_auc", 4).alias("novelty_auroc")
        )
        out = part if out is None else out.unionByName(part)
    return out


