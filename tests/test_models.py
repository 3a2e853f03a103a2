import itertools
import math
import pickle
import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from txnrisk.operators import attribution as A
from txnrisk.operators import models as M
from txnrisk.operators import novelty as N
from txnrisk.operators.ordering import ordered_table

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        a, b, c = rng.gauss(0, 1), float(rng.randrange(4)), rng.random()
        y = int(rng.random() < 1 / (1 + math.exp(2.0 - 1.5 * a - 0.4 * b)))
        rows.append((f"T{i:04d}", i, a, b, c, y))
    df = spark.createDataFrame(rows, "transaction_id string, ts_sec bigint, a double, b double, c double, is_fraud int")
    return ordered_table(df, "ts_sec", "transaction_id", blocks=3).cache()


SMALL = M.TreeParams(forest_trees=8, forest_depth=4, forest_leaf=10, boost_rounds=6, boost_depth=3, boost_leaf=10)


@pytest.fixture(scope="module")
def fitted(table):
    train, val = table.filter("ts_sec < 600"), table.filter("ts_sec >= 600")
    return {
        "logistic": M.fit_logistic(train, FEATURES),
        "forest": M.fit_forest(train, FEATURES, SMALL),
        "boosted": M.fit_boosting(train, val, FEATURES, SMALL),
    }


def test_models_rank_better_than_chance_and_the_best_is_picked(table, fitted):
    result = M.compare_models(fitted, table.filter("ts_sec >= 600"))
    rows = {r.model: r for r in result.table.collect()}
    assert all(r.roc_auc_val > 0.7 for r in rows.values())
    assert result.best == max(rows, key=lambda m: rows[m].pr_auc_val)


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 2 + [(0,)] * 8, "is_fraud int")
    w = M.class_weights(df).first()
    assert (w.pos, w.neg, w.sqrt_weight, w.balanced_pos, w.balanced_neg) == (2, 8, 2.0, 2.5, 0.625)


def test_calibrators_are_monotone_and_the_better_one_is_kept(table, fitted):
    raw = M.with_raw_probability(fitted["boosted"], table)
    best = M.fit_calibrator(raw)
    assert {m for m, _, _ in best.report} == {"platt", "isotonic"}
    assert best.method == min(best.report, key=lambda r: r[1])[0]
    for cal in (M.fit_platt(raw), M.fit_isotonic(raw)):
        points = sorted((r.raw_probability, r.p) for r in cal.transform(raw).collect())
        assert all(0.0 <= p <= 1.0 for _, p in points)
        assert all(y2 >= y1 - 1e-12 for (_, y1), (_, y2) in itertools.pairwise(points))


def test_scores_that_differ_behind_the_sixth_decimal_are_not_tied(spark):
    from txnrisk.operators import metrics

    rows = [(0.1 + i * 1e-9, int(i >= 6)) for i in range(10)]
    df = spark.createDataFrame(rows, "raw_probability double, is_fraud int")
    m = metrics.exact_ranking_metrics(df, "raw_probability").first()
    assert (m.pr_auc, m.roc_auc) == (pytest.approx(1.0), pytest.approx(1.0))
    got = {r.raw_probability: r.p for r in M.fit_isotonic(df).transform(df).collect()}
    assert [got[p] for p, _ in rows] == [float(y) for _, y in rows]
    one_class = metrics.exact_ranking_metrics(df.filter("is_fraud = 0"), "raw_probability").first()
    assert tuple(one_class) == (None, None)
    rng = random.Random(2)
    rough = spark.createDataFrame([(round(rng.random(), 1), rng.randrange(2)) for _ in range(200)], "s double, is_fraud int")
    assert tuple(metrics.exact_ranking_metrics(rough, "s").first()) == pytest.approx(tuple(metrics.ranking_metrics(rough, "s").first()))


def test_isotonic_clips_outside_the_fitted_range(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 0), (0.6, 1), (0.8, 1)], "raw_probability double, is_fraud int")
    ask = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "raw_probability double")
    got = {r.raw_probability: r.p for r in M.fit_isotonic(df).transform(ask).collect()}
    assert got == {0.0: 0.0, 0.5: pytest.approx(0.5), 1.0: 1.0}


@pytest.mark.parametrize("name", ["boosted", "forest"])
def test_tree_contributions_add_up_to_the_margin(spark, table, fitted, name):
    found = A.tree_attribution(spark, fitted[name].stages[-1], len(FEATURES))
    rows = M.with_raw_probability(fitted[name], table).withColumn("x", found.contributions(spark, FEATURES)).collect()
    for r in rows[:200]:
        p = r.raw_probability
        margin = math.log(p / (1 - p)) if name == "boosted" else p
        assert sum(r.x) + found.bias == pytest.approx(margin, abs=1e-9)


def _of_patterns(leaves, patterns, d):
    """Contributions to rows that meet the conditions whose bits are set."""
    points = np.where((np.array(patterns)[:, None] >> np.arange(d)) & 1, 0.5, 2.0)
    return A.contributions_of(A.packed(leaves), points, d)


def test_pattern_values_are_shapley_values():
    leaf = A.Leaf((0, 1, 2), (0.0,) * 3, (1.0,) * 3, (0.3, 0.5, 0.8), 2.0)
    table = _of_patterns([leaf], range(8), 3)

    def worth(coalition, met):
        return leaf.value * math.prod(met[j] if j in coalition else leaf.share[j] for j in range(3))

    for pattern in range(8):
        met = [(pattern >> j) & 1 for j in range(3)]
        for i in range(3):
            gains = []
            for order in itertools.permutations(range(3)):
                before = set(order[: order.index(i)])
                gains.append(worth(before | {i}, met) - worth(before, met))
            assert table[pattern, i] == pytest.approx(sum(gains) / 6)


def test_a_deep_path_is_attributed_without_its_2_to_the_d_patterns():
    d = 26
    rng = np.random.default_rng(1)
    leaf = A.Leaf(tuple(range(d)), (0.0,) * d, (1.0,) * d, tuple(rng.uniform(0.2, 1.0, d)), 2.0)
    asked = np.array([0, 5, (1 << d) - 1])
    got = _of_patterns([leaf], asked, d).sum(axis=1)
    nothing = 2.0 * math.prod(leaf.share)
    assert got == pytest.approx([-nothing, -nothing, 2.0 - nothing], rel=1e-9)


def test_shallow_trees_do_not_keep_the_nodes_of_rows(fitted):
    assert fitted["forest"].stages[-1].getCacheNodeIds()
    assert not fitted["boosted"].stages[-1].getCacheNodeIds()


def test_a_calibration_orders_what_it_reads_only(table, fitted, monkeypatch):
    seen, plain = [], M.half_split
    monkeypatch.setattr(M, "half_split", lambda df, *a: seen.append(set(df.columns)) or plain(df, *a))
    raw = M.with_raw_probability(fitted["boosted"], table)
    best = M.fit_calibrator(raw)
    assert seen == [{"transaction_id", "is_fraud", "raw_probability"}]
    assert {method for method, _, _ in best.report} == {"platt", "isotonic"}


def test_boosting_keeps_the_best_prefix(table):
    """Patience decides how many rounds are tried, and the rounds up to the lowest validation loss are kept."""
    train, val = table.filter("ts_sec < 600"), table.filter("ts_sec >= 600")
    size = M.TreeParams(boost_rounds=40, boost_depth=3, boost_leaf=10, boost_step=0.5, boost_patience=3)
    model = M.fit_boosting(train, val, FEATURES, size).stages[-1]
    every = M.fit_boosting(train, val, FEATURES, replace(size, boost_patience=1000))
    losses = M.fit_boosting(train, train, FEATURES, replace(size, boost_rounds=19)).stages[-1]
    assert losses.getNumTrees == 19  # on its own rows the loss only falls
    held = M._weighted(M.assembled(val, FEATURES), M.class_weights(train).first().sqrt_weight, 1.0)
    found = losses.evaluateEachIteration(held)
    best = min(range(19), key=found.__getitem__) + 1
    assert model.getNumTrees == best < 16
    assert every.stages[-1].getNumTrees == best
    assert model.evaluateEachIteration(held) == pytest.approx(found[:best], rel=1e-9)


def test_packed_leaves_add_up_whatever_the_groups():
    rng = np.random.default_rng(3)
    leaves = []
    for _ in range(200):
        d = int(rng.integers(0, 7))
        names = tuple(int(i) for i in rng.permutation(9)[:d])
        low = rng.normal(-1, 1, d)
        leaves.append(A.Leaf(names, tuple(low), tuple(low + rng.exponential(2, d)), tuple(rng.uniform(0.05, 1, d)), float(rng.normal())))
    points = rng.normal(0, 1, (50, 9))
    together = A.contributions_of(A.packed(leaves), points, 9)
    single = sum(A.contributions_of(A.packed([leaf]), points, 9) for leaf in leaves)
    split = A.contributions_of(A.packed(leaves, 30), points, 9, 30)
    np.testing.assert_allclose(together, single, atol=1e-12)
    np.testing.assert_allclose(split, single, atol=1e-12)


def test_many_rows_share_the_values_of_a_pattern():
    """Rows that outnumber the patterns look their values up, few rows get their own: equal, also for values that aren't numbers."""
    rng = np.random.default_rng(3)
    leaves = []
    for d in (1, 5, 9, 11):
        names = tuple(rng.choice(12, d, replace=False).tolist())
        low = rng.normal(-1, 1, d)
        leaves.append(A.Leaf(names, tuple(low), tuple(np.where(rng.random(d) < 0.3, np.inf, low + 1.5)), tuple(rng.uniform(0.1, 0.9, d)), float(rng.normal())))
    points = rng.normal(0, 1, (5000, 12))
    points[::7, 3] = np.nan
    paths = A.packed(leaves)
    together = A.contributions_of(paths, points, 12)
    alone = np.concatenate([A.contributions_of(paths, points[i : i + 20], 12) for i in range(0, 5000, 20)])
    assert together == pytest.approx(alone, abs=1e-12)
    margin = np.zeros(5000)
    for leaf in leaves:
        x = points[:, leaf.features]
        margin += leaf.value * (((x > leaf.low) & (x <= leaf.high)).all(axis=1) - math.prod(leaf.share))
    assert together.sum(axis=1) == pytest.approx(margin, abs=1e-12)


def test_tasks_get_the_nodes_of_trees_not_their_paths(spark, fitted):
    """Tables of patterns outgrow a deep tree's nodes by far."""
    found = A.tree_attribution(spark, fitted["forest"].stages[-1], len(FEATURES))
    nodes = sum(len(part) for _, part in found.trees)
    assert nodes == fitted["forest"].stages[-1].totalNumNodes
    assert len(pickle.dumps([part.to_numpy() for _, part in found.trees])) < 100 * nodes + 10_000


def test_trees_are_dealt_over_tasks_and_rows_stay_whole(spark, table, fitted):
    """Contributions by shares of the trees equal those of whole trees, row by row, also for equal ids."""
    found = A.tree_attribution(spark, fitted["forest"].stages[-1], len(FEATURES))
    rows = table.select("*", F.to_timestamp(F.timestamp_seconds("ts_sec")).alias("at"), F.lit("same").alias("id"))
    got = found.with_contributions(rows, FEATURES)
    assert got.columns == [*rows.columns, "contributions"]
    key = lambda r: r.transaction_id
    got, want = sorted(got.collect(), key=key), sorted(rows.withColumn("x", found.contributions(spark, FEATURES)).collect(), key=key)
    assert [r[:-1] for r in got] == [r[:-1] for r in want] and len(got) == 900
    assert all(g.contributions == pytest.approx(w.x, abs=1e-12) for g, w in zip(got, want, strict=True))
    assert found.with_contributions(rows.limit(0), FEATURES).count() == 0


def test_registered_queries_fit_models_of_the_default_size(spark, monkeypatch):
    from checks import inputs, queries

    seen = {}
    monkeypatch.setattr(inputs, "events_log", lambda *_: None)
    monkeypatch.setattr(inputs, "fitted_features", lambda *_: spark.createDataFrame([], "fold string, is_fraud int"))
    monkeypatch.setattr(inputs.scoring, "train", lambda *a, **k: seen.update(train=(len(a), k)))
    monkeypatch.setattr(M, "fit_boosting", lambda *a, **k: seen.update(boosting=(len(a), k)))
    monkeypatch.setattr(M, "fit_forest", lambda *a, **k: seen.update(forest=(len(a), k)) or 1 / 0)
    monkeypatch.setattr(N, "fit_isolation_forest", lambda *a, **k: seen.update(isolation=(len(a), k)) or 1 / 0)
    inputs.trained(spark, "sizes")
    inputs.boosted(spark, "sizes")
    for name in ("rf_scores", "isolation_novelty"):
        with pytest.raises(ZeroDivisionError):
            queries.QUERIES[name](spark, "sizes")
    assert seen == {"train": (1, {}), "boosting": (2, {}), "forest": (1, {}), "isolation": (1, {})}
    size = M.TreeParams()
    assert (size.forest_trees, size.forest_depth, size.boost_rounds) == (300, 18, 600)


def test_permutation_influence_of_an_unused_feature_is_zero(spark, table, fitted):
    model = M.fit_logistic(table.withColumn("flat", F.lit(1.0)), ["a", "flat"])
    got = {r.feature: r.influence for r in A.permutation_influence(model, table.withColumn("flat", F.lit(1.0)), ["a", "flat"]).collect()}
    assert got["flat"] == pytest.approx(0.0, abs=1e-12) and set(got) == {"a", "flat"}


# ------------------------------------------------------------------ novelty
def test_ecdf_rank_counts_reference_rows_at_or_below(spark):
    ref = [0.1, 0.2, 0.2, 0.2, 0.9]
    ask = [0.0, 0.1, 0.15, 0.2, 5.0, float("nan"), float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ask)], "i int, v double")
    ecdf = N.fit_ecdf(spark.createDataFrame([(v,) for v in ref], "v double"), "v")
    got = {r.i: r.novelty for r in N.ecdf_rank(df, "v", ecdf).collect()}
    clean = [0.0 if math.isnan(v) else v for v in ask]
    want = [np.searchsorted(ref, v, side="right") / 5 for v in clean]
    assert [got[i] for i in range(len(ask))] == pytest.approx(want)
    other = {r.i: r.novelty for r in N.ecdf_rank(df, "v", ecdf, orientation="survival").collect()}
    assert all(other[i] == pytest.approx(1 - got[i]) for i in got)
    assert [r.at_or_below for r in N.ecdf_table(spark.createDataFrame([(v,) for v in ref], "v double"), "v").orderBy("v").collect()] == [1, 4, 5]


@pytest.mark.parametrize("bin_size", [1, 3, 1024])
def test_rank_index_equals_the_exact_rank(spark, bin_size):
    import random

    rng = random.Random(2)
    reference = spark.createDataFrame([(rng.choice([0.0, 1.5, rng.gauss(0, 1), float("inf"), float("-inf")]),) for _ in range(400)] + [(None,), (float("nan"),)], "v double")
    ecdf = N.fit_ecdf(reference, "v")
    asked = [r[0] for r in reference.collect()] + [rng.gauss(0, 2) for _ in range(200)] + [-1e300, 1e300]
    ask = spark.createDataFrame([(float(v) if v is not None else None,) for v in asked], "v double")
    index = N.RankIndex.fit(ecdf, bin_size)
    both = index.rank(index.rank(N.ecdf_rank(ask, "v", ecdf, "exact"), "v", "looked_up"), "v", "survival", "survival").collect()
    assert len(both) == len(asked)
    assert all(r.exact == r.looked_up and r.survival == 1.0 - r.exact for r in both)
    with pytest.raises(ValueError):
        N.RankIndex.fit(ecdf.limit(0))


def test_isolation_scores_equal_a_walk_of_every_row():
    rng = np.random.default_rng(3)
    nodes = [(t, k, *n) for t, size in enumerate((60, 2, 1, 33)) for k, n in enumerate(N._grow(rng.integers(0, 5, (size, 3)).astype(float), rng, 6))]
    nodes = pd.DataFrame(nodes, columns=[c.split()[0] for c in N.NODE_SCHEMA.split(", ")])
    points = rng.integers(-1, 7, (50, 3)).astype(float)
    want = []
    for x in points:
        shares = []
        for _, part in nodes.groupby("tree"):
            table = part.set_index("node")
            node = table.loc[0]
            while node.feature >= 0:
                node = table.loc[node.low if x[int(node.feature)] <= node.threshold else node.high]
            norm = N._expected_depth(table["size"][0])
            shares.append((node.depth + N._expected_depth(node["size"])) / norm if norm > 0 else 1.0)
        want.append(2.0 ** -np.mean(shares) - 0.5)
    walks = N._walks(nodes.sample(frac=1, random_state=1))
    np.testing.assert_allclose(N._deviations(walks, points), want, rtol=1e-12)
    assert len(N._deviations(walks, points[:0])) == 0
    assert max(w.low.nbytes for w in walks) <= 8 * 2 * 60  # a tree at a time, not rows x trees


def test_isolation_forest_finds_the_odd_rows(spark, table):
    odd = spark.createDataFrame([("O1", 9.0, 9.0, 5.0), ("O2", -8.0, -5.0, -3.0)], "transaction_id string, a double, b double, c double")
    forest = N.fit_isolation_forest(table, features=FEATURES, trees=40, sample=128)
    assert forest.nodes["tree"].nunique() == 40
    leaves = forest.nodes[forest.nodes["feature"] < 0]
    assert set(leaves.groupby("tree")["size"].sum()) == {128}
    score = forest.deviation(spark)
    usual = [r[0] for r in table.select(score).collect()]
    unusual = [r[0] for r in odd.select(score).collect()]
    assert min(unusual) > np.quantile(usual, 0.99)
    assert all(-0.5 <= s <= 0.5 for s in usual + unusual)
    again = N.fit_isolation_forest(table.repartition(5), features=FEATURES, trees=40, sample=128)
    assert again.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(
        forest.nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    )


def test_large_tables_give_each_row_to_one_tree(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("transaction_id"), F.rand(3).alias("a"))
    forest = N.fit_isolation_forest(df, features=["a"], trees=10, sample=64)
    sizes = forest.nodes[forest.nodes["node"] == 0]["size"]
    assert len(sizes) == 10 and sizes.max() == 64 and sizes.min() >= 48


def test_a_tree_draws_from_all_rows_of_a_large_table_too(spark):
    """The sample of a tree follows from (id, tree) alone, so more trees leave the first ones as they are."""
    df = spark.range(20_000).select(F.col("id").cast("string").alias("transaction_id"), F.rand(3).alias("a"))
    few, many = (N.fit_isolation_forest(df, features=["a"], trees=k, sample=64).nodes for k in (3, 10))
    keys = ["tree", "node"]
    many = many[many["tree"] < 3]
    assert few.sort_values(keys).reset_index(drop=True).equals(many.sort_values(keys).reset_index(drop=True))


def test_a_short_tree_is_normed_by_its_own_sample(spark):
    nodes = [(0, 0, -1, 0.0, -1, -1, 64, 0), (1, 0, -1, 0.0, -1, -1, 20, 0)]  # trees without a split
    forest = N.IsolationForest(["a"], pd.DataFrame(nodes, columns=[c.split()[0] for c in N.NODE_SCHEMA.split(", ")]), 64)
    got = spark.createDataFrame([(1.0,)], "a double").select(forest.deviation(spark)).first()[0]
    assert got == pytest.approx(0.0)


def test_gaussian_deviation_ignores_constant_features(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "a double, b double")
    fit = N.fit_gaussian(df, ["a", "b"])
    got = [r[0] for r in df.select(N.gaussian_deviation(fit)).collect()]
    assert got == pytest.approx([1.0, 1.0])


@pytest.mark.parametrize("name", ["logistic", "forest", "platt"])
def test_models_score_in_a_session_that_observed_rows(spark, table, name):
    seen = Observation("seen")
    table.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 900
    fits = {
        "logistic": lambda: M.with_raw_probability(M.fit_logistic(table, FEATURES), table),
        "forest": lambda: M.with_raw_probability(M.fit_forest(table, FEATURES, SMALL), table),
        "platt": lambda: M.fit_platt(table, "c").transform(table, "c", "raw_probability"),
    }
    scores = [r.raw_probability for r in fits[name]().collect()]
    assert len(scores) == 900 and all(0.0 <= p <= 1.0 for p in scores)
