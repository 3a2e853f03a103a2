"""The forest's own growth against MLlib's rules and a plain replay."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from txnrisk.operators import forest as G
from txnrisk.operators import models as M

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for i in range(2000):
        a, b, c = rng.gauss(0, 1), float(rng.randrange(4)), rng.random()
        y = int(rng.random() < 1 / (1 + math.exp(1.0 - 1.5 * a - 0.4 * b)))
        rows.append((a, b, None if i % 50 == 0 else c, 1.0, y))
    return spark.createDataFrame(rows, "a double, b double, c double, d double, is_fraud int").repartition(3).cache()


def nodes_of(table, task_rows=G.TASK_ROWS, depth=6, trees=5):
    found = G.grow_forest(table, FEATURES, "is_fraud", (1.5, 0.8), trees, depth, 10, 7, task_rows=task_rows)
    return found.select("treeID", "nodeData.*").toPandas().sort_values(["treeID", "id"]).reset_index(drop=True)


def test_where_a_node_is_split_does_not_change_the_forest(table):
    """All of a tree in one task, or its upper nodes by histograms of all tasks."""
    whole, spread = nodes_of(table), nodes_of(table, task_rows=150)
    assert len(whole) > 100 and whole.astype(str).equals(spread.astype(str))


def test_no_rows_of_a_large_node_meet_in_one_task(table, monkeypatch):
    grown = G.grown

    def watched(tree, root, points, label, times, growth):
        assert times.sum() <= 150 and len(points) <= 150
        return grown(tree, root, points, label, times, growth)

    monkeypatch.setattr(G, "grown", watched)
    assert len(nodes_of(table, task_rows=150)) > 100


def test_thresholds_are_those_of_mllib(table):
    rows = table.select("a", "b", "is_fraud").toPandas()
    cuts = [G.thresholds(rows[c].to_numpy(), 32) for c in "ab"]
    assert len(cuts[0]) == 31 and cuts[1].tolist() == [0.5, 1.5, 2.5]
    assert G.thresholds(np.array([1.0, 1.0, np.nan]), 32).tolist() == []
    fit = RandomForestClassifier(labelCol="is_fraud", numTrees=20, maxDepth=8, seed=1).fit(M.assembled(table.drop("c", "d"), ["a", "b"]))
    used = {(int(f), float(t)) for f, t in _conditions(fit.toDebugString)}
    assert len(used) > 30
    assert all(np.abs(cuts[f] - t).min() < 1e-9 for f, t in used)


def _conditions(text):
    import re

    return re.findall(r"If \(feature (\d+) <= (\S+)\)", text)


def test_splits_are_the_best_ones_of_a_plain_search():
    rng = np.random.default_rng(4)
    points = rng.integers(0, 5, (400, 3)).astype(np.uint8)
    label = (rng.random(400) < 0.2 + 0.1 * points[:, 1]).astype(np.int64)
    times = rng.integers(1, 4, 400).astype(float)
    growth = G.Growth(tuple(np.arange(4.0) for _ in range(3)), 2.0, 0.7, 4, 25, 3, 5, 9)
    nodes = G.grown(0, 1, points, label, times, growth)
    held = {1: np.arange(400)}

    def gini(rows):
        a, b = (times[rows][label[rows] == v].sum() * w for v, w in ((1, 2.0), (0, 0.7)))
        return 1 - (a / (a + b)) ** 2 - (b / (a + b)) ** 2, a + b

    for r in nodes.itertuples():
        rows = held[r.node]
        assert (r.pos, r.neg) == tuple(times[rows][label[rows] == v].sum() for v in (1, 0))
        gains = {}
        for f in range(3):
            for cut in range(4):
                sides = [rows[points[rows, f] <= cut], rows[points[rows, f] > cut]]
                if min(times[s].sum() for s in sides) >= 25:
                    (g, w), parts = gini(rows), [gini(s) for s in sides]
                    gains[f, cut] = g - sum(p * v / w for p, v in parts)
        if r.feature < 0:
            assert r.node >= 16 or not gains or max(gains.values()) < 1e-9 or gini(rows)[0] < 1e-12
            continue
        assert r.gain == pytest.approx(max(gains.values())) == pytest.approx(gains[r.feature, r.bin])
        low = points[rows, r.feature] <= r.bin
        held[2 * r.node], held[2 * r.node + 1] = rows[low], rows[~low]
    assert len(held) == len(nodes) > 10


def test_a_forest_is_grown_without_mllibs_histograms_and_scores_as_well(table, monkeypatch):
    size = M.TreeParams(forest_trees=60, forest_depth=6, forest_leaf=10)
    names = ["a", "b", "d"]
    w = M.class_weights(table).first()
    rows = M._weighted(M.assembled(table, names), w.balanced_pos, w.balanced_neg)
    plain = [
        RandomForestClassifier(labelCol="is_fraud", weightCol=M.WEIGHT, numTrees=60, maxDepth=6, minInstancesPerNode=10, seed=s).fit(rows)
        for s in (1, 2)
    ]
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *a: pytest.fail("a histogram for every node and partition"))
    model = M.fit_forest(table, names, size)
    fit = model.stages[-1]
    assert (fit.getNumTrees, fit.numFeatures, fit.numClasses, fit.getMaxDepth()) == (60, 3, 2, 6)
    assert max(t.depth for t in fit.trees) <= 6
    mine, one, two = (
        np.array([r.p for r in m.transform(r).select(M.positive_probability().alias("p")).collect()])
        for m, r in ((model, table), *((p, rows) for p in plain))
    )
    assert np.abs(mine - one).mean() < 1.5 * np.abs(two - one).mean() + 0.005
    assert mine.mean() == pytest.approx(one.mean(), abs=0.01)


def test_leaves_of_one_prediction_are_drawn_together(table):
    nodes = nodes_of(table)
    for _, tree in nodes.groupby("treeID"):
        assert tree["id"].tolist() == list(range(len(tree)))
        by_id = tree.set_index("id")
        for r in by_id[by_id.leftChild >= 0].itertuples():
            low, high = by_id.loc[r.leftChild], by_id.loc[r.rightChild]
            assert r.leftChild == r.Index + 1 and low.rawCount + high.rawCount == r.rawCount
            assert low.leftChild >= 0 or high.leftChild >= 0 or low.prediction != high.prediction
            assert min(low.rawCount, high.rawCount) >= 10
            assert list(r.impurityStats) == pytest.approx(np.add(low.impurityStats, high.impurityStats))


def test_one_class_or_no_rows(spark, table):
    one = M.fit_forest(table.filter("is_fraud = 0"), ["a", "b"], M.TreeParams(forest_trees=3))
    assert M.with_raw_probability(one, table).agg(F.max("raw_probability")).first()[0] == 0.0
    for odd in (table.withColumn("is_fraud", F.when(F.col("b") < 3, F.col("is_fraud"))), table.withColumn("a", F.when(F.col("b") < 3, F.col("a")))):
        with pytest.raises(ValueError, match="labels are missing"):
            M.fit_forest(odd, ["a", "b"], M.TreeParams(forest_trees=3))
    with pytest.raises(ValueError):
        M.fit_forest(table.limit(0), ["a", "b"], M.TreeParams(forest_trees=3))
