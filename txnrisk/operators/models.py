"""Supervised fraud probability: weighted fits, comparison and calibration on MLlib."""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassificationModel, GBTClassifier, LogisticRegression,
    RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.operators.forest import grow_forest
from txnrisk.operators.metrics import brier, exact_ranking_metrics
from txnrisk.operators.splits import half_split
from txnrisk.settings import DEFAULTS, MODEL_FEATURES
from txnrisk.sources.scratch import scratch_root

LABEL, WEIGHT = "is_fraud", "_weight"


@dataclass(frozen=True)
class TreeParams:
    """Sizes of the tree models. Lower them for small data."""

    forest_trees: int = 300
    forest_depth: int = 18
    forest_leaf: int = 30
    boost_rounds: int = 600
    boost_depth: int = 6
    boost_leaf: int = 80
    boost_step: float = 0.08
    boost_patience: int = 80
    boost_bins: int = 255


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Counts and the positive weights used for fitting."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    pos, neg = F.greatest("pos", F.lit(1)), F.greatest("neg", F.lit(1))
    n = F.col("pos") + F.col("neg")
    return counts.select(
        "pos", "neg",
        F.sqrt(neg / pos).alias("sqrt_weight"),
        (n / (2 * pos)).alias("balanced_pos"),
        (n / (2 * neg)).alias("balanced_neg"),
    )


def _weighted(df: DataFrame, positive: float, negative: float) -> DataFrame:
    return df.withColumn(WEIGHT, F.when(F.col(LABEL) == 1, float(positive)).otherwise(float(negative)))


def assembled(df: DataFrame, features: list[str] = MODEL_FEATURES, name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=name, handleInvalid="keep").transform(df)


def positive_probability(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


def _plain(fit: Model) -> Model:
    """``fit`` without its training summary, by saving and loading it.

    The summary holds the session, which can't be sent to tasks any more once rows were observed in it
    (``DataFrame.observe``), and the models that score inside tasks carry their summary along.
    """
    path = f"{scratch_root(SparkSession.active())}/fit-{uuid.uuid4().hex}"
    fit.write().save(path)
    return type(fit).load(path)


def fit_logistic(train: DataFrame, features: list[str] = MODEL_FEATURES, c: float = 0.5, max_iter: int = 2000) -> PipelineModel:
    """Balanced logistic regression on standardised inputs. ``c`` is the inverse
    penalty against the summed loss, hence 1 / (c x weight) against the mean loss."""
    w = class_weights(train).first()
    rows = _weighted(assembled(train, features), w.balanced_pos, w.balanced_neg)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(rows)
    fit = LogisticRegression(
        featuresCol="scaled", labelCol=LABEL, weightCol=WEIGHT, maxIter=max_iter, standardization=False,
        regParam=1.0 / (c * max(1, w.pos + w.neg)),
    ).fit(scaler.transform(rows))
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), scaler, _plain(fit)])


def _checkpoints(df: DataFrame) -> None:
    """A folder for the checkpoints that cut the lineage of many rounds and levels."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_root(df.sparkSession))


def fit_forest(train: DataFrame, features: list[str] = MODEL_FEATURES, size: TreeParams = TreeParams(), seed: int = DEFAULTS.seed) -> PipelineModel:
    """Balanced random forest. Its trees are grown by ``forest.grow_forest`` and read as a saved MLlib forest: MLlib's own
    fit sends a histogram for every node, tree and partition, which at this depth outgrows the rows by far."""
    w = class_weights(train).first()
    odd = [F.isnan(x) | (F.abs(x) == float("inf")) for x in (F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features)]
    unlabelled, not_numbers = train.agg(F.count_if(F.col(LABEL).isNull()), F.count_if(functools.reduce(Column.__or__, odd))).first()
    if unlabelled or not_numbers:  # as MLlib's fits refuse them
        raise ValueError(f"{unlabelled} labels are missing, {not_numbers} rows have features that are not finite numbers")
    shape = dict(
        featuresCol="features", labelCol=LABEL, weightCol=WEIGHT, maxDepth=size.forest_depth, minInstancesPerNode=size.forest_leaf,
        seed=seed, cacheNodeIds=True,
    )
    nodes = grow_forest(
        train, features, LABEL, (w.balanced_pos, w.balanced_neg), size.forest_trees, size.forest_depth, size.forest_leaf, seed
    )
    path = f"{scratch_root(train.sparkSession)}/fit-{uuid.uuid4().hex}"
    nodes.write.parquet(f"{path}/data")
    figures = {"numFeatures": len(features), "numClasses": 2}
    whole = RandomForestClassifier(numTrees=size.forest_trees, **shape)
    _text(train.sparkSession, _metadata(whole, RandomForestClassificationModel, numTrees=size.forest_trees, **figures), f"{path}/metadata")
    tree = _metadata(DecisionTreeClassifier(**shape), DecisionTreeClassificationModel, **figures)
    table = train.sparkSession.range(size.forest_trees).select(F.col("id").cast("int").alias("_1"), F.lit(tree).alias("_2"), F.lit(1.0).alias("_3"))
    table.coalesce(1).write.parquet(f"{path}/treesMetadata")
    fit = RandomForestClassificationModel.load(path)
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), fit])


def _metadata(estimator: Estimator, model: type[Model], **figures: int) -> str:
    """What a saved ``model`` of this estimator says about itself."""
    spark = SparkSession.active()
    path = f"{scratch_root(spark)}/estimator-{uuid.uuid4().hex}"
    estimator.save(path)
    found = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    return json.dumps({**found, "class": f"org.apache.spark.ml.classification.{model.__name__}", **figures})


def _text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def fit_boosting(
    train: DataFrame, val: DataFrame, features: list[str] = MODEL_FEATURES, size: TreeParams = TreeParams(),
    seed: int = DEFAULTS.seed,
) -> PipelineModel:
    """Boosted trees with the square-root class weight, cut after the round with the lowest loss on ``val``.

    Rounds are added until ``boost_patience`` of them brought no lower loss. A round depends on those before it only, so
    more rounds are fitted from the start, each time twice as many, and the best number of them once more. Trees are shallow
    here: walking down is cheaper than keeping the node of every row.
    """
    w = class_weights(train).first()
    rows, held = (_weighted(assembled(df, features), w.sqrt_weight, 1.0) for df in (train, val))
    _checkpoints(train)

    def fitted(rounds: int) -> GBTClassificationModel:
        return GBTClassifier(
            featuresCol="features", labelCol=LABEL, weightCol=WEIGHT, maxIter=rounds, maxDepth=size.boost_depth,
            stepSize=size.boost_step, minInstancesPerNode=size.boost_leaf, subsamplingRate=0.9, featureSubsetStrategy="0.8",
            maxBins=size.boost_bins, seed=seed,
        ).fit(rows)

    rounds = min(size.boost_rounds, size.boost_patience + 16)
    while True:
        fit = fitted(rounds)
        losses = fit.evaluateEachIteration(held)
        best = min(range(rounds), key=losses.__getitem__) + 1
        if rounds == size.boost_rounds or best + size.boost_patience <= rounds:
            break
        rounds = min(2 * rounds, size.boost_rounds)
    if best < rounds:
        fit = fitted(best)
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), fit])


def with_raw_probability(model: Model, df: DataFrame, name: str = "raw_probability") -> DataFrame:
    scored = model.transform(df).withColumn(name, positive_probability())
    return scored.select(*df.columns, name)


@dataclass(frozen=True)
class Comparison:
    models: dict[str, PipelineModel]
    table: DataFrame
    best: str


def compare_models(models: dict[str, PipelineModel], val: DataFrame) -> Comparison:
    """Validation PR-AUC and ROC-AUC of fitted models; the best has the highest PR-AUC."""
    rows = []
    for name, model in models.items():
        m = exact_ranking_metrics(with_raw_probability(model, val), "raw_probability").first()
        rows.append((name, m.pr_auc, m.roc_auc))
    table = val.sparkSession.createDataFrame(rows, "model string, pr_auc_val double, roc_auc_val double")
    best = max(rows, key=lambda r: -1.0 if r[1] is None else r[1])[0]
    return Comparison(models, table, best)


# ------------------------------------------------------------------ calibration
@dataclass(frozen=True)
class Calibrator:
    method: str
    model: Model
    report: list[tuple[str, float, int]] = field(default_factory=list)

    def transform(self, df: DataFrame, raw: str = "raw_probability", name: str = "p") -> DataFrame:
        rows = assembled(df, [raw], "_raw_vector")
        scored = self.model.transform(rows)
        p = positive_probability("_probability") if self.method == "platt" else F.col("_calibrated")
        return scored.withColumn(name, p).select(*df.columns, name)


def _score_groups(df: DataFrame, raw: str) -> DataFrame:
    """Label mean per distinct raw score. The isotonic fit pools these in every range
    partition first, so only pooled blocks reach the driver."""
    grouped = df.groupBy(raw).agg(
        F.avg(LABEL).alias("_mean"), F.count(F.lit(1)).cast("double").alias(WEIGHT)
    )
    return assembled(grouped, [raw], "_raw_vector")


def fit_platt(df: DataFrame, raw: str = "raw_probability") -> Calibrator:
    rows = assembled(df, [raw], "_raw_vector")
    fit = LogisticRegression(
        featuresCol="_raw_vector", labelCol=LABEL, standardization=False, regParam=1.0 / max(1, df.count()),
        probabilityCol="_probability", rawPredictionCol="_margin", predictionCol="_class", maxIter=200,
    ).fit(rows)
    return Calibrator("platt", _plain(fit))


def fit_isotonic(df: DataFrame, raw: str = "raw_probability") -> Calibrator:
    fit = IsotonicRegression(
        featuresCol="_raw_vector", labelCol="_mean", weightCol=WEIGHT, predictionCol="_calibrated"
    ).fit(_score_groups(df, raw))
    return Calibrator("isotonic", fit)


def fit_calibrator(df: DataFrame, id_col: str = "transaction_id", raw: str = "raw_probability", seed: int = DEFAULTS.seed) -> Calibrator:
    """Fit both methods on one half and keep the one with the lower Brier score on the other."""
    halves = half_split(df.select(id_col, LABEL, raw), id_col, seed)  # the whole rows would be put in order with them
    fitting, held = halves.filter(F.col("half") == "fit"), halves.filter(F.col("half") == "eval")
    report, best, lowest = [], None, float("inf")
    for candidate in (fit_platt(fitting, raw), fit_isotonic(fitting, raw)):
        row = candidate.transform(held, raw).agg(brier("p").alias("b"), F.count(F.lit(1)).alias("n")).first()
        report.append((candidate.method, round(row.b, 5), row.n))
        if row.b < lowest:
            best, lowest = candidate, row.b
    return Calibrator(best.method, best.model, report)
