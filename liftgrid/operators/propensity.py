"""Propensity of being treated given user features: training, validation, scoring."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import (
    FeatureHasher,
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liftgrid.operators.ipw import adjusted_conversion_rate, compute_weights
from liftgrid.operators.logistic import score_categories, score_logistic
from liftgrid.operators.metrics import control_of
from liftgrid.operators.ordering import dealt, running_below
from liftgrid.schemas import MODEL_RUNS
from liftgrid.session import ensure_checkpoint_dir, lookup_join, materialize

# Model inputs (fixed values).
NUMERIC_FEATURES = (
    "total_sessions", "total_revenue", "days_active", "avg_price_viewed",
    "total_views", "total_carts", "total_purchases", "avg_session_length",
)
CATEGORICAL_FEATURES = ("favorite_category",)
UNKNOWN_CATEGORY = "unknown"

# Boosting settings and alarm level (fixed values).
BOOSTING = {
    "maxIter": 200, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8", "seed": 42,
}
IMBALANCE_AUC = 0.6
FOLDS = 5

# Training rows are dealt to so many partitions by user. The boosting bag is drawn per
# partition, so this number is a setting of the model, never taken from the data.
TRAINING_PARTITIONS = 8


def fill_features(features: DataFrame) -> DataFrame:
    """Missing numbers become 0, a missing category becomes its own value."""
    return features.withColumns(
        {
            **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMERIC_FEATURES},
            **{c: F.coalesce(c, F.lit(UNKNOWN_CATEGORY)) for c in CATEGORICAL_FEATURES},
        }
    )


def training_set(
    features: DataFrame, assignments: DataFrame, control: str | Column = "control"
) -> DataFrame:
    """Features of assigned users with the label treatment = not in the control arm."""
    control = F.lit(control) if isinstance(control, str) else control
    labels = assignments.select(
        "user_id", "experiment_id",
        (F.col("variant") != control).cast("int").alias("treatment"),
    )
    columns = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
    return fill_features(features.select("user_id", *columns)).join(labels, "user_id").select(
        "experiment_id", "user_id", "treatment", *columns
    )


def feature_pipeline(
    classifier: str = "boosted", hash_categories: int | None = None, **settings
) -> Pipeline:
    """Scaled numbers, one-hot category (unseen values allowed), and the classifier.

    By default every category has its own column; the driver holds their dictionary.
    ``hash_categories``, where asked for, is a number of hashed columns instead: categories
    may then share one. The data never decides between the two.
    """
    category = CATEGORICAL_FEATURES[0]
    stages = [
        VectorAssembler(inputCols=list(NUMERIC_FEATURES), outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
    ]
    if hash_categories is not None:
        stages.append(
            FeatureHasher(
                inputCols=[category], outputCol="category_onehot",
                categoricalCols=[category], numFeatures=hash_categories,
            )
        )
    else:
        stages += [
            StringIndexer(
                inputCols=[category], outputCols=["category_index"], handleInvalid="keep"
            ),
            OneHotEncoder(
                inputCols=["category_index"], outputCols=["category_onehot"],
                dropLast=False, handleInvalid="keep",
            ),
        ]
    stages.append(VectorAssembler(inputCols=["scaled", "category_onehot"], outputCol="inputs"))
    common = {"featuresCol": "inputs", "labelCol": "treatment"}
    if classifier == "boosted":
        stages.append(GBTClassifier(**common, checkpointInterval=10, **{**BOOSTING, **settings}))
    elif classifier == "logistic":
        stages.append(LogisticRegression(**common, **settings))
    else:
        raise ValueError(f"Unknown classifier: {classifier!r}")
    return Pipeline(stages=stages)


def stratified_folds(
    data: DataFrame, folds: int = FOLDS, strata: Sequence[str] = ("treatment",),
    key: str = "user_id",
) -> DataFrame:
    """Fold number per row, the rows of each stratum dealt out evenly in hash order."""
    return dealt(data, strata, key).withColumn("fold", (F.col("position") % folds).cast("int")).drop("position")


def rank_auc(
    scored: DataFrame, score: str = "propensity", label: str = "treatment",
    by: Sequence[str] = ("experiment_id",),
) -> DataFrame:
    """Area under the ROC curve per group: share of (treated, control) pairs in order.

    Rows are counted per distinct score, and each score adds the controls below it; no group
    is ordered in one task.
    """
    counts = scored.groupBy(*by, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).cast("double").alias("n1"),
        F.count_if(F.col(label) == 0).cast("double").alias("n0"),
    )
    return (
        running_below(counts, by, "_score", "n0")
        .withColumn("_ordered", F.col("n1") * (F.col("below") + F.col("n0") / 2))
        .groupBy(*by)
        .agg(
            F.try_divide(F.sum("_ordered"), F.sum("n1") * F.sum("n0")).alias("auc"),
            F.sum("n1").cast("bigint").alias("n_treated"),
            F.sum("n0").cast("bigint").alias("n_control"),
        )
    )


def score_propensity(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Features with ``propensity`` = P(treatment | covariates)."""
    scored = model.transform(fill_features(features))
    return scored.withColumn("propensity", vector_to_array("probability")[1]).drop(
        "numbers", "scaled", "category_index", "category_onehot", "inputs",
        "rawPrediction", "probability", "prediction",
    )


class PropensityModel:
    """Classifier of one experiment with its cross-validated AUC."""

    def __init__(
        self, classifier: str = "boosted", parallelism: int = FOLDS,
        partitions: int = TRAINING_PARTITIONS, hash_categories: int | None = None, **settings,
    ):
        self.classifier = classifier
        self.parallelism = parallelism
        self.partitions = partitions
        self.hash_categories = hash_categories
        self.settings = settings
        self.model: PipelineModel | None = None
        self.cv_auc: float | None = None

    def train(self, data: DataFrame, folds: int = FOLDS) -> float:
        """Fit on all rows of a ``training_set`` of one experiment; returns the mean AUC.

        The fold models and the final one are independent distributed fits; up to
        ``parallelism`` of them share the cluster at a time.
        """
        ensure_checkpoint_dir(data.sparkSession)
        data = materialize(stratified_folds(data, folds), "propensity-training")
        # One layout whatever the input's was: the same rows give the same model.
        data = data.repartition(self.partitions, "user_id").sortWithinPartitions("user_id")
        pipeline = feature_pipeline(self.classifier, self.hash_categories, **self.settings)
        fold = F.col("fold")
        samples = [data.filter(fold != k) for k in range(folds)] + [data]
        fit = inheritable_thread_target(data.sparkSession)(pipeline.fit)
        with ThreadPool(max(1, self.parallelism)) as pool:
            *fold_models, self.model = pool.map(fit, samples)
        held_out = [
            score_propensity(model, data.filter(fold == k)) for k, model in enumerate(fold_models)
        ]
        aucs = rank_auc(reduce(DataFrame.unionByName, held_out), by=("fold",))
        self.cv_auc, ranked = aucs.agg(F.avg("auc"), F.count("auc")).first()
        if ranked < folds:
            raise ValueError(f"{folds - ranked} of {folds} folds hold one class only")
        return self.cv_auc

    def predict_propensity(self, features: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("Model not trained. Call train() first.")
        return score_propensity(self.model, features)

    def save(self, path: str, experiment_id: str, runs_path: str) -> None:
        """Write the fitted pipeline and append one row to the table of model runs."""
        if self.model is None:
            raise RuntimeError("Model not trained. Call train() first.")
        self.model.write().overwrite().save(path)
        row = (
            experiment_id, self.cv_auc, [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES],
            dt.datetime.now(dt.timezone.utc), path,
        )
        run = SparkSession.active().createDataFrame([row], MODEL_RUNS)
        run.write.mode("append").parquet(runs_path)


def imbalance_detected(cv_auc: Column) -> Column:
    return cv_auc > IMBALANCE_AUC


def with_outcomes(weighted: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Weighted rows with conversion and revenue; users without outcomes did not convert.

    ``outcomes`` hold one row per user, or per user and experiment.
    """
    keys = [c for c in ("user_id", "experiment_id") if c in outcomes.columns]
    converted = outcomes.select(
        *keys, (F.col("n_purchases") > 0).cast("int").alias("converted"), "revenue"
    )
    return weighted.join(converted, keys, "left").fillna(0, ["converted", "revenue"])


def labelled_rows(features: DataFrame, assignments: DataFrame) -> DataFrame:
    """``training_set`` of all experiments, each against its own control arm."""
    variants = assignments.select("experiment_id", "variant").distinct()
    controls = variants.select("experiment_id", control_of(variants).alias("control")).distinct()
    return training_set(features, lookup_join(assignments, controls, ["experiment_id"]), F.col("control"))


def score_all(
    features: DataFrame, assignments: DataFrame, classifier: str = "logistic", folds: int = FOLDS,
    maxIter: int = 40,
) -> DataFrame:
    """Training rows of all experiments with ``fold``, ``propensity`` and ``held_out``.

    ``logistic`` models numbers and category in at most ``maxIter`` Newton steps, ``category``
    the category alone; either fits every experiment and fold in the same jobs.
    """
    rows = stratified_folds(labelled_rows(features, assignments), folds, ("experiment_id", "treatment"))
    rows = materialize(rows, "propensity-training")
    if classifier == "logistic":
        return score_logistic(rows, NUMERIC_FEATURES, CATEGORICAL_FEATURES[0], folds, max_steps=maxIter)
    if classifier == "category":
        return score_categories(rows, CATEGORICAL_FEATURES[0])
    raise ValueError(f"Unknown classifier: {classifier!r}")


def cross_validation(scored: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Mean AUC of the folds per experiment; NULL where a fold holds one class only."""
    aucs = rank_auc(scored, "held_out", by=("experiment_id", "fold"))
    return aucs.groupBy("experiment_id").agg(
        F.when(F.count("auc") == folds, F.avg("auc")).alias("cv_auc")
    )


def adjusted_by_scores(scored: DataFrame, outcomes: DataFrame, cv: DataFrame) -> DataFrame:
    """Weights from ``propensity``, raw and adjusted lift, and the mean AUC per experiment."""
    weighted = with_outcomes(
        scored.withColumn("weight", compute_weights(F.col("propensity"), F.col("treatment"))), outcomes
    )
    return adjusted_conversion_rate(weighted).join(cv, "experiment_id", "left").select(
        "experiment_id", "cv_auc",
        F.coalesce(imbalance_detected(F.col("cv_auc")), F.lit(False)).alias("imbalance_detected"),
        "adjustment_magnitude", "unadjusted_lift", "adjusted_lift",
    )


def boosted_scores(rows: DataFrame, folds: int = FOLDS, **settings) -> tuple[DataFrame, DataFrame]:
    """Scored rows of boosted trees and the mean AUC per experiment.

    Each experiment is a distributed fit with its own category dictionary, one after the
    other; the per-user tables never leave the executors.
    """
    rows = materialize(rows, "propensity-rows")
    scored, aucs = [], []
    for row in rows.select("experiment_id").distinct().orderBy("experiment_id").collect():
        own = rows.filter(F.col("experiment_id") == row.experiment_id)
        model = PropensityModel("boosted", **settings)
        aucs.append((row.experiment_id, model.train(own, folds)))
        scored.append(model.predict_propensity(own))
    cv = rows.sparkSession.createDataFrame(aucs, "experiment_id string, cv_auc double")
    return reduce(DataFrame.unionByName, scored), cv


def propensity_analysis(
    features: DataFrame,
    assignments: DataFrame,
    outcomes: DataFrame,
    experiment_ids: Sequence[str] | None = None,
    classifier: str = "boosted",
    **settings,
) -> DataFrame:
    """Train, score, weight and adjust, one row per experiment, of those named or all.

    ``logistic`` and ``category`` fit all experiments and folds in common jobs; ``boosted``
    trains trees for one experiment after the other.
    """
    if experiment_ids is not None:
        assignments = assignments.filter(F.col("experiment_id").isin(*experiment_ids))
    assignments = materialize(assignments, "propensity-assignments")
    if classifier == "boosted":
        scored, cv = boosted_scores(labelled_rows(features, assignments), **settings)
    else:
        scored = materialize(score_all(features, assignments, classifier, **settings), "propensity-scores")
        cv = cross_validation(scored, settings.get("folds", FOLDS))
    return adjusted_by_scores(scored, outcomes, cv)
