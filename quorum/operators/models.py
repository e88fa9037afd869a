"""One place that turns a model code into a fit and a fit into a prediction column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.operators import logistic
from quorum.operators.linear import LinearModel
from quorum.schema import ModelSpec

VECTOR = "_features"
LABEL = "_label"


@dataclass(frozen=True, eq=False)
class TreeModel:
    """A fitted decision tree with the interface of the linear models."""

    model: object

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        scored = self.model.copy()
        scored.setPredictionCol(out).setRawPredictionCol("").setProbabilityCol("")
        if VECTOR in df.columns:
            return scored.transform(df)
        return scored.transform(df.withColumn(VECTOR, array_to_vector("features"))).drop(VECTOR)


def class_count(spec: ModelSpec, n_classes: int) -> int:
    """The classes a fit is told about; a specification may only widen the set's own."""
    if spec.code == "NB":
        return n_classes
    return max(spec.num_classes, n_classes)


def make_estimator(spec: ModelSpec, n_classes: int, weight: str | None = None, fixed_smoothing=None):
    """The ``pyspark.ml`` estimator of a specification, on ``_features`` and ``_label``."""
    common = {"featuresCol": VECTOR, "labelCol": LABEL}
    if weight is not None:
        common["weightCol"] = weight
    if spec.code == "NB":
        smoothing = spec.smoothing if fixed_smoothing is None else fixed_smoothing
        return NaiveBayes(modelType="multinomial", smoothing=smoothing, **common)
    if spec.code == "LR":
        family = "binomial" if class_count(spec, n_classes) <= 2 else "multinomial"
        return LogisticRegression(
            family=family, regParam=0.0, fitIntercept=False, maxIter=100, tol=1e-6, **common
        )
    return DecisionTreeClassifier(
        impurity="gini", maxDepth=spec.max_depth, maxBins=spec.max_bins, seed=0, **common
    )


def training_points(
    df: DataFrame, n_classes: int, weight: str | None = None, label: str = "label"
) -> DataFrame:
    """Vector, label and weight of the rows that count.

    The class count travels as label metadata, which saves the estimators a pass to find
    it. The vector has none, so that trees treat nominal codes as ordered numbers.
    """
    if weight is not None:
        df = df.filter(F.col(weight) > 0)
    meta = {"ml_attr": {"type": "nominal", "num_vals": n_classes}}
    columns = [
        F.col(label).alias(LABEL, metadata=meta),
        array_to_vector("features").alias(VECTOR),
    ]
    if weight is not None:
        columns.append(F.col(weight).cast("double").alias(weight))
    return df.select(*columns)


def _linear_from_bayes(model, points: DataFrame) -> LinearModel:
    pi, theta = np.array(model.pi.toArray()), np.array(model.theta.toArray())
    k = len(pi)
    present = sorted(r[0] for r in points.select(LABEL).distinct().collect())
    if len(present) != k:
        raise ValueError(f"naive Bayes fitted {k} classes, the labels hold {len(present)}")
    return LinearModel(tuple(present), pi, theta)


def fit(
    df: DataFrame,
    spec: ModelSpec,
    n_classes: int,
    weight: str | None = None,
    label: str = "label",
    fixed_smoothing: float | None = None,
):
    """Fit one model on ``features``/``label`` (and a weight column)."""
    told = class_count(spec, n_classes)
    if spec.code == "LR":
        n_input = df.select(F.size("features")).head()
        if n_input is None:
            raise ValueError("logistic regression was given no rows")
        if logistic.suits(told, n_input[0]):
            rows = df.select(
                "features",
                F.col(label).alias("label"),
                F.array(F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("weights"),
            )
            return logistic.fit_members(rows, [0], told, n_input[0])[0]
    points = training_points(df, told, weight, label)
    model = make_estimator(spec, n_classes, weight, fixed_smoothing).fit(points)
    if spec.code == "DT":
        return TreeModel(model)
    if spec.code == "LR":
        coefficients = np.array(model.coefficientMatrix.toArray())
        if coefficients.shape[0] == 1:
            # Two classes: class 1 wins when its margin over class 0 is above 0.
            coefficients = np.vstack([np.zeros_like(coefficients), coefficients])
        k = coefficients.shape[0]
        return LinearModel(tuple(float(i) for i in range(k)), np.zeros(k), coefficients)
    # The estimator numbers the classes it saw 0..k-1. When none is missing that is their id.
    pi, theta = np.array(model.pi.toArray()), np.array(model.theta.toArray())
    if len(pi) == n_classes:
        return LinearModel(tuple(float(i) for i in range(n_classes)), pi, theta)
    return _linear_from_bayes(model, points)


def run_parallel(spark: SparkSession, tasks: Sequence[Callable], parallelism: int) -> list:
    """Run fits side by side and return their results in order.

    The first failure is raised; fits that have not started are given up.
    """
    if parallelism <= 1 or len(tasks) <= 1:
        return [task() for task in tasks]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(tasks))) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        try:
            return [f.result() for f in futures]
        except BaseException:
            for f in futures:
                f.cancel()
            raise
