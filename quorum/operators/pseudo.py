"""Pseudo-labels: the predictions of level-0 models used as labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.functions.vote import vote_counts
from quorum.operators.linear import LinearModel, predict_many
from quorum.operators.models import VECTOR
from quorum.operators.trees import GroupedTree, predict_trees


def transform_all(df: DataFrame, models: Sequence, prefix: str = "p") -> DataFrame:
    """Add one prediction column per model (``p0``, ``p1``, ...)."""
    linear = {f"{prefix}{m}": [model] for m, model in enumerate(models) if isinstance(model, LinearModel)}
    grouped = {f"{prefix}{m}": [model] for m, model in enumerate(models) if isinstance(model, GroupedTree)}
    trees = {f"{prefix}{m}": t for m, t in enumerate(models) if f"{prefix}{m}" not in linear | grouped}
    if linear:
        df = predict_many(df, list(linear.values()), list(linear))
    if grouped:
        df = predict_trees(df, list(grouped.values()), list(grouped))
    if trees:
        df = df.withColumn(VECTOR, array_to_vector("features"))
        for name, tree in trees.items():
            df = tree.transform(df, name)
        df = df.drop(VECTOR)
    return df


def _all(models: Sequence, kind: type) -> bool:
    return all(isinstance(m, kind) for m in models)


def out_of_fold(df: DataFrame, models_by_fold: Sequence[Sequence], prefix: str = "p") -> DataFrame:
    """Add one prediction column per model, made by the model of the row's own ``fold``.

    ``models_by_fold[m][k]`` is model m fitted without fold k; a row of a fold that has no
    model gets NULL. Linear models look their coefficients up and trees fitted together their
    cuts; other trees are branches of one expression. Either way it is one scan.
    """
    folds = len(models_by_fold[0])
    known: list[str] = []
    for kind, predict in ((LinearModel, predict_many), (GroupedTree, predict_trees)):
        sets = {f"{prefix}{m}": per for m, per in enumerate(models_by_fold) if _all(per, kind)}
        if sets:
            df = predict(df, list(sets.values()), list(sets), chooser="fold")
            known += sets
    if len(known) == len(models_by_fold):
        return df
    df = df.withColumn(VECTOR, array_to_vector("features"))
    spare: list[str] = []
    for m, per_fold in enumerate(models_by_fold):
        if f"{prefix}{m}" in known:
            continue
        # Every column is used once, in a branch, so that only the row's own fold is scored.
        names = [f"_{prefix}{m}_{k}" for k in range(folds)]
        for name, model in zip(names, per_fold):
            df = model.transform(df, name)
        own = F.when(F.col("fold") == 0, F.col(names[0]))
        for k in range(1, folds):
            own = own.when(F.col("fold") == k, F.col(names[k]))
        df = df.withColumn(f"{prefix}{m}", own)
        spare += names
    return df.drop(VECTOR, *spare)


def explode_predictions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per (row, model): ``model`` number and pseudo ``label``."""
    rest = [c for c in df.columns if c not in columns and c != "label"]
    return df.select(*rest, F.posexplode(F.array(*columns)).alias("model", "label"))


def weighted_pseudo_labels(
    df: DataFrame, predictions: Sequence[Column] | Column, n_classes: int, keep: Sequence[str] = ("features",)
) -> DataFrame:
    """The same training set as :func:`explode_predictions`, with equal copies merged.

    M models give M copies of every row, most of which agree. A row is emitted once per
    distinct pseudo-label with the number of models behind it as ``weight``; a row without
    predictions is not emitted.
    """
    counts = vote_counts(predictions, n_classes)
    copies = df.select(*keep, F.posexplode(counts).alias("_class", "weight"))
    return copies.filter(F.col("weight") > 0).select(
        *keep, F.col("_class").cast("double").alias("label"), F.col("weight").cast("double").alias("weight")
    )
