"""Scores of predictions: one aggregate, one row, or counts taken along in a pass that is
made anyway."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quorum.functions.encode import round_half_even


def _counts(prediction: str, label: str) -> list:
    return [F.count_if(F.col(prediction) == F.col(label)).alias("right"), F.count("*").alias("total")]


def _with_ratio(counts: DataFrame) -> DataFrame:
    ratio = F.try_divide(F.col("right").cast("double"), F.col("total"))
    return counts.withColumn("accuracy", ratio).withColumn("accuracy_rounded", round_half_even(F.col("accuracy")))


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Right and all rows, their ratio, and the ratio rounded to two decimals."""
    return _with_ratio(df.agg(*_counts(prediction, label)))


def observe_accuracy(
    df: DataFrame, observation: Observation, prediction: str = "prediction", label: str = "label"
) -> DataFrame:
    """``df``, whose first whole read, such as writing it, also counts right and all rows. A
    stage that is run again after its output was lost counts its rows again; have the frame
    read in the last stage of the action, as a plain write does."""
    return df.observe(observation, *_counts(prediction, label))


def observed_accuracy(spark: SparkSession, observation: Observation) -> DataFrame:
    """The row of :func:`accuracy` from the counts of an action that has ended."""
    got = observation.get
    return _with_ratio(spark.createDataFrame([(got["right"], got["total"])], "right long, total long"))
