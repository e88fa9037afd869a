"""Run reports: one row per run, and where to put it."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.functions.encode import round_half_even
from quorum.plans.runs import RunResult

FORMATS = ("json", "parquet", "text")

_TIMES = ("total_seconds", "execution_seconds")


def run_report(result: RunResult, with_times: bool = True) -> DataFrame:
    """One row describing the run.

    The score is computed here, once. ``total_seconds`` counts from the start of the run,
    ``execution_seconds`` from after load and split; both end when the score is known.
    """
    score = result.accuracy()
    columns = [
        F.lit(result.kind).alias("run"),
        F.lit(result.dataset.name).alias("input"),
        F.lit(result.num_partitions).cast("int").alias("num_partitions"),
        F.array(*[F.lit(s.describe(result.smoothing)) for s in result.level0]).alias("level0_models"),
        F.lit(result.level1.describe(result.smoothing) if result.level1 else None)
        .cast("string")
        .alias("level1_model"),
        "right",
        "total",
        "accuracy",
        "accuracy_rounded",
    ]
    if not with_times:
        return score.select(*columns)
    (row,) = score.select(*columns).collect()
    end = time.perf_counter()
    seconds = (end - result.started, end - result.prepared)
    schema = T.StructType(
        score.select(*columns).schema.fields + [T.StructField(t, T.DoubleType()) for t in _TIMES]
    )
    report = result.dataset.spark.createDataFrame([(*row, *seconds)], schema)
    return report.withColumns({t: round_half_even(F.col(t)) for t in _TIMES})


def report_lines(report: DataFrame) -> DataFrame:
    """The report as text lines, in reading order (column ``value``)."""

    def line(text: str, value: Column) -> Column:
        return F.concat(F.lit(text), F.coalesce(value.cast("string"), F.lit("-")))

    parts = [
        F.array(
            line("Input: ", F.col("input")),
            line("Partitions: ", F.col("num_partitions")),
            F.lit("Level-0 models:"),
        ),
        F.col("level0_models"),
        F.when(
            F.col("level1_model").isNotNull(), F.array(line("Level-1 model: ", F.col("level1_model")))
        ).otherwise(F.array().cast("array<string>")),
        F.array(line("Accuracy: ", F.col("accuracy_rounded"))),
    ]
    if all(t in report.columns for t in _TIMES):
        parts.append(
            F.array(
                F.concat(line("Total time: ", F.col("total_seconds")), F.lit("s")),
                F.concat(line("Execution time: ", F.col("execution_seconds")), F.lit("s")),
            )
        )
    return report.select(F.explode(F.concat(*parts)).alias("value"))


def write_report(report: DataFrame, path: str, format: str = "json", mode: str = "overwrite") -> None:
    """Write a report to any folder Spark can write to. A report is one row."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if format == "text":
        report_lines(report).coalesce(1).write.mode(mode).text(path)
    else:
        report.coalesce(1).write.mode(mode).format(format).save(path)
