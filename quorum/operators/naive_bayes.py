"""Multinomial naive Bayes for many samples at once.

The model is a function of weighted sums per class. Sums per (sample, class) for every
bag, fold or pseudo-label set come from one grouped aggregate with map-side combine: what
is shuffled and collected is one row per sample and class, never a data row.

For one sample ``quorum.operators.models`` uses ``pyspark.ml``'s estimator instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.operators.linear import LinearModel

# Up to this many features there is one compiled sum per feature; beyond it one vector
# summary per group.
SUM_LIMIT = 64


def grouped_sums(
    df: DataFrame, n_input: int, group: Sequence[str] = (), label: str = "label", weight: str | None = None
) -> DataFrame:
    """Weight and feature sums per (group, label): columns ``n``, ``sums``, ``low``.

    ``low`` is the smallest feature value, which tells whether the fit is legal.
    Rows of weight 0 do not take part.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    extra = [] if weight is None else [w.alias("_w")]
    if n_input <= SUM_LIMIT:
        xs = [F.col("features")[j].alias(f"_x{j}") for j in range(n_input)]
        rows = df.select(*group, F.col(label).alias("label"), *extra, *xs)
        if weight is not None:
            rows = rows.filter(F.col("_w") > 0)
        xs = [F.col(f"_x{j}") for j in range(n_input)]
        low = F.least(*xs) if n_input > 1 else xs[0]
        if weight is None:
            n, sums = F.count("*").cast("double"), [F.sum(x) for x in xs]
        else:
            n, sums = F.sum("_w"), [F.sum(x * F.col("_w")) for x in xs]
        sums = [s.alias(f"_s{j}") for j, s in enumerate(sums)]
        out = rows.groupBy(*group, "label").agg(n.alias("n"), F.min(low).alias("low"), *sums)
        return out.select(
            *group, "label", "n", F.array(*[f"_s{j}" for j in range(n_input)]).alias("sums"), "low"
        )
    rows = df.select(
        *group, F.col(label).alias("label"), w.alias("_w"), array_to_vector("features").alias("_v")
    ).filter(F.col("_w") > 0)
    summary = Summarizer.metrics("sum", "min").summary(F.col("_v"), F.col("_w"))
    out = rows.groupBy(*group, "label").agg(F.sum("_w").alias("n"), summary.alias("_m"))
    return out.select(
        *group,
        "label",
        "n",
        vector_to_array("_m.sum").alias("sums"),
        F.array_min(vector_to_array("_m.min")).alias("low"),
    )


def bag_sums(df: DataFrame, n_input: int, bags: Sequence[str], label: str = "label") -> DataFrame:
    """:func:`grouped_sums` of several weighted samples in one pass.

    ``bags`` names one weight column per sample; the result has the position of the sample
    as ``bag``. A row is repeated once per sample that drew it, inside the task, and the
    copies meet the map-side aggregate at once.
    """
    # The generator is given an expression and not a column: Spark would add a filter on a
    # column's size, and evaluate the column twice for it.
    spread = F.posexplode(F.array(*bags)).alias("bag", "_bag_weight")
    if n_input > SUM_LIMIT:
        rows = df.select(F.col(label).alias("label"), "features", spread)
    else:
        # The features leave their array before the rows multiply.
        names = [f"_f{j}" for j in range(n_input)]
        xs = [F.col("features")[j].alias(name) for j, name in enumerate(names)]
        rows = df.select(F.col(label).alias("label"), *xs, *bags).select("label", *names, spread)
        rows = rows.select("label", "bag", "_bag_weight", F.array(*names).alias("features"))
    return grouped_sums(rows.filter(F.col("_bag_weight") > 0), n_input, ["bag"], "label", "_bag_weight")


def collect_sums(sums: DataFrame, group: str | None = None) -> dict:
    """``{group: {label: (n, sums)}}`` on the driver; its size is that of the models."""
    collected: dict = {}
    for row in sums.collect():
        values = np.array(row["sums"], dtype=float)
        if row["low"] is None or row["low"] < 0 or not np.isfinite(values).all():
            raise ValueError("naive Bayes needs features that are finite and not negative")
        collected.setdefault(row[group] if group else None, {})[row["label"]] = (row["n"], values)
    return collected


def merge_sums(parts) -> dict:
    """Sums of the union of disjoint samples."""
    merged: dict = {}
    for part in parts:
        for label, (n, values) in part.items():
            old_n, old_values = merged.get(label, (0.0, 0.0))
            merged[label] = (old_n + n, old_values + values)
    return merged


def complement_sums(by_fold: dict, fold: int) -> dict:
    """Sums of all folds but one. Adding the others keeps every sum exactly non-negative."""
    return merge_sums(part for k, part in sorted(by_fold.items()) if k != fold)


def mask_sums(sums: dict, keep: Sequence[bool]) -> dict:
    """Sums of the sample after its masked attributes were set to 0."""
    flags = np.array(keep, dtype=bool)
    return {label: (n, np.where(flags, values, 0.0)) for label, (n, values) in sums.items()}


def model_from_sums(sums: dict, smoothing: float = 1.0) -> LinearModel:
    """Log priors and log likelihoods. Classes without rows are not in the model, and the
    others keep their own ids."""
    if not sums:
        raise ValueError("naive Bayes was given no rows")
    if smoothing <= 0:
        raise ValueError("smoothing must be positive")
    labels = sorted(sums)
    total = sum(sums[c][0] for c in labels)
    intercepts, weights = [], []
    for c in labels:
        n, values = sums[c]
        intercepts.append(math.log(n + smoothing) - math.log(total + len(labels) * smoothing))
        weights.append(
            np.log(values + smoothing) - math.log(float(values.sum()) + len(values) * smoothing)
        )
    return LinearModel(tuple(labels), np.array(intercepts), np.array(weights))
