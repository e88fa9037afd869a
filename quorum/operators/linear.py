"""Models whose prediction is the first best of one linear score per class.

Naive Bayes and logistic regression both are. Their prediction is an expression over
constants that runs in the same stage as the scan and needs no vector column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Up to this many products in one projection all scores are compiled expressions; beyond it
# they are summed per Arrow batch, in the same order, so that both give the same bits. The
# limits are where the JVM stops compiling
# the generated method (8,000 bytecodes): past them the expression is ten times slower than
# the batches. A product whose weight depends on the row takes more code.
UNROLL_TERMS = 96
UNROLL_TERMS_CHOSEN = 24


@dataclass(frozen=True, eq=False)
class LinearModel:
    """Class ids in ascending order, one intercept and one weight row per class."""

    classes: tuple[float, ...]
    intercepts: np.ndarray
    weights: np.ndarray

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Add the predicted class id."""
        return predict_many(df, [[self]], [out])


def _number(value: float) -> str:
    value = float(value)
    return f"({value!r}D)" if np.isfinite(value) else f"double('{value}')"


def _align(models: Sequence[LinearModel]) -> tuple[list[float], np.ndarray, np.ndarray]:
    """All models over the same classes; a class a model does not know cannot win."""
    classes = sorted({c for m in models for c in m.classes})
    d = models[0].weights.shape[1]
    intercepts = np.full((len(models), len(classes)), -np.inf)
    weights = np.zeros((len(models), len(classes), d))
    for k, m in enumerate(models):
        at = [classes.index(c) for c in m.classes]
        intercepts[k, at] = m.intercepts
        weights[k, at] = m.weights
    return classes, intercepts, weights


def _unrolled(intercepts: np.ndarray, weights: np.ndarray, offset: str) -> str:
    """SQL text of the position of the best class. SQL text, because a column object per
    operation takes longer to build than the rows take to score."""
    n_models, n_classes, d = weights.shape
    if n_models == 1:
        flat = None
    else:
        # One short constant expression, folded to a literal array before the scan starts.
        values = np.concatenate([intercepts, weights.reshape(n_models, -1)], axis=1)
        flat = f"cast(split('{','.join(repr(float(v)) for v in values.ravel())}', ',') AS array<double>)"

    def at(i: int, literal: float) -> str:
        return _number(literal) if flat is None else f"get({flat}, {offset} + {i})"

    ranked = []
    for c in range(n_classes):
        score = at(c, intercepts[0, c])
        for j in range(d):
            score += f" + {at(n_classes + c * d + j, weights[0, c, j])} * features[{j}]"
        # The first of the best: a higher score wins, then the lower class.
        ranked.append(f"struct({score} AS score, {-c} AS rank)")
    return f"-array_max(array({', '.join(ranked)})).rank"


def _batched(intercepts: np.ndarray, weights: np.ndarray):
    """The same position, from one pass over the columns per model and Arrow batch."""
    d = weights.shape[2]

    def scores(x: np.ndarray, k: int) -> np.ndarray:
        # From the intercept on, feature by feature: a matrix product would round otherwise.
        out = np.repeat(intercepts[k][None, :], len(x), axis=0)
        for j in range(d):
            out += x[:, j, None] * weights[k][None, :, j]
        return out

    @F.arrow_udf("int")
    def best(features: pa.Array, model: pa.Array) -> pa.Array:
        x = features.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        chosen = model.to_numpy(zero_copy_only=False)
        out = np.zeros(len(x), dtype=np.int32)
        for k in np.unique(chosen):
            rows = chosen == k
            out[rows] = scores(x[rows], k).argmax(axis=1)
        return pa.array(out)

    return best


def predict_many(
    df: DataFrame,
    model_sets: Sequence[Sequence[LinearModel]],
    names: Sequence[str],
    chooser: str | None = None,
) -> DataFrame:
    """Add one predicted class column per model set.

    Without a chooser a set is a single model. With one, a row uses ``models[row[chooser]]``
    of every set: the coefficients of all models are one constant and the row picks its
    own, so out-of-fold prediction of all folds is one scan without a join. A row whose
    choice has no model gets NULL.
    """
    aligned = [_align(models) for models in model_sets]
    for d in {weights.shape[2] for _, _, weights in aligned}:
        # Once per row and beside the scores: inside of each it made the generated method too
        # large for the JVM to compile.
        df = df.filter(f"if(size(features) <=> {d}, true, raise_error('a row must hold {d} features'))")
    terms = sum(w.shape[1] * w.shape[2] for _, _, w in aligned)
    compiled = terms <= (UNROLL_TERMS if chooser is None else UNROLL_TERMS_CHOSEN)
    pick = F.lit(0) if chooser is None else F.col(chooser)
    offsets, predicted = {}, {}
    for name, (classes, intercepts, weights) in zip(names, aligned):
        n_models, n_classes, d = weights.shape
        if compiled:
            offset = f"_offset_{name}"
            if n_models > 1:
                offsets[offset] = (pick * (n_classes * (d + 1))).cast("int")
            best = F.expr(_unrolled(intercepts, weights, offset))
        else:
            best = _batched(intercepts, weights)(
                "features", F.least(pick, F.lit(n_models - 1)).cast("int")
            )
        if classes == [float(i) for i in range(n_classes)]:
            label = best.cast("double")
        else:
            label = F.array(*[F.lit(c) for c in classes])[best]
        if chooser is not None:
            label = F.when(pick < n_models, label)
        predicted[name] = label
    if offsets:
        df = df.withColumns(offsets)
    return df.withColumns(predicted).drop(*offsets)
