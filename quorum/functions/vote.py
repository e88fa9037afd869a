"""Combining the predictions of several models inside one row: no shuffle, no collect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL_TERMS = 512


def vote_counts(predictions: Sequence[Column] | Column, n_classes: int) -> Column:
    """Array of ``n_classes`` counts; a prediction that is no class index counts nowhere.

    ``predictions`` is a list of columns or one array column.
    """
    if isinstance(predictions, Column) or len(predictions) * n_classes > UNROLL_TERMS:
        votes = predictions if isinstance(predictions, Column) else F.array(*predictions)
        return F.transform(
            F.sequence(F.lit(0), F.lit(n_classes - 1)),
            lambda c: F.size(F.filter(votes, lambda p: p == c.cast("double"))),
        )
    counts = []
    for c in range(n_classes):
        hits = F.lit(0)
        for p in predictions:
            hits = hits + F.when(p == float(c), 1).otherwise(0)
        counts.append(hits)
    return F.array(*counts)


def plurality(counts: Column, n_classes: int) -> Column:
    """The class with most votes; ties go to the lowest class, no valid vote gives 0.0."""
    if n_classes <= UNROLL_TERMS:
        ranked = F.array(
            *[F.struct(counts[c].alias("votes"), F.lit(-c).alias("rank")) for c in range(n_classes)]
        )
    else:
        ranked = F.transform(counts, lambda v, c: F.struct(v.alias("votes"), (-c).alias("rank")))
    return (-F.array_max(ranked)["rank"]).cast("double")


def plurality_vote(predictions: Sequence[Column] | Column, n_classes: int) -> Column:
    """Plurality vote over the models of one row."""
    return plurality(vote_counts(predictions, n_classes), n_classes)
