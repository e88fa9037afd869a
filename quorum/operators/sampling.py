"""Splits, folds, bootstrap weights and attribute masks, all as columns or filters.

Nothing is sampled into a new set: a split or a fold is a predicate on the row's own
draw and a bootstrap sample is a weight, so M samples cost one scan and no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.functions.hashing import DRAWS_PER_DIGEST, digest, draw_of, salt_of, uniform, uniform_of

TRAIN_FRACTION = 0.6
FOLDS = 10
BAG_RATE = 0.66
KEEP_PROBABILITY = 0.85
# exp(-rate) and the sums after it keep their precision up to here.
MAX_RATE = 500.0
#: Copies of one row that a task writes out at a time.
COPY_BLOCK = 1 << 16


def numbered_copies(df: DataFrame, copy: str = "copy") -> DataFrame:
    """``df`` with ``copy``: 0, 1, 2, ... among rows that are equal in all columns.

    Which of them gets which number makes no difference, as they are equal: a row and its number
    identify it whatever the order, files, partitions or retries, and nothing is stored. Rows
    are counted, partly before the shuffle, and written out again from their counts; a row that
    makes up much of the table is dealt to the tasks in blocks of COPY_BLOCK.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPY_BLOCK).cast("long")))
    # The counts are few and small, so that Spark's adaptive plan would gather them into one task,
    # which would then write out the whole table: the blocks go to as many tasks as the rows fill.
    rows = counted.agg(F.sum("_n")).first()[0] or 0
    blocks = counted.withColumn("_first", first).repartition(max(2, -(-rows // COPY_BLOCK)), *df.columns, "_first")
    last = F.least(F.col("_first") + COPY_BLOCK, F.col("_n")) - 1
    return blocks.select(*df.columns, F.explode(F.sequence(F.col("_first"), last)).alias(copy))


def part_column(key, fraction=TRAIN_FRACTION, seed=None, method="md5") -> Column:
    """``'train'`` for a ``fraction`` of the rows, else ``'test'``."""
    u = uniform(salt_of("split", seed), key, method)
    return F.when(u < fraction, "train").otherwise("test")


def with_part(df: DataFrame, key, fraction=TRAIN_FRACTION, seed=None, method="md5") -> DataFrame:
    """Add the ``part`` column."""
    return df.withColumn("part", part_column(key, fraction, seed, method))


def train_test(df: DataFrame, key, fraction=TRAIN_FRACTION, seed=None, method="md5"):
    """The two parts as filters on the same input."""
    parts = with_part(df, key, fraction, seed, method)
    return tuple(parts.filter(F.col("part") == p).drop("part") for p in ("train", "test"))


def fold_column(key, folds=FOLDS, seed=None, method="md5") -> Column:
    """Fold number 0..folds-1, equally likely."""
    return F.floor(uniform(salt_of("fold", seed), key, method) * folds).cast("int")


def fold_complement_counts(df: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Rows held out and rows trained on, per fold, from one pass over a ``fold`` column."""
    total = F.lit(0)
    for k in range(folds):
        total = total + F.col(f"n{k}")
    wide = df.agg(*[F.count_if(F.col("fold") == k).alias(f"n{k}") for k in range(folds)])
    stacked = ", ".join(f"{k}, n{k}" for k in range(folds))
    return wide.withColumn("total", total).selectExpr(
        f"stack({folds}, {stacked}) AS (fold, held_out)", "total"
    ).select("fold", "held_out", (F.col("total") - F.col("held_out")).alias("trained_on"))


def poisson_cdf(rate: float, bits: int = 53) -> list[float]:
    """Cumulative Poisson probabilities, as far as a draw of ``bits`` bits can tell."""
    if not 0 < rate <= MAX_RATE:
        raise ValueError(f"the rate must be over 0 and at most {MAX_RATE:g}, not {rate}")
    cdf, term, k = [], math.exp(-rate), 0
    total = term
    # Beyond the mean the terms fall: the rest is nothing once one of them is.
    while total < 1.0 - 2.0**-bits and (k <= rate or term > 2.0 ** -(bits + 10)):
        cdf.append(total)
        k += 1
        term *= rate / k
        total += term
    return cdf


def poisson_weight(u: Column, rate: float = BAG_RATE, bits: int = 53) -> Column:
    """Poisson(``rate``) by inverse CDF of a uniform draw."""
    weight = F.lit(0)
    for bound in poisson_cdf(rate, bits):
        weight = weight + F.when(u >= bound, 1).otherwise(0)
    return weight


def bag_column(bag: int) -> str:
    """The weight column of a bag."""
    return f"bag{bag}"


def with_bag_weights(
    df: DataFrame, key, bags: int | Sequence[int], rate=BAG_RATE, seed=None, method="md5"
) -> DataFrame:
    """Add one column per bag: how often the row is drawn into it (0, 1, 2, ...)."""
    bags = range(bags) if isinstance(bags, int) else bags
    bits = 32 if method == "md5" else 53
    digests: dict[str, Column] = {}
    # The draw is a column of its own, so that it is computed once and not per comparison.
    if method == "md5":
        if not key:
            raise ValueError("md5 draws need key columns; without a key use method='random'")
        groups = sorted({b // DRAWS_PER_DIGEST for b in bags})
        digests = {f"_digest{g}": digest(salt_of(f"bags{g}", seed), key) for g in groups}
        draws = {f"_u{b}": draw_of(f"_digest{b // DRAWS_PER_DIGEST}", b % DRAWS_PER_DIGEST) for b in bags}
        df = df.withColumns(digests)
    else:
        draws = {f"_u{b}": uniform(salt_of(f"bag{b}", seed), key, method) for b in bags}
    weights = {bag_column(b): poisson_weight(F.col(f"_u{b}"), rate, bits) for b in bags}
    return df.withColumns(draws).withColumns(weights).drop(*digests, *draws)


def attribute_mask(bag: int, n_input: int, keep=KEEP_PROBABILITY, seed=None) -> list[bool]:
    """One draw per attribute of a bag; all rows of the bag share it. It may be all False."""
    salt = salt_of("mask", seed)
    return [uniform_of(f"{salt}|{bag}|{j}") < keep for j in range(n_input)]
