import pytest
"""Expressions on small inputs, and their properties."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorum.functions.encode import (
    WIDE_DOMAIN,
    class_onehot,
    label_from_onehot,
    mask_features,
    nominal_code,
    rescale,
    rescale_array,
    round_half_even,
)
from quorum.functions.hashing import uniform, uniform_of
from quorum.functions.vote import plurality_vote, vote_counts
from quorum.operators.sampling import attribute_mask, poisson_cdf


def values(df):
    return [r[0] for r in df.collect()]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (0.996,)], "x double")
    assert values(df.select(round_half_even(F.col("x")))) == [0.12, 0.38, 1.0]


def test_label_is_the_last_one_or_minus_one(spark):
    rows = [([1.0, 0.0, 1.0],), ([0.0, 0.0],), ([0.5, 1.0],), ([2.0],)]
    df = spark.createDataFrame(rows, "a array<double>")
    assert values(df.select(label_from_onehot(F.col("a")))) == [2.0, -1.0, 1.0, -1.0]


def test_label_of_onehot_is_the_class(spark):
    for n in (3, 70):
        df = spark.range(n).select(F.col("id").cast("double").alias("c"))
        df = df.select("c", label_from_onehot(class_onehot(F.col("c"), n)).alias("back"))
        assert all(r.c == r.back for r in df.collect())


def test_nominal_code(spark):
    df = spark.createDataFrame([("b",), ("z",), (None,)], "v string")
    assert values(df.select(nominal_code(F.col("v"), ["a", "b", "b"]))) == [1.0, -1.0, -1.0]


def test_nominal_code_of_a_long_list(spark):
    """100,000 declared values: the same codes as a dictionary's, from a plan of the same size."""
    declared = [f"é{i % 99_000}" for i in range(100_000)] + ["", "a,b", "|"]
    first = {v: i for i, v in reversed(list(enumerate(declared)))}
    shown = [*declared[:50_000], "é99000", "é", " ", None]
    df = spark.createDataFrame([(v,) for v in [*shown, "", "a,b", "|"]], "v string")
    got = df.select("v", nominal_code(F.col("v"), declared).alias("c")).collect()
    assert [r.c for r in got] == [first.get(r.v, -1) for r in got]

    def nodes(n):
        plan = spark.range(1).select(nominal_code(F.col("id").cast("string"), [str(i) for i in range(n)]))
        return plan._jdf.queryExecution().analyzed().expressions().apply(0).treeString().count("\n")

    assert nodes(WIDE_DOMAIN + 1) == nodes(50 * WIDE_DOMAIN)
    many = spark.range(2_000_000).select(nominal_code((F.col("id") % 90_000).cast("string"), [str(i) for i in range(90_000)]).alias("c"))
    assert many.agg(F.sum("c")).first()[0] == sum(i % 90_000 for i in range(2_000_000))  # 10^11 steps, were the list walked


def test_rescale_maps_the_ends_to_zero_and_one(spark):
    df = spark.createDataFrame([(2.0,), (7.0,)], "x double")
    assert values(df.select(rescale(F.col("x"), 2, 7))) == [0.0, 1.0]


def test_long_arrays_equal_short_ones(spark):
    n = 70
    row = [float(i) for i in range(n)]
    lows, highs = [float(i % 3) for i in range(n)], [float(i % 3 + i % 5) for i in range(n)]
    df = spark.createDataFrame([(row,)], "a array<double>")
    got = values(df.select(rescale_array(F.col("a"), lows, highs)))[0]
    for x, lo, hi, y in zip(row, lows, highs, got):
        if hi != lo:
            assert y == (x - lo) / (hi - lo)
        else:
            assert math.isnan(y) if x == lo else y == math.inf * (1 if x > lo else -1)
    keep = [i % 2 == 0 for i in range(n)]
    masked = values(df.select(mask_features(F.col("a"), keep)))[0]
    assert masked == [x if k else 0.0 for x, k in zip(row, keep)]


def test_vote_fixture(spark):
    rows = [([0.0, 1.0],), ([2.0, 2.0, 1.0],), ([-1.0, -1.0],), ([-1.0, 2.0],), ([5.0],), ([1.0, 2.0, 2.0, 1.0],)]
    df = spark.createDataFrame(rows, "p array<double>")
    assert values(df.select(plurality_vote(F.col("p"), 3))) == [0.0, 2.0, 0.0, 2.0, 0.0, 1.0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from([-1.0, 0.0, 1.0, 2.0, 3.0]), min_size=3, max_size=3), min_size=1, max_size=20))
def test_vote_ignores_the_order_of_models(spark, votes):
    df = spark.createDataFrame(votes, "a double, b double, c double")
    abc = [F.col(c) for c in "abc"]
    forward = df.select(plurality_vote(abc, 4), plurality_vote(abc[::-1], 4), plurality_vote(F.array(*abc), 4))
    for row, given_votes in zip(forward.collect(), votes):
        counts = [given_votes.count(float(c)) for c in range(4)]
        assert set(row) == {float(counts.index(max(counts)))}
    assert [sum(c) for c in values(df.select(vote_counts(abc, 4)))] == [
        sum(v >= 0 for v in row) for row in votes
    ]


def test_uniform_is_the_same_on_the_driver(spark):
    df = spark.createDataFrame([("a", 1), ("b", 22)], "k string, n bigint")
    got = values(df.select(uniform("salt", ["k", "n"])))
    assert got == [uniform_of("salt|a|1"), uniform_of("salt|b|22")]


def test_every_method_is_uniform(spark):
    for method in ("md5", "xxhash64", "random"):
        df = spark.range(20000).select(uniform("s", ["id"], method).alias("u"))
        row = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.variance("u")).collect()[0]
        assert row[0] >= 0 and row[1] < 1
        assert abs(row[2] - 0.5) < 0.01 and abs(row[3] - 1 / 12) < 0.005


def test_poisson_and_masks():
    cdf = poisson_cdf(0.66, 32)
    assert cdf[0] == math.exp(-0.66) and all(a < b < 1 for a, b in zip(cdf, cdf[1:]))
    assert [attribute_mask(b, 4) for b in range(3)] == [
        [True, True, False, True],
        [True, True, True, False],
        [True, True, True, True],
    ]
    kept = [k for b in range(500) for k in attribute_mask(b, 8)]
    assert abs(sum(kept) / len(kept) - 0.85) < 0.02
    assert attribute_mask(0, 64) != attribute_mask(0, 64, seed=7)


def test_rates_that_cannot_be_represented_are_refused():
    for rate in (0.0, -1.0, 800.0, 1200.0, float("nan")):
        with pytest.raises(ValueError, match="rate"):
            poisson_cdf(rate)
    cdf = poisson_cdf(400.0)
    mean = sum(1 - c for c in cdf)
    assert abs(mean - 400.0) < 1e-6 and cdf == sorted(cdf)


def test_draws_without_a_key_are_refused(spark):
    with pytest.raises(ValueError, match="key"):
        uniform("salt", [])
