"""Fits: closed form against the library, missing classes, learning, weights."""

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from quorum import ModelSpec, fit
from quorum.functions.hashing import uniform
from quorum.operators import linear
from quorum.operators import naive_bayes as bayes
from quorum.operators.linear import LinearModel, predict_many
from quorum.operators.models import LABEL, VECTOR, run_parallel, training_points
from quorum.operators.pseudo import transform_all

NB = ModelSpec.of("NB", 1.0)
LR = ModelSpec.of("LR", 3)
DT = ModelSpec.of("DT", 3, 5, 32)
ALL = [NB, LR, DT]


def points(spark, n=4000):
    """Class = which of the first three features is largest; near-ties are left out."""
    xs = [uniform(f"x{j}", ["row_id"]).alias(f"x{j}") for j in range(4)]
    df = spark.range(n).withColumnRenamed("id", "row_id").select("row_id", *xs)
    best = F.greatest("x0", "x1", "x2")
    label = F.when(F.col("x0") == best, 0.0).when(F.col("x1") == best, 1.0).otherwise(2.0)
    second = F.sort_array(F.array("x0", "x1", "x2"))[1]
    df = df.filter(best - second > 0.1)
    return df.select("row_id", F.array("x0", "x1", "x2", "x3").alias("features"), label.alias("label"))


@pytest.fixture(scope="module")
def separable(spark):
    df = points(spark).persist()
    yield df
    df.unpersist()


def accuracy_of(model, df):
    scored = transform_all(df, [model])
    return scored.agg(F.avg((F.col("p0") == F.col("label")).cast("double"))).collect()[0][0]


@pytest.mark.parametrize("spec, floor", [(NB, 0.8), (LR, 0.99), (DT, 0.9)])
def test_models_learn(separable, spec, floor):
    assert accuracy_of(fit(separable, spec, 3), separable) > floor


def test_lr_is_at_a_stationary_point(separable):
    model = fit(separable, LR, 3)
    noisy = separable.withColumn("label", F.when(F.col("row_id") % 4 == 0, 0.0).otherwise(F.col("label")))
    model = fit(noisy, LR, 3)
    rows = noisy.collect()
    x = np.array([r.features for r in rows])
    y = np.eye(3)[[int(r.label) for r in rows]]
    z = x @ model.weights.T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    assert np.abs((p - y).T @ x).max() / len(rows) < 1e-3


@pytest.mark.parametrize("spec", ALL)
def test_missing_class_keeps_the_ids_of_the_others(separable, spec):
    train = separable.filter(F.col("label") != 1.0)
    model = fit(train, spec, 3)
    scored = transform_all(train, [model])
    assert {r[0] for r in scored.select("p0").distinct().collect()} == {0.0, 2.0}
    assert accuracy_of(model, train) > 0.8


@pytest.mark.parametrize("spec", ALL)
def test_one_class(separable, spec):
    train = separable.filter(F.col("label") == 2.0)
    assert accuracy_of(fit(train, spec, 3), train) == 1.0


@pytest.mark.parametrize("spec", [LR, DT])
def test_two_classes(separable, spec):
    two = separable.filter(F.col("label") < 2.0)
    assert accuracy_of(fit(two, ModelSpec(spec.code), 2), two) > 0.9


def test_num_classes_is_a_lower_bound(separable):
    narrow, wide = fit(separable, ModelSpec.of("LR", 2), 3), fit(separable, ModelSpec.of("LR", 10), 3)
    assert len(narrow.classes) == 3 and len(wide.classes) == 10
    assert accuracy_of(wide, separable) > 0.99


@pytest.mark.parametrize("spec", ALL)
def test_a_weight_is_as_good_as_copies(separable, spec):
    weighted = separable.withColumn("weight", (F.col("row_id") % 3).cast("int"))
    copies = weighted.filter("weight > 0").withColumn("c", F.explode(F.sequence(F.lit(1), "weight")))
    a = transform_all(separable, [fit(weighted, spec, 3, weight="weight")])
    b = transform_all(separable, [fit(copies, spec, 3)])
    left = sorted((r.row_id, r.p0) for r in a.collect())
    right = sorted((r.row_id, r.p0) for r in b.collect())
    wrong = sum(x != y for x, y in zip(left, right))
    assert wrong <= len(left) * 0.001


def test_grouped_bayes_equals_the_library(separable):
    folded = separable.withColumn("fold", (F.col("row_id") % 4).cast("int"))
    sums = bayes.collect_sums(bayes.grouped_sums(folded, 4, ["fold"]), "fold")
    for k in range(4):
        ours = bayes.model_from_sums(bayes.complement_sums(sums, k), 0.5)
        train = training_points(folded.filter(F.col("fold") != k), 3)
        library = NaiveBayes(smoothing=0.5, featuresCol=VECTOR, labelCol=LABEL).fit(train)
        assert np.allclose(ours.intercepts, library.pi.toArray(), atol=1e-12)
        assert np.allclose(ours.weights, library.theta.toArray(), atol=1e-12)


def test_bag_sums_equal_single_samples(separable):
    bagged = separable.withColumns({f"w{b}": ((F.col("row_id") + b) % 3).cast("int") for b in range(3)})
    together = bayes.collect_sums(bayes.bag_sums(bagged, 4, ["w0", "w1", "w2"]), "bag")
    for b in range(3):
        alone = bayes.collect_sums(bayes.grouped_sums(bagged, 4, weight=f"w{b}"))[None]
        for label in alone:
            assert together[b][label][0] == alone[label][0]
            assert np.allclose(together[b][label][1], alone[label][1])


def test_wide_sums_equal_narrow_ones(separable, monkeypatch):
    bagged = separable.withColumns({f"w{b}": ((F.col("row_id") + b) % 3).cast("int") for b in range(2)})
    narrow = bayes.collect_sums(bayes.bag_sums(bagged, 4, ["w0", "w1"]), "bag")
    monkeypatch.setattr(bayes, "SUM_LIMIT", 1)
    wide = bayes.collect_sums(bayes.bag_sums(bagged, 4, ["w0", "w1"]), "bag")
    for b in narrow:
        for label in narrow[b]:
            assert narrow[b][label][0] == wide[b][label][0]
            assert np.allclose(narrow[b][label][1], wide[b][label][1])


@pytest.mark.parametrize("bad", [-0.5, float("nan"), float("inf")])
@pytest.mark.parametrize("limit", [64, 1])
def test_bayes_refuses_bad_features(spark, monkeypatch, bad, limit):
    monkeypatch.setattr(bayes, "SUM_LIMIT", limit)
    df = spark.createDataFrame([([0.1, 0.2], 0.0), ([0.3, bad], 1.0)], "features array<double>, label double")
    with pytest.raises(Exception):
        bayes.collect_sums(bayes.grouped_sums(df, 2))
    with pytest.raises(Exception):
        fit(df, NB, 2)


def test_compiled_and_batched_scores_agree(separable, monkeypatch):
    rng = np.random.default_rng(5)
    classes = (0.0, 2.0, 5.0)
    models = [LinearModel(classes, rng.normal(size=3), rng.normal(size=(3, 4))) for _ in range(4)]
    models.append(LinearModel((1.0,), np.zeros(1), np.zeros((1, 4))))
    df = separable.withColumn("fold", (F.col("row_id") % 6).cast("int"))

    def run():
        chosen = predict_many(df, [models, models[::-1]], ["a", "b"], "fold")
        single = predict_many(chosen, [models[:1]], ["c"])
        return sorted(tuple(r) for r in single.select("row_id", "fold", "a", "b", "c").collect())

    monkeypatch.setattr(linear, "UNROLL_TERMS", 10**6)
    monkeypatch.setattr(linear, "UNROLL_TERMS_CHOSEN", 10**6)
    compiled = run()
    monkeypatch.setattr(linear, "UNROLL_TERMS", 0)
    monkeypatch.setattr(linear, "UNROLL_TERMS_CHOSEN", 0)
    batched = run()
    assert [repr(r) for r in compiled] == [repr(r) for r in batched]
    assert all((r[2] is None) == (r[1] == 5) for r in compiled)
    assert {r[2] for r in compiled if r[1] == 4} == {1.0}
    assert {r[4] for r in compiled} <= set(classes)


def test_near_ties_and_ragged_rows_are_alike_on_both_paths(spark, monkeypatch):
    """Scores that differ in their last bits only: any other order of summing would show."""
    rng = np.random.default_rng(9)
    base = rng.random((500, 6))
    rows = [(i, [float(v) for v in np.concatenate([r, r[::-1]])]) for i, r in enumerate(base)]
    df = spark.createDataFrame(rows, "id int, features array<double>")
    w = rng.random(12)
    model = LinearModel((0.0, 1.0, 2.0), np.full(3, 0.1), np.stack([w, w[::-1], np.roll(w, 6)[::-1]]))
    ragged = spark.createDataFrame([(1, [0.5] * 11), (2, [0.5] * 13)], df.schema)
    got = []
    for limit in (10**6, 0):
        monkeypatch.setattr(linear, "UNROLL_TERMS", limit)
        got.append(sorted((r.id, r.p) for r in predict_many(df, [[model]], ["p"]).collect()))
        for i in (1, 2):
            with pytest.raises(Exception, match="must hold 12 features"):
                predict_many(ragged.filter(F.col("id") == i), [[model]], ["p"]).collect()
    assert got[0] == got[1] and len({p for _, p in got[0]}) > 1


def test_ties_go_to_the_lowest_class(separable):
    flat = LinearModel((0.0, 1.0, 2.0), np.zeros(3), np.zeros((3, 4)))
    assert {r.p0 for r in transform_all(separable, [flat]).collect()} == {0.0}


def test_specifications():
    assert ModelSpec.of("DT", 3, 5, 32).describe() == "DT 3 5 32"
    assert ModelSpec.of("LR", 10).describe() == "LR 10" and NB.describe() == "NB 1.0"
    for bad in (lambda: ModelSpec.of("XX"), lambda: ModelSpec.of("NB", -1.0), lambda: ModelSpec.of("DT", 3, 5, 1)):
        with pytest.raises(ValueError):
            bad()


def test_a_failing_fit_raises(spark):
    def fails():
        raise RuntimeError("no luck")

    with pytest.raises(RuntimeError, match="no luck"):
        run_parallel(spark, [lambda: 1, fails, lambda: 3], 2)
    assert run_parallel(spark, [lambda i=i: i for i in range(5)], 3) == list(range(5))
