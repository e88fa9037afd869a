"""Fits of all members at once against fits of one."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.sql import functions as F

from quorum.operators import logistic, trees
from quorum.operators.models import LABEL, VECTOR, training_points
from quorum.operators.pseudo import out_of_fold, transform_all

MEMBERS = 3


@pytest.fixture(scope="module")
def rows(spark):
    """Two inputs of few values and one of many; classes overlap."""
    rng = np.random.default_rng(5)
    n = 3000
    x = np.stack([rng.integers(0, 12, n) / 11, rng.integers(0, 7, n) / 6, rng.random(n)], axis=1)
    y = (x + rng.gumbel(0, 0.25, x.shape)).argmax(axis=1)
    w = rng.poisson(0.8, (n, MEMBERS))
    data = [(i, *map(float, x[i]), float(y[i]), [float(v) for v in w[i]]) for i in range(n)]
    frame = spark.createDataFrame(data, "row_id long, a double, b double, c double, label double, weights array<double>")
    return frame.withColumn("features", F.array("a", "b", "c")).repartition(3).cache()


def member(rows, m):
    return rows.withColumn("weight", F.col("weights")[m])


def test_regressions_equal_the_library(rows):
    fitted = logistic.fit_members(rows, range(MEMBERS), 3, 3)
    for m in range(MEMBERS):
        points = training_points(member(rows, m), 3, "weight")
        library = LogisticRegression(
            family="multinomial", fitIntercept=False, tol=1e-12, maxIter=500, featuresCol=VECTOR, labelCol=LABEL, weightCol="weight"
        ).fit(points)
        assert np.allclose(fitted[m].weights, library.coefficientMatrix.toArray(), atol=1e-4)


def test_two_classes_share_a_weight(rows):
    two = rows.filter("label < 2")
    fitted = logistic.fit_members(two, [1], 2, 3)[1]
    library = LogisticRegression(
        family="binomial", fitIntercept=False, tol=1e-12, maxIter=500, featuresCol=VECTOR, labelCol=LABEL, weightCol="weight"
    ).fit(training_points(member(two, 1), 2, "weight"))
    assert (fitted.weights[0] == 0).all()
    assert np.allclose(fitted.weights[1], library.coefficients.toArray(), atol=1e-4)


def test_masked_features_have_no_weight(rows):
    masks = [[True, False, True]] * MEMBERS
    masked = rows.withColumn("features", F.array("a", F.lit(0.0), "c"))
    a = logistic.fit_members(rows, [0], 3, 3, masks)[0]
    b = logistic.fit_members(masked, [0], 3, 3)[0]
    assert (a.weights[:, 1] == 0).all() and np.allclose(a.weights, b.weights, atol=1e-9)
    tree = trees.fit_members(rows, [0], 3, 3, 3, 16, masks)[0]
    assert 1 not in tree.features[np.isfinite(tree.thresholds)]


@pytest.mark.parametrize("cache", [None, False, "checkpoint"])
def test_storage_changes_nothing(rows, cache):
    kept_ = logistic.fit_members(rows, [0], 3, 3)[0]
    assert np.allclose(kept_.weights, logistic.fit_members(rows, [0], 3, 3, cache=cache)[0].weights, atol=1e-9)


def test_trees_equal_the_library(rows):
    few = rows.withColumn("features", F.array("a", "b"))
    fitted = trees.fit_members(few, range(MEMBERS), 3, 2, 4, 16)
    for m in range(MEMBERS):
        points = training_points(member(few, m), 3, "weight")
        library = DecisionTreeClassifier(maxDepth=4, maxBins=16, seed=0, featuresCol=VECTOR, labelCol=LABEL, weightCol="weight")
        scored = transform_all(few, [fitted[m]]).withColumn(VECTOR, F.col("features"))
        ours = {r.row_id: r.p0 for r in scored.collect()}
        test = training_points(few.withColumn("one", F.lit(1.0)), 3, "one")
        theirs = library.fit(points).transform(test).groupBy(VECTOR).agg(F.first("prediction").alias("p")).collect()
        by_point = {tuple(r[VECTOR].toArray()): r.p for r in theirs}
        assert all(by_point[tuple(r.features)] == ours[r.row_id] for r in few.collect())


def test_a_feature_of_many_values_is_cut_at_quantiles(rows):
    """Quantiles are approximate on both sides, so the trees may differ, but not in worth."""
    tree = trees.fit_members(rows, [0], 3, 3, 5, 16)[0]
    library = DecisionTreeClassifier(maxDepth=5, maxBins=16, seed=0, featuresCol=VECTOR, labelCol=LABEL, weightCol="weight")
    points = training_points(rows.withColumn("one", F.lit(1.0)), 3, "one")
    theirs = library.fit(training_points(member(rows, 0), 3, "weight")).transform(points)
    theirs = theirs.filter(F.col("prediction") == F.col(LABEL)).count()
    ours = transform_all(rows, [tree]).filter("p0 = label").count()
    assert 2 in tree.features[np.isfinite(tree.thresholds)]
    assert abs(ours - theirs) < 0.02 * rows.count()


def test_trees_of_other_depths_and_folds(rows):
    folded = rows.withColumn("fold", (F.col("row_id") % 4).cast("int"))
    weights = F.array(*[(F.col("fold") != k).cast("double") for k in range(3)])
    sample = folded.withColumn("weights", weights)
    deep, flat = trees.fit_members(sample, range(3), 3, 3, 3, 16), trees.fit_members(sample, range(3), 3, 3, 0, 16)
    regressions = logistic.fit_members(sample, range(3), 3, 3)
    sets = [[deep[0], flat[1], deep[2]], [regressions[k] for k in range(3)]]
    got = out_of_fold(folded, sets).collect()
    alone = {k: {r.row_id: (r.p0, r.p1) for r in transform_all(folded, [s[k] for s in sets]).collect()} for k in range(3)}
    for r in got:
        assert (r.p0, r.p1) == ((None, None) if r.fold == 3 else alone[r.fold][r.row_id])
    assert len({p for p, _ in alone[1].values()}) == 1


def test_no_number_goes_right(spark, rows):
    tree = trees.fit_members(rows, [0], 3, 3, 1, 16)[0]
    j = int(tree.features[0])
    at = [[float("nan") if i == j else 0.5 for i in range(3)], [1e9 if i == j else 0.5 for i in range(3)]]
    got = transform_all(spark.createDataFrame([(x,) for x in at], "features array<double>"), [tree]).collect()
    assert got[0].p0 == got[1].p0 == tree.leaves[1]


@pytest.mark.parametrize("fit", [logistic.fit_members, lambda *a: trees.fit_members(*a, 2, 16)])
def test_rows_that_cannot_be_fitted_raise(rows, fit):
    for bad, message in (
        (rows.withColumn("label", F.lit(7.0)), "labels must be"),
        (rows.withColumn("features", F.array("a")), "must hold 3 features"),
        (rows.withColumn("weights", F.array(F.lit(0.0))), "no rows"),
    ):
        with pytest.raises(Exception, match=message):
            fit(bad, [0], 3, 3)


def test_a_class_without_rows_never_wins(rows):
    fitted = logistic.fit_members(rows.filter("label <> 1"), [0], 4, 3)[0]
    got = transform_all(rows, [fitted])
    assert {r[0] for r in got.select("p0").distinct().collect()} == {0.0, 2.0}
