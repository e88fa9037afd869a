"""Whole runs: known scores, invariances, switches, failures."""

import pytest
from pyspark.sql import functions as F

from conftest import SF, SF_SMALL
from quorum import ModelSpec, bagging, run_report, single_model, stacking
from quorum.checks import datasets as sets
from quorum.operators import sampling
from quorum.operators.pseudo import explode_predictions, weighted_pseudo_labels

NB = ModelSpec.of("NB", 1.0)
LR = ModelSpec.of("LR", 3)
DT = ModelSpec.of("DT", 3, 5, 32)


@pytest.fixture(scope="module")
def dominant(spark):
    return sets.lineitem_dominant(spark, SF)


@pytest.fixture(scope="module")
def small(spark):
    return sets.lineitem_dominant(spark, SF_SMALL)


def right(result):
    row = result.accuracy().collect()[0]
    return row["right"], row["total"]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize(
    "run, expected",
    [
        (lambda ds: single_model(ds, NB), 22872),
        (lambda ds: single_model(ds, LR), 24088),
        (lambda ds: single_model(ds, DT), 22624),
        (lambda ds: bagging(ds, [NB] * 3), 22530),
        (lambda ds: stacking(ds, [NB] * 2, NB), 17110),
        (lambda ds: stacking(ds, [NB] * 2, NB, drop_last_fold=True), 17065),
        (lambda ds: stacking(ds, [NB] * 2, NB, compat=True), 17065),
    ],
)
def test_known_scores(dominant, run, expected):
    assert right(run(dominant)) == (expected, 24088)


def test_parts_folds_and_bags(small):
    frame = sampling.with_part(small.frame, small.key)
    train, test = sampling.train_test(small.frame, small.key)
    assert train.count() + test.count() == small.frame.count()
    assert abs(train.count() / small.frame.count() - 0.6) < 0.03
    folded = train.withColumn("fold", sampling.fold_column(small.key))
    sizes = {r.fold: r["count"] for r in folded.groupBy("fold").count().collect()}
    assert set(sizes) == set(range(10)) and sum(sizes.values()) == train.count()
    weights = sampling.with_bag_weights(frame, small.key, 4)
    means = weights.agg(*[F.avg(sampling.bag_column(b)) for b in range(4)]).collect()[0]
    assert all(abs(m - 0.66) < 0.05 for m in means) and len(set(means)) == 4


@pytest.mark.parametrize(
    "run",
    [
        lambda ds: bagging(ds, [NB, NB, NB]),
        lambda ds: stacking(ds, [NB, NB], NB),
        lambda ds: single_model(ds, LR),
    ],
)
def test_results_do_not_depend_on_the_partitions(spark, small, run):
    spread = sets.from_table(
        sets.table(spark, SF_SMALL, "lineitem").repartition(7),
        sets.LINEITEM_REALS,
        F.lit(0),
        (0, 1, 2),
        sets.LINEITEM_KEY,
    )
    shuffled = small.__class__(small.frame.repartition(7), spread.meta, small.key)
    assert rows(run(small).predictions) == rows(run(shuffled).predictions)


@pytest.mark.parametrize("method", ["xxhash64", "random"])
def test_other_draws(small, method):
    result = bagging(small, [NB] * 3, method=method, seed=3)
    got, total = right(result)
    assert total == result.predictions.count() and 0.7 < got / total <= 1
    got, total = right(stacking(small, [NB] * 2, NB, method=method, seed=3))
    assert 0.4 < got / total <= 1


def test_seed_changes_the_draws(small):
    assert rows(bagging(small, [NB] * 2, seed=1).predictions) != rows(bagging(small, [NB] * 2).predictions)


@pytest.mark.parametrize("cache", [True, False, "checkpoint"])
def test_cache_modes_agree(small, cache):
    base = right(stacking(small, [NB, DT], NB))
    assert right(stacking(small, [NB, DT], NB, cache=cache, num_partitions=3)) == base


def test_no_frame_stays_cached(spark, small):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    bagging(small, [NB, LR])
    stacking(small, [NB, DT], LR)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_smoothing_is_honoured_unless_told_otherwise(small):
    heavy = ModelSpec.of("NB", 5000.0)
    fitted = lambda spec, **o: single_model(small, spec, **o).details["model"].intercepts
    assert (fitted(heavy) != fitted(NB)).any()
    for historic in ({"compat": True}, {"honour_smoothing": False}):
        assert (fitted(heavy, **historic) == fitted(NB)).all()
        (row,) = run_report(single_model(small, heavy, **historic), with_times=False).collect()
        assert row.level0_models == ["NB 1.0 (asked 5000.0)"]
    assert (fitted(ModelSpec.of("NB", 0.0), compat=True) == fitted(NB)).all()
    (row,) = run_report(single_model(small, heavy), with_times=False).collect()
    assert row.level0_models == ["NB 5000.0"]


def test_merged_copies_are_the_same_training_set(small):
    frame = small.frame.withColumns({"a": F.col("label"), "b": F.lit(1.0), "c": F.lit(1.0)})
    copies = explode_predictions(frame.select("features", "label", "a", "b", "c"), ["a", "b", "c"])
    merged = weighted_pseudo_labels(frame, [F.col(c) for c in "abc"], 3)
    x0 = F.col("features")[0]
    left = copies.groupBy("label").agg(F.count("*").cast("double"), F.round(F.sum(x0), 6))
    weighted = F.round(F.sum(x0 * F.col("weight")), 6)
    right_side = merged.groupBy("label").agg(F.sum("weight"), weighted)
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, right_side.collect()))
    assert merged.count() < copies.count()


def test_equal_members_are_fitted_once(small):
    assert stacking(small, [NB] * 5, NB).fits == 11
    assert stacking(small, [NB] * 5, NB, drop_last_fold=True).fits == 10


@pytest.mark.parametrize("dropped", [False, True])
def test_stacking_pseudo_labels_cover_the_used_folds(small, dropped):
    result = stacking(small, [NB, DT], NB, with_test_predictions=True, drop_last_fold=dropped)
    train, test = sampling.train_test(small.frame, small.key)
    used = train.withColumn("fold", sampling.fold_column(small.key)).filter(f"fold < {9 if dropped else 10}").count()
    assert result.details["pseudo_labels"].count() == used
    assert result.details["level1_training"].count() == 2 * used
    assert result.details["level1_test"].count() == 2 * test.count()
    assert result.details["pseudo_labels"].filter("pseudo0 IS NULL OR pseudo1 IS NULL").count() == 0


def test_two_level0_models_and_a_level1_model_are_needed(small):
    with pytest.raises(ValueError, match="two level-0"):
        bagging(small, [NB])
    with pytest.raises(ValueError, match="two level-0"):
        stacking(small, [NB], NB)
    with pytest.raises(ValueError, match="level-1"):
        stacking(small, [NB, NB], None)


def test_a_failing_member_raises(spark):
    df = spark.createDataFrame([(i, float(-i), i % 2) for i in range(60)], "id int, x double, y int")
    ds = sets.from_table(df, (sets.real("x", 0, 1),), "y", (0, 1), ["id"])
    for run in (lambda: bagging(ds, [NB, DT]), lambda: stacking(ds, [DT, NB], DT)):
        with pytest.raises(Exception, match="negative"):
            run()


def test_unknown_class_and_null_input(spark):
    df = spark.createDataFrame([(1, 0.5, "p"), (2, None, "p"), (3, 0.5, "z")], "id int, x double, y string")
    args = ((sets.real("x", 0, 1),), "y", ("p", "q"), ["id"])
    with pytest.raises(Exception, match="unknown class: z"):
        sets.from_table(df.filter("id <> 2"), *args).frame.collect()
    with pytest.raises(Exception, match="NULL in column x"):
        sets.from_table(df.filter("id <> 3"), *args).frame.collect()
    assert [r.id for r in sets.from_table(df, *args, on_bad_row="drop").frame.collect()] == [1]


def test_wide_set(spark):
    """Sixty-four features: sums stay per feature, scores go to Arrow batches."""
    ds = sets.embeddings(spark, SF_SMALL)
    result = bagging(ds, [NB] * 3)
    assert right(result)[1] == result.predictions.count() > 0
    assert right(stacking(ds, [NB, NB], NB))[1] == right(result)[1]


def test_wide_table_is_read_like_a_narrow_one(spark, monkeypatch):
    from quorum.sources import tables

    narrow = rows(sets.orders(spark, SF_SMALL).frame)
    monkeypatch.setattr(tables, "UNROLL_LIMIT", 1)
    assert rows(sets.orders(spark, SF_SMALL).frame) == narrow
    df = spark.createDataFrame([(1, 0.5, "u", "p"), (2, None, "v", "p")], "id int, x double, n string, y string")
    args = ((sets.real("x", 0, 1), sets.nominal("n", "uv")), "y", ("p", "q"), ["id"])
    with pytest.raises(Exception, match="NULL in a real input"):
        sets.from_table(df, *args).frame.collect()
    assert [r.id for r in sets.from_table(df, *args, on_bad_row="drop").frame.collect()] == [1]


def test_drop_leaves_out_what_is_no_number(spark):
    df = spark.createDataFrame([(1, "0.5", "p"), (2, "abc", "p"), (3, None, "p")], "id int, x string, y string")
    args = ((sets.real("x", 0, 1),), "y", ("p", "q"), ["id"])
    assert [r.id for r in sets.from_table(df, *args, on_bad_row="drop").frame.collect()] == [1]
    arrays = df.selectExpr("id", "array(x, '1') AS v", "y")
    ds = sets.from_array_table(arrays, "v", 2, 0, 1, "y", ("p", "q"), ["id"], on_bad_row="drop")
    assert [r.id for r in ds.frame.collect()] == [1]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sets.from_table(df.filter("id = 2"), *args).frame.collect()
