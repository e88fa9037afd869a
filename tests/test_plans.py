"""What the plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF, SF_SMALL
from quorum import ModelSpec, bagging, stacking
from quorum.checks import datasets as sets
from quorum.checks.queries import QUERIES
from quorum.operators import naive_bayes as bayes
from quorum.operators import sampling
from quorum.operators.pseudo import out_of_fold, weighted_pseudo_labels

NB = ModelSpec.of("NB", 1.0)
FORBIDDEN = ("Join", "CartesianProduct", "Window", "SinglePartition, REPARTITION", "BatchEvalPython")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(text: str, name: str) -> int:
    return len(re.findall(rf"[-+:\s*()\d]{name}\b", text))


def digests(text: str) -> int:
    """Row digests computed; the scan line only repeats the filter's."""
    return sum(line.count("md5(") for line in text.split("\n") if "FileScan" not in line)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"bagging_trio", "stacking_trio", "keel_attributes"}))
def test_no_joins_windows_or_row_udfs(spark, name):
    text = plan(QUERIES[name](spark, SF_SMALL))
    for word in FORBIDDEN:
        assert word not in text, word


def test_bags_of_bayes_are_one_scan_and_one_small_shuffle(spark):
    ds = sets.lineitem_dominant(spark, SF)
    train, _ = sampling.train_test(ds.frame, ds.key)
    weighted = sampling.with_bag_weights(train, ds.key, 5)
    text = plan(bayes.bag_sums(weighted, 4, [sampling.bag_column(b) for b in range(5)]))
    assert nodes(text, "FileScan") == 1 and nodes(text, "Exchange") == 1
    assert digests(text) == 1 + 2  # the split, and four bags each
    assert "partial_sum" in text and "l_returnflag" not in text and "l_shipdate" not in text


def test_out_of_fold_is_one_scan(spark):
    ds = sets.lineitem_dominant(spark, SF_SMALL)
    result = stacking(ds, [NB, NB], NB)
    train, _ = sampling.train_test(ds.frame, ds.key)
    folded = train.withColumn("fold", sampling.fold_column(ds.key)).select("features", "label", "fold")
    guessed = out_of_fold(folded, result.details["level0"])
    copies = weighted_pseudo_labels(guessed, [F.col("p0"), F.col("p0")], 3)
    text = plan(bayes.grouped_sums(copies, 4, weight="weight"))
    assert nodes(text, "FileScan") == 1 and nodes(text, "Exchange") == 1
    assert digests(text) == 2


@pytest.mark.parametrize("model", ["DT 3 3 64", "NB 1.0"])
def test_pseudo_labels_are_one_scan(spark, model):
    ds = sets.lineitem_discrete(spark, SF_SMALL)
    details = stacking(ds, [NB, ModelSpec.of(*model.split())], NB).details
    assert nodes(plan(details["pseudo_labels"]), "FileScan") == 1
    assert nodes(plan(details["level1_training"]), "FileScan") == 1
    for name in ("pseudo_labels", "level1_training"):
        assert "Exchange" not in plan(details[name])


def test_documents_are_counted_in_the_scan_stage(spark):
    scored = bagging(sets.documents_lang(spark, SF_SMALL), [NB] * 3).predictions
    assert "Exchange" not in plan(scored)


def test_predictions_stay_narrow(spark):
    scored = bagging(sets.lineitem_dominant(spark, SF_SMALL), [NB] * 3).predictions
    text = plan(scored)
    assert "Exchange" not in text and "Python" not in text and nodes(text, "FileScan") == 1


def test_filters_on_the_input_reach_the_file(spark):
    frame = sets.orders(spark, SF_SMALL).frame.filter(F.col("o_orderkey") > 100).select("label")
    text = plan(frame)
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,100)]" in text
    assert "o_custkey" not in text and "o_totalprice" not in text
