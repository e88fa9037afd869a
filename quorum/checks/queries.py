"""One query per operator. Each reads the given tables whole and returns flat columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quorum.checks import datasets as sets
from quorum.functions.encode import (
    class_onehot,
    label_from_onehot,
    mask_features,
    nominal_code,
    round_half_even,
)
from quorum.functions.vote import plurality_vote, vote_counts
from quorum.operators import prepare, sampling
from quorum.operators.blocks import pack
from quorum.operators.durable import shared_folder
from quorum.operators.evaluate import observe_accuracy, observed_accuracy
from quorum.operators.logistic import member_sums
from quorum.operators.models import TreeModel
from quorum.operators.naive_bayes import grouped_sums
from quorum.plans.report import run_report
from quorum.plans.runs import RunResult, bagging, single_model, stacking
from quorum.schema import Dataset, DatasetMeta, ModelSpec, nominal
from quorum.sources.keel import (
    data_lines,
    declarations,
    file_headers,
    header_lines,
    load_keel,
    load_report,
    parse_header,
    parse_keel,
)

NB = ModelSpec.of("NB", 1.0)
LR = ModelSpec.of("LR", 3)
LR2 = ModelSpec.of("LR", 2)
DT = ModelSpec.of("DT", 3, 5, 32)
#: More bins than any input of the set has values.
TREE = ModelSpec.of("DT", 3, 3, 64)
STUMP = ModelSpec.of("DT", 3, 1, 64)
BAGS = 3
FIT_PARALLELISM = 4
REPORT = ("rows", "wrong_field_count", "bad_number", "unknown_nominal", "unknown_class", "example")
KEEL_REPORT = ", ".join(f"{c} {'string' if c == 'example' else 'long'}" for c in REPORT)


def _slots(array: str, n: int, prefix: str) -> list:
    return [F.col(array)[i].alias(f"{prefix}{i}") for i in range(n)]


# Text sets ---------------------------------------------------------------------------


def _keel_meta(lines: DataFrame) -> DatasetMeta:
    return parse_header(r.value for r in header_lines(lines, "position").collect())


def _keel(spark: SparkSession, sf_dir: str) -> Dataset:
    lines = sets.orders_lines(spark, sf_dir)
    return parse_keel(lines, _keel_meta(lines), key=["row_id"], name="orders_lines")


def keel_header(spark, sf_dir):
    return header_lines(sets.orders_lines(spark, sf_dir), "position").select("position", "value")


def keel_attributes(spark, sf_dir):
    table = _keel_meta(sets.orders_lines(spark, sf_dir)).attribute_table(spark)
    return table.withColumn("values", F.array_join("values", "|"))


def keel_load(spark, sf_dir):
    return _keel(spark, sf_dir).frame.select(
        "row_id", *_slots("inputs", 2, "x"), *_slots("features", 2, "f"), *_slots("outputs", 3, "c"), "label"
    )


def keel_text_load(spark, sf_dir):
    """Several headed text files, loaded from their folder."""
    ds = load_keel(spark, sets.orders_files(spark, sf_dir), headers="same", name="orders_files")
    return ds.frame.select(*_slots("inputs", 2, "x"), *_slots("features", 2, "f"), "label")


def keel_file_headers(spark, sf_dir):
    headers = file_headers(spark, sets.orders_files(spark, sf_dir))
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("int")
    return headers.select(part.alias("part"), "position", "value")


def keel_declarations(spark, sf_dir):
    found = declarations(spark, sets.orders_files(spark, sf_dir))
    return found.select("files", F.array_join("declaration", "; ").alias("declaration"))


def keel_count(spark, sf_dir):
    lines = sets.orders_lines(spark, sf_dir)
    return data_lines(lines).agg(F.count("*").alias("n"))


def _narrower(meta: DatasetMeta) -> DatasetMeta:
    """Without the last value and the last class, so that rows are undeclared."""
    price, priority = meta.inputs
    return DatasetMeta((price, nominal(priority.name, priority.values[:-1])), meta.classes[:-1])


def keel_load_report(spark, sf_dir):
    lines = sets.orders_lines(spark, sf_dir)
    return load_report(lines, _narrower(_keel_meta(lines)))


def keel_load_observed(spark, sf_dir):
    """The same counts, taken while the rows that parse are written."""
    lines = sets.orders_lines(spark, sf_dir)
    report = Observation("load")
    ds = parse_keel(lines, _narrower(_keel_meta(lines)), key=["row_id"], on_bad_row="drop", report=report)
    path = shared_folder(spark, "loaded")
    ds.frame.write.parquet(path)
    counted = spark.createDataFrame([tuple(report.get[c] for c in REPORT)], KEEL_REPORT)
    return counted.withColumn("kept", F.lit(spark.read.parquet(path).count()).cast("long"))


def dataset_summary(spark, sf_dir):
    summary = prepare.dataset_summary(_keel(spark, sf_dir))
    return summary.withColumn("classes", F.array_join("classes", "|"))


# Preparation -------------------------------------------------------------------------


def nominal_encode(spark, sf_dir):
    orders = sets.table(spark, sf_dir, "orders")
    value = F.translate("o_orderpriority", " ", "_")
    return orders.select("o_orderkey", nominal_code(value, sets.PRIORITIES[:4]).alias("code"))


def nominal_encode_wide(spark, sf_dir):
    """A nominal attribute of 1,826 declared values: the days of five years."""
    df = sets.table(spark, sf_dir, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return df.select(*sets.LINEITEM_KEY, nominal_code(day, sets.SHIP_DAYS).alias("code"))


def class_one_hot(spark, sf_dir):
    orders = sets.table(spark, sf_dir, "orders")
    code = nominal_code(F.col("o_orderstatus"), sets.ORDER_STATUS)
    onehot = orders.select("o_orderkey", class_onehot(code, 3).alias("outputs"))
    return onehot.select("o_orderkey", *_slots("outputs", 3, "c"))


def label_from_one_hot(spark, sf_dir):
    """Arrays with several ones and with none, built from three independent flags."""
    orders = sets.table(spark, sf_dir, "orders")
    flags = [F.col("o_orderstatus") == "F", F.col("o_totalprice") > 250000, F.col("o_custkey") % 2 == 0]
    outputs = F.array(*[f.cast("double") for f in flags])
    return orders.select("o_orderkey", label_from_onehot(outputs).alias("label"))


def declared_range_rescale(spark, sf_dir):
    return sets.lineitem(spark, sf_dir).frame.select(*sets.LINEITEM_KEY, *_slots("features", 4, "f"))


def labelled_points(spark, sf_dir):
    points = prepare.labelled_points(sets.lineitem(spark, sf_dir))
    points = points.withColumn("features", vector_to_array("features"))
    return points.select(*sets.LINEITEM_KEY, "label", *_slots("features", 4, "f"))


def events_points(spark, sf_dir):
    frame = sets.events(spark, sf_dir).frame
    return frame.select("event_id", *_slots("features", 2, "f"), "label")


def embeddings_points(spark, sf_dir):
    frame = sets.embeddings(spark, sf_dir).frame
    return frame.select("vec_id", "label", F.posexplode("features").alias("position", "value"))


def nominal_value_counts(spark, sf_dir):
    return prepare.nominal_value_counts(sets.orders(spark, sf_dir))


def nominal_value_class_counts(spark, sf_dir):
    return prepare.nominal_value_class_counts(sets.lineitem_flags(spark, sf_dir))


# Sampling ----------------------------------------------------------------------------


def _lineitem_train(spark, sf_dir) -> DataFrame:
    ds = sets.lineitem(spark, sf_dir)
    train, _ = sampling.train_test(ds.frame, ds.key)
    return train


def train_test_split(spark, sf_dir):
    ds = sets.lineitem(spark, sf_dir)
    return sampling.with_part(ds.frame, ds.key).select(*ds.key, "part")


def fold_assign(spark, sf_dir):
    train = _lineitem_train(spark, sf_dir)
    return train.select(*sets.LINEITEM_KEY, sampling.fold_column(sets.LINEITEM_KEY).alias("fold"))


def keyless_draws(spark, sf_dir):
    """Equal lines without a key: each draws its own part, fold and weights."""
    ds = parse_keel(sets.lineitem_lines(spark, sf_dir), sets.LINE_META, key="copy", name="lineitem_lines")
    drawn = sampling.with_part(ds.frame, ds.key).withColumn("fold", sampling.fold_column(ds.key))
    drawn = sampling.with_bag_weights(drawn, ds.key, 2)
    return drawn.select("row_id", *_slots("inputs", 2, "x"), "label", "part", "fold", "bag0", "bag1")


def fold_complement_counts(spark, sf_dir):
    return sampling.fold_complement_counts(fold_assign(spark, sf_dir))


def bootstrap_weights(spark, sf_dir):
    train = _lineitem_train(spark, sf_dir)
    bags = [sampling.bag_column(b) for b in range(BAGS)]
    return sampling.with_bag_weights(train, sets.LINEITEM_KEY, BAGS).select(*sets.LINEITEM_KEY, *bags)


def attribute_mask(spark, sf_dir):
    train = _lineitem_train(spark, sf_dir)
    masked = [
        mask_features(F.col("features"), sampling.attribute_mask(b, 4))[j].alias(f"bag{b}_f{j}")
        for b in range(2)
        for j in range(4)
    ]
    return train.select(*sets.LINEITEM_KEY, *masked)


# Single models -----------------------------------------------------------------------


def nb_model(spark, sf_dir):
    model = single_model(sets.lineitem(spark, sf_dir), NB).details["model"]
    rows = [
        (float(c), float(b), *[float(v) for v in w])
        for c, b, w in zip(model.classes, model.intercepts, model.weights)
    ]
    names = ["label", "pi", *[f"theta{j}" for j in range(4)]]
    table = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    return table.select("label", *[F.round(n, 6).alias(n) for n in names[1:]])


def wide_nb_predict(spark, sf_dir):
    """More inputs than are summed one by one: the sums are vector summaries."""
    return single_model(sets.embeddings_wide(spark, sf_dir), NB).predictions


def wide_nb_sums(spark, sf_dir):
    ds = sets.embeddings_wide(spark, sf_dir)
    train, _ = sampling.train_test(ds.frame, ds.key)
    sums = grouped_sums(train, ds.meta.n_input)
    return sums.select("label", "n", *[F.round(F.col("sums")[j], 6).alias(f"s{j}") for j in (0, 63, 64, 127)])


def _single_nb(spark, sf_dir) -> RunResult:
    return single_model(sets.documents_lang(spark, sf_dir), NB)


def nb_predict(spark, sf_dir):
    return _single_nb(spark, sf_dir).predictions


def single_nb_accuracy(spark, sf_dir):
    return _single_nb(spark, sf_dir).accuracy().select("right", "total", "accuracy")


def accuracy_observed(spark, sf_dir):
    """The score from the pass that writes the predictions."""
    seen = Observation("score")
    scored = observe_accuracy(_single_nb(spark, sf_dir).predictions, seen)
    scored.write.parquet(shared_folder(spark, "predictions"))
    return observed_accuracy(spark, seen).select("right", "total", "accuracy")


def single_nb_lineitem(spark, sf_dir):
    result = single_model(sets.lineitem_dominant(spark, sf_dir), NB)
    return result.accuracy().select("right", "total", "accuracy")


def accuracy_rounded(spark, sf_dir):
    """The score of every language apart, so that the rounding meets several ratios."""
    scored = _single_nb(spark, sf_dir).predictions
    per_label = scored.groupBy("label").agg(
        F.count_if(F.col("prediction") == F.col("label")).alias("right"), F.count("*").alias("total")
    )
    ratio = F.col("right").cast("double") / F.col("total")
    return per_label.select("label", round_half_even(ratio).alias("accuracy_rounded"))


def lr_predict(spark, sf_dir):
    return single_model(sets.lineitem_overlap(spark, sf_dir), LR2).predictions


def single_lr(spark, sf_dir):
    return single_model(sets.lineitem_overlap(spark, sf_dir), LR2).accuracy().select("right", "total", "accuracy")


def _weights_table(spark, member: str, models) -> DataFrame:
    """The weights of class 1 of models with two inputs, one row per model."""
    rows = [(i, *[float(w) for w in m.weights[1]]) for i, m in enumerate(models)]
    table = spark.createDataFrame(rows, f"{member} int, w0 double, w1 double")
    return table.select(member, F.round("w0", 6).alias("w0"), F.round("w1", 6).alias("w1"))


def lr_bag_weights(spark, sf_dir):
    result = bagging(sets.lineitem_overlap(spark, sf_dir), [LR2] * BAGS)
    return _weights_table(spark, "bag", result.details["models"])


def lr_fold_weights(spark, sf_dir):
    result = stacking(sets.lineitem_overlap(spark, sf_dir), [LR2] * 2, NB)
    return _weights_table(spark, "fold", result.details["level0"][0])


def lr_gradients(spark, sf_dir):
    """Loss and gradient of all bags and all folds at given weights, from one scan."""
    ds = sets.lineitem_overlap(spark, sf_dir)
    train, _ = sampling.train_test(ds.frame, ds.key)
    train = sampling.with_bag_weights(train, ds.key, BAGS)
    fold = sampling.fold_column(ds.key)
    weights = [F.col(sampling.bag_column(b)).cast("double") for b in range(BAGS)]
    weights += [(fold != k).cast("double") for k in range(sampling.FOLDS)]
    rows = train.select("features", "label", F.array(*weights).alias("weights"))
    at = {m: np.array([[0.0, 0.0], [0.5 * (1 + m), -0.25 * m]]) for m in range(len(weights))}
    sums = member_sums(pack(rows, 2, 2), at).filter("position < 8").groupBy("member").pivot("position", list(range(8))).sum("value")
    return sums.select(
        "member",
        F.round("0", 6).alias("weight"),
        F.round(F.col("6") / F.col("0"), 9).alias("g0"),
        F.round(F.col("7") / F.col("0"), 9).alias("g1"),
        F.round(F.col("1") / F.col("0"), 9).alias("loss"),
    )


def lr_moments(spark, sf_dir):
    """Mean of probability times input, per class and input, under the fitted model. Without a
    penalty these equal the means of the inputs within the classes at the optimum; the classes
    of ``orders`` overlap, so there is one."""
    ds = sets.orders(spark, sf_dir)
    weights = single_model(ds, LR).details["model"].weights
    train, _ = sampling.train_test(ds.frame, ds.key)
    n_classes, n_input = weights.shape
    x = [F.col("features")[j] for j in range(n_input)]
    scores = [sum((float(weights[c, j]) * x[j] for j in range(n_input)), F.lit(0.0)) for c in range(n_classes)]
    top = F.greatest(*scores)
    raised = [F.exp(s - top) for s in scores]
    total = sum(raised, F.lit(0.0))
    means = train.agg(
        *[F.avg(raised[c] / total * x[j]).alias(f"m{c}_{j}") for c in range(n_classes) for j in range(n_input)]
    )
    stacked = ", ".join(f"{float(c)}D, {j}, m{c}_{j}" for c in range(n_classes) for j in range(n_input))
    rows = means.selectExpr(f"stack({n_classes * n_input}, {stacked}) AS (label, feature, moment)")
    return rows.select("label", "feature", F.round("moment", 2).alias("moment"))


def dt_predict(spark, sf_dir):
    return single_model(sets.lineitem_discrete(spark, sf_dir), TREE).predictions


def single_dt(spark, sf_dir):
    result = single_model(sets.lineitem_discrete(spark, sf_dir), TREE)
    return result.accuracy().select("right", "total", "accuracy")


def dt_stump(spark, sf_dir):
    """A tree of depth one, read off its leaves: which input it splits, where, and what it
    predicts on either side."""
    ds = sets.lineitem_dominant(spark, sf_dir)
    result = single_model(ds, STUMP)
    tree: TreeModel = result.details["model"]
    split_on = int(tree.model.featureImportances.toArray().argmax())
    train, _ = sampling.train_test(ds.frame, ds.key)
    sides = (
        tree.transform(train.select("features"))
        .groupBy("prediction")
        .agg(F.min(F.col("features")[split_on]).alias("low"), F.max(F.col("features")[split_on]).alias("high"))
        .agg(
            F.max(F.struct("low", "high", "prediction")).alias("above"),
            F.min(F.struct("low", "high", "prediction")).alias("below"),
        )
    )
    return sides.select(
        F.lit(split_on).alias("feature"),
        F.round((F.col("below.high") + F.col("above.low")) / 2, 6).alias("threshold"),
        F.col("below.prediction").alias("prediction_below"),
        F.col("above.prediction").alias("prediction_above"),
    )


# Ensembles ---------------------------------------------------------------------------


def _bagging_nb(spark, sf_dir) -> RunResult:
    return bagging(sets.lineitem_dominant(spark, sf_dir), [NB] * BAGS)


def bagging_nb_predictions(spark, sf_dir):
    scored = _bagging_nb(spark, sf_dir).predictions
    return scored.select(*sets.LINEITEM_KEY, "label", *_slots("predictions", BAGS, "p"), "prediction")


def bagging_nb_accuracy(spark, sf_dir):
    return _bagging_nb(spark, sf_dir).accuracy()


def bagging_nb_documents(spark, sf_dir):
    return bagging(sets.documents_lang(spark, sf_dir), [NB] * BAGS).accuracy()


def vote_count_query(spark, sf_dir):
    scored = _bagging_nb(spark, sf_dir).predictions
    votes = [F.col("predictions")[b] for b in range(BAGS)]
    counted = scored.select(*sets.LINEITEM_KEY, vote_counts(votes, 3).alias("votes"))
    return counted.select(*sets.LINEITEM_KEY, *_slots("votes", 3, "v"))


def plurality_vote_query(spark, sf_dir):
    """The vote over an array column, with votes that are no class."""
    scored = _bagging_nb(spark, sf_dir).predictions
    votes = F.transform("predictions", lambda p: F.when(p == 2.0, -1.0).otherwise(p))
    return scored.select(*sets.LINEITEM_KEY, plurality_vote(votes, 3).alias("prediction"))


def _stacking_nb(spark, sf_dir, **options) -> RunResult:
    return stacking(sets.lineitem_dominant(spark, sf_dir), [NB] * 2, NB, **options)


def pseudo_labels_nb(spark, sf_dir):
    labelled = _stacking_nb(spark, sf_dir).details["pseudo_labels"]
    return labelled.select(*sets.LINEITEM_KEY, "fold", "pseudo0", "pseudo1")


def level1_training_nb(spark, sf_dir):
    rows = _stacking_nb(spark, sf_dir).details["level1_training"]
    return rows.select(*sets.LINEITEM_KEY, "model", "label", *_slots("features", 4, "f"))


def level1_test_nb(spark, sf_dir):
    rows = _stacking_nb(spark, sf_dir, with_test_predictions=True).details["level1_test"]
    return rows.select(*sets.LINEITEM_KEY, "model", "label")


def stacking_nb_accuracy(spark, sf_dir):
    return _stacking_nb(spark, sf_dir).accuracy()


def stacking_nb_historic(spark, sf_dir):
    """Without the pseudo-labels of the last fold, and with the smoothing fixed."""
    return _stacking_nb(spark, sf_dir, compat=True).accuracy()


def stacking_nb_all_folds(spark, sf_dir):
    return _stacking_nb(spark, sf_dir, drop_last_fold=False).accuracy()


def stacking_nb_documents(spark, sf_dir):
    return stacking(sets.documents_lang(spark, sf_dir), [NB] * 2, NB).accuracy()


def bagging_mixed(spark, sf_dir):
    ds = sets.lineitem_discrete(spark, sf_dir)
    scored = bagging(ds, [NB, TREE], parallelism=FIT_PARALLELISM).predictions
    return scored.select(*ds.key, "label", *_slots("predictions", 2, "p"), "prediction")


def stacking_mixed(spark, sf_dir):
    ds = sets.lineitem_discrete(spark, sf_dir)
    return stacking(ds, [NB, TREE], NB, parallelism=FIT_PARALLELISM).predictions


def bagging_trio(spark, sf_dir):
    """All three kinds of model."""
    ds = sets.lineitem_overlap(spark, sf_dir)
    scored = bagging(ds, [NB, LR2, TREE], parallelism=FIT_PARALLELISM).predictions
    return scored.select(*ds.key, "label", *_slots("predictions", 3, "p"), "prediction")


def stacking_trio(spark, sf_dir):
    ds = sets.lineitem_overlap(spark, sf_dir)
    return stacking(ds, [NB, LR2, TREE], LR2, parallelism=FIT_PARALLELISM).predictions


def run_report_query(spark, sf_dir):
    report = run_report(_single_nb(spark, sf_dir), with_times=False)
    return report.withColumn("level0_models", F.array_join("level0_models", "|"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "keel_header": keel_header,
    "keel_attributes": keel_attributes,
    "dataset_summary": dataset_summary,
    "keel_load": keel_load,
    "keel_text_load": keel_text_load,
    "keel_file_headers": keel_file_headers,
    "keel_declarations": keel_declarations,
    "keel_count": keel_count,
    "keel_load_report": keel_load_report,
    "keel_load_observed": keel_load_observed,
    "nominal_encode": nominal_encode,
    "nominal_encode_wide": nominal_encode_wide,
    "class_onehot": class_one_hot,
    "label_from_onehot": label_from_one_hot,
    "declared_range_rescale": declared_range_rescale,
    "labelled_points": labelled_points,
    "events_points": events_points,
    "embeddings_points": embeddings_points,
    "nominal_value_counts": nominal_value_counts,
    "nominal_value_class_counts": nominal_value_class_counts,
    "train_test_split": train_test_split,
    "fold_assign": fold_assign,
    "keyless_draws": keyless_draws,
    "fold_complement_counts": fold_complement_counts,
    "bootstrap_weights": bootstrap_weights,
    "attribute_mask": attribute_mask,
    "nb_model": nb_model,
    "nb_predict": nb_predict,
    "wide_nb_predict": wide_nb_predict,
    "wide_nb_sums": wide_nb_sums,
    "single_nb_accuracy": single_nb_accuracy,
    "accuracy_observed": accuracy_observed,
    "single_nb_lineitem": single_nb_lineitem,
    "accuracy_rounded": accuracy_rounded,
    "lr_predict": lr_predict,
    "single_lr": single_lr,
    "lr_bag_weights": lr_bag_weights,
    "lr_fold_weights": lr_fold_weights,
    "lr_gradients": lr_gradients,
    "lr_moments": lr_moments,
    "dt_predict": dt_predict,
    "single_dt": single_dt,
    "dt_stump": dt_stump,
    "vote_counts": vote_count_query,
    "plurality_vote": plurality_vote_query,
    "bagging_nb_predictions": bagging_nb_predictions,
    "bagging_nb_accuracy": bagging_nb_accuracy,
    "bagging_nb_documents": bagging_nb_documents,
    "pseudo_labels_nb": pseudo_labels_nb,
    "level1_training_nb": level1_training_nb,
    "level1_test_nb": level1_test_nb,
    "stacking_nb_accuracy": stacking_nb_accuracy,
    "stacking_nb_historic": stacking_nb_historic,
    "stacking_nb_all_folds": stacking_nb_all_folds,
    "stacking_nb_documents": stacking_nb_documents,
    "bagging_mixed": bagging_mixed,
    "stacking_mixed": stacking_mixed,
    "bagging_trio": bagging_trio,
    "stacking_trio": stacking_trio,
    "run_report": run_report_query,
}
