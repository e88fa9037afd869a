"""The three runs. Fits are eager; predictions and scores are lazy columns.

The driver holds fitted models and a few scalars. Nothing row-sized is collected, joined
or windowed: the only shuffles are grouped sums of a few rows per class and what
``pyspark.ml`` does inside a fit.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.functions.encode import mask_features
from quorum.functions.vote import plurality_vote
from quorum.operators import logistic, sampling, trees
from quorum.operators import naive_bayes as bayes
from quorum.operators.durable import checkpointed, kept
from quorum.operators.evaluate import accuracy
from quorum.operators.models import class_count, fit, run_parallel
from quorum.operators.pseudo import (
    explode_predictions,
    out_of_fold,
    transform_all,
    weighted_pseudo_labels,
)
from quorum.schema import Dataset, ModelSpec, require_specs

PARALLELISM = 4
LIBRARY_SMOOTHING = 1.0


@dataclass
class RunResult:
    """What a run leaves behind.

    ``predictions`` has one row per test row: key, ``label``, ``predictions`` (one slot
    per voting model, bagging only) and ``prediction``. ``details`` holds run-specific
    frames and models.
    """

    kind: str
    dataset: Dataset
    level0: tuple[ModelSpec, ...]
    level1: ModelSpec | None
    predictions: DataFrame
    fits: int
    num_partitions: int | None
    started: float
    prepared: float
    details: dict = field(default_factory=dict)
    smoothing: float | None = None
    """What every Bayes fit was smoothed by instead of its own argument, if anything."""

    def accuracy(self) -> DataFrame:
        """One row: right, total, accuracy, accuracy_rounded."""
        return accuracy(self.predictions)


def _method(ds: Dataset, method: str) -> str:
    """Rows without a key have no draws of their own but Spark's."""
    return method if ds.key else "random"


def _prepare(ds: Dataset, fraction, seed, method):
    frame = ds.frame
    if method == "random":
        # These draws are not tied to the row, so they are written down once.
        frame = checkpointed(
            sampling.with_part(frame.drop("inputs", "outputs"), ds.key, fraction, seed, method)
        )
        return tuple(frame.filter(F.col("part") == p).drop("part") for p in ("train", "test"))
    return sampling.train_test(frame, ds.key, fraction, seed, method)


def _spread(df: DataFrame, num_partitions: int | None) -> DataFrame:
    return df.repartition(num_partitions) if num_partitions else df


def _iterative(specs: Sequence[ModelSpec]) -> bool:
    return any(s.code != "NB" for s in specs)


def _joint(spec: ModelSpec, n_classes: int, n_input: int) -> bool:
    """Whether all models of the specification are fitted together, one scan a step or level."""
    told = class_count(spec, n_classes)
    if spec.code == "DT":
        return trees.suits(told, n_input, spec.max_depth, spec.max_bins)
    return spec.code == "LR" and logistic.suits(told, n_input)


def _kind(spec: ModelSpec):
    """What specifications fitted together have in common; the classes told change nothing."""
    return spec.code if spec.code == "LR" else (spec.code, spec.max_depth, spec.max_bins)


def _fit_joint(rows: DataFrame, spec: ModelSpec, members, n_classes: int, n_input: int, cache, masks=None) -> dict:
    if spec.code == "LR":
        return logistic.fit_members(rows, members, n_classes, n_input, masks, cache=cache)
    return trees.fit_members(rows, members, n_classes, n_input, spec.max_depth, spec.max_bins, masks, cache)


def _smoothing(spec: ModelSpec, fixed: float | None) -> float:
    return spec.smoothing if fixed is None else fixed


def _fixed(compat: bool, honour_smoothing: bool | None) -> float | None:
    honour = (not compat) if honour_smoothing is None else honour_smoothing
    return None if honour else LIBRARY_SMOOTHING


def single_model(
    ds: Dataset,
    spec: ModelSpec,
    *,
    train_fraction: float = sampling.TRAIN_FRACTION,
    seed=None,
    method: str = "md5",
    num_partitions: int | None = None,
    cache=None,
    compat: bool = False,
    honour_smoothing: bool | None = None,
    started: float | None = None,
) -> RunResult:
    """Split, fit one model on the training part, predict the test part."""
    started = time.perf_counter() if started is None else started
    method = _method(ds, method)
    train, test = _prepare(ds, train_fraction, seed, method)
    prepared = time.perf_counter()
    rows = _spread(train.select("features", "label"), num_partitions)
    with kept(rows, cache, passes=2 if _iterative([spec]) else 1) as training:
        model = fit(
            training, spec, ds.meta.n_output, fixed_smoothing=_fixed(compat, honour_smoothing)
        )
    predictions = transform_all(test.select(*ds.key, "features", "label"), [model])
    predictions = predictions.select(*ds.key, "label", F.col("p0").alias("prediction"))
    return RunResult(
        "single",
        ds,
        (spec,),
        None,
        predictions,
        1,
        num_partitions,
        started,
        prepared,
        {"model": model},
        _fixed(compat, honour_smoothing),
    )


def bagging(
    ds: Dataset,
    specs: Sequence[ModelSpec],
    *,
    train_fraction: float = sampling.TRAIN_FRACTION,
    rate: float = sampling.BAG_RATE,
    keep_probability: float = sampling.KEEP_PROBABILITY,
    seed=None,
    method: str = "md5",
    num_partitions: int | None = None,
    cache=None,
    parallelism: int = PARALLELISM,
    compat: bool = False,
    honour_smoothing: bool | None = None,
    started: float | None = None,
) -> RunResult:
    """Plurality vote over models that each saw a bootstrap sample with masked attributes.

    A sample is a weight column and a mask is a set of literals, so the samples of all
    Bayes members are summed in one pass, those of all logistic regressions in one pass per
    step and those of all trees of a kind in one per level. Test rows are predicted unmasked.
    """
    specs = tuple(specs)
    require_specs(specs)
    started = time.perf_counter() if started is None else started
    method = _method(ds, method)
    train, test = _prepare(ds, train_fraction, seed, method)
    prepared = time.perf_counter()
    n_classes, n_input = ds.meta.n_output, ds.meta.n_input
    fixed = _fixed(compat, honour_smoothing)
    masks = [
        sampling.attribute_mask(b, n_input, keep_probability, seed) for b in range(len(specs))
    ]
    weighted = sampling.with_bag_weights(train, ds.key, len(specs), rate, seed, method)
    if method == "random":
        weighted = checkpointed(weighted)
    bags = [sampling.bag_column(b) for b in range(len(specs))]
    rows = _spread(weighted.select("features", "label", *bags), num_partitions)
    bayes_bags = [b for b, s in enumerate(specs) if s.code == "NB"]
    joint_bags = [b for b, s in enumerate(specs) if _joint(s, n_classes, n_input)]
    other_bags = [b for b in range(len(specs)) if b not in (*bayes_bags, *joint_bags)]

    with kept(rows, cache, passes=2 * len(other_bags) + len({_kind(specs[b]) for b in joint_bags}) + bool(bayes_bags)) as training:

        def fit_bayes() -> dict:
            drawn = bayes.bag_sums(training, n_input, [bags[b] for b in bayes_bags])
            sums = bayes.collect_sums(drawn, "bag")
            return {
                b: bayes.model_from_sums(
                    bayes.mask_sums(sums.get(i, {}), masks[b]), _smoothing(specs[b], fixed)
                )
                for i, b in enumerate(bayes_bags)
            }

        def fit_joint(group: list[int]) -> dict:
            weights = F.array(*[F.col(bag).cast("double") for bag in bags])
            sample = training.select("features", "label", weights.alias("weights"))
            return _fit_joint(sample, specs[group[0]], group, n_classes, n_input, cache, masks)

        def fit_other(b: int) -> dict:
            sample = training.select(
                mask_features(F.col("features"), masks[b]).alias("features"),
                "label",
                F.col(bags[b]).alias("weight"),
            )
            return {b: fit(sample, specs[b], n_classes, weight="weight")}

        tasks = [fit_bayes] if bayes_bags else []
        kinds = dict.fromkeys(_kind(specs[b]) for b in joint_bags)
        groups = [[b for b in joint_bags if _kind(specs[b]) == kind] for kind in kinds]
        tasks += [lambda group=group: fit_joint(group) for group in groups]
        tasks += [lambda b=b: fit_other(b) for b in other_bags]
        fitted: dict = {}
        for part in run_parallel(ds.spark, tasks, parallelism):
            fitted.update(part)

    models = [fitted[b] for b in range(len(specs))]
    scored = transform_all(test.select(*ds.key, "features", "label"), models)
    votes = [F.col(f"p{b}") for b in range(len(specs))]
    predictions = scored.select(
        *ds.key,
        "label",
        F.array(*votes).alias("predictions"),
        plurality_vote(votes, n_classes).alias("prediction"),
    )
    return RunResult(
        "bagging",
        ds,
        specs,
        None,
        predictions,
        len(specs),
        num_partitions,
        started,
        prepared,
        {"models": models, "masks": masks},
        fixed,
    )


def stacking(
    ds: Dataset,
    specs: Sequence[ModelSpec],
    final_spec: ModelSpec,
    *,
    folds: int = sampling.FOLDS,
    train_fraction: float = sampling.TRAIN_FRACTION,
    seed=None,
    method: str = "md5",
    num_partitions: int | None = None,
    cache=None,
    parallelism: int = PARALLELISM,
    compat: bool = False,
    drop_last_fold: bool | None = None,
    honour_smoothing: bool | None = None,
    with_test_predictions: bool = False,
    started: float | None = None,
) -> RunResult:
    """A level-1 model trained on the out-of-fold pseudo-labels of the level-0 models.

    Features stay as they are; each level-0 model contributes one copy of the training
    rows labelled by its own out-of-fold predictions, and the level-1 model is scored on
    the test rows' true labels. ``drop_last_fold`` (``compat``) leaves the last fold's
    pseudo-labels out, and with them the fits that only they need. Level-0 models with the same
    specification are fitted once.
    """
    specs = tuple(specs)
    require_specs(specs, final_spec, stacking=True)
    if folds < 2:
        raise ValueError("stacking needs at least two folds")
    started = time.perf_counter() if started is None else started
    method = _method(ds, method)
    drop = compat if drop_last_fold is None else drop_last_fold
    fixed = _fixed(compat, honour_smoothing)
    train, test = _prepare(ds, train_fraction, seed, method)
    folded = train.withColumn("fold", sampling.fold_column(ds.key, folds, seed, method))
    if method == "random":
        folded = checkpointed(folded)
    prepared = time.perf_counter()
    n_classes, n_input = ds.meta.n_output, ds.meta.n_input
    label_classes = max(class_count(s, n_classes) for s in specs)
    used_folds = folds - 1 if drop else folds

    def same_fit(spec: ModelSpec):
        if _joint(spec, n_classes, n_input):
            return _kind(spec)
        return ("NB", _smoothing(spec, fixed)) if spec.code == "NB" else spec

    distinct = list(dict.fromkeys(same_fit(s) for s in specs))
    spec_of = {same_fit(s): s for s in specs}
    slot = [distinct.index(same_fit(s)) for s in specs]
    iterative = [s for s in (spec_of[d] for d in distinct) if s.code != "NB"]
    rows = _spread(folded.select("features", "label", "fold"), num_partitions)

    with kept(rows, cache, passes=2 * used_folds * len(iterative) + 1) as training:

        def fit_bayes() -> dict:
            sums = bayes.collect_sums(bayes.grouped_sums(training, n_input, ["fold"]), "fold")
            left_out = [bayes.complement_sums(sums, k) for k in range(used_folds)]
            return {
                (i, k): bayes.model_from_sums(left_out[k], _smoothing(spec_of[d], fixed))
                for i, d in enumerate(distinct)
                if spec_of[d].code == "NB"
                for k in range(used_folds)
            }

        def fit_joint(i: int) -> dict:
            weights = F.array(*[(F.col("fold") != k).cast("double") for k in range(used_folds)])
            sample = training.select("features", "label", weights.alias("weights"))
            models = _fit_joint(sample, spec_of[distinct[i]], range(used_folds), n_classes, n_input, cache)
            return {(i, k): model for k, model in models.items()}

        def fit_fold(i: int, k: int) -> dict:
            sample = training.filter(F.col("fold") != k)
            return {(i, k): fit(sample, spec_of[distinct[i]], n_classes)}

        tasks = [fit_bayes] if any(s.code == "NB" for s in specs) else []
        for i, d in enumerate(distinct):
            if _joint(spec_of[d], n_classes, n_input):
                tasks.append(lambda i=i: fit_joint(i))
            elif spec_of[d].code != "NB":
                tasks += [lambda i=i, k=k: fit_fold(i, k) for k in range(used_folds)]
        fitted: dict = {}
        for part in run_parallel(ds.spark, tasks, parallelism):
            fitted.update(part)
        by_fold = [[fitted[(i, k)] for k in range(used_folds)] for i in range(len(distinct))]

        def votes():
            return [F.col(f"p{i}") for i in slot]

        def fit_level1(guessed: DataFrame):
            copies = weighted_pseudo_labels(guessed, votes(), label_classes)
            if final_spec.code == "NB":
                sums = bayes.collect_sums(bayes.grouped_sums(copies, n_input, weight="weight"))
                return bayes.model_from_sums(sums[None], _smoothing(final_spec, fixed))
            with kept(copies, cache, passes=2) as level1_rows:
                return fit(level1_rows, final_spec, label_classes, weight="weight")

        def refit(guessed: DataFrame, i: int):
            own = guessed.select("features", F.col(f"p{i}").alias("label"))
            own = own.filter(F.col("label").isNotNull())
            spec = spec_of[distinct[i]]
            if spec.code == "NB":
                sums = bayes.collect_sums(bayes.grouped_sums(own, n_input))
                return bayes.model_from_sums(sums[None], _smoothing(spec, fixed))
            return fit(own, spec, label_classes)

        again = range(len(distinct)) if with_test_predictions else ()
        passes = 1 + sum(2 if spec_of[distinct[i]].code != "NB" else 1 for i in again)
        with kept(out_of_fold(training, by_fold), cache if passes > 1 else False, passes) as guessed:
            tasks = [lambda: fit_level1(guessed)] + [lambda i=i: refit(guessed, i) for i in again]
            final, *refits = run_parallel(ds.spark, tasks, parallelism)

    # The same pseudo-labels with their row keys, for whoever wants to see them.
    keyed = folded.select(*ds.key, "features", "label", "fold").filter(F.col("fold") < used_folds)
    labelled = out_of_fold(keyed, by_fold).select(
        *ds.key, "features", "label", "fold", *[p.alias(f"pseudo{m}") for m, p in enumerate(votes())]
    )
    names = [f"pseudo{m}" for m in range(len(specs))]
    details = {
        "level0": by_fold,
        "slots": slot,
        "level1": final,
        "pseudo_labels": labelled,
        "level1_training": explode_predictions(labelled, names),
    }
    test = test.select(*ds.key, "features", "label")
    if with_test_predictions:
        refitted = transform_all(test, [refits[i] for i in slot], "pseudo")
        details["level1_test"] = explode_predictions(refitted, names)
    predictions = transform_all(test, [final]).select(
        *ds.key, "label", F.col("p0").alias("prediction")
    )
    fits = len(distinct) * (used_folds + bool(with_test_predictions)) + 1
    return RunResult(
        "stacking",
        ds,
        specs,
        final_spec,
        predictions,
        fits,
        num_partitions,
        started,
        prepared,
        details,
        fixed,
    )
