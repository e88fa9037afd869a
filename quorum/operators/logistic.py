"""Logistic regression of many samples at once.

The members of an ensemble (bags, folds) differ in which rows count how much. One scan sums
loss, gradient and curvature of all of them; the sums of a task are added up where they arise
and meet in a grouped sum, so that what is shuffled and collected has the size of the models.
The driver takes a Newton step for every member that has not converged, and scans again.

The optimum is that of ``pyspark.ml`` without penalty and intercept. Where the classes are
separable there is none; steps then end when next to no loss is left.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.operators.blocks import pack, unpack
from quorum.operators.durable import kept
from quorum.operators.linear import LinearModel

#: Up to this many weights per member the curvature is summed; larger models are left to
#: ``pyspark.ml``, which needs gradients only.
WEIGHT_LIMIT = 64
#: Largest mean gradient that counts as converged.
TOLERANCE = 1e-9
#: Mean loss under which the classes count as separated.
SEPARATED = 1e-5
MAX_STEPS = 100
#: Scores further below the best count as this; e to it is nothing beside 1.
LEAST_SCORE = -200.0


def _layout(k: int, d: int) -> dict[str, slice]:
    """Where a member's sums stand in one array."""
    sizes = {"weight": 1, "loss": 1, "classes": k, "gradient": k * d, "curvature": (k * d) ** 2}
    ends = np.cumsum([0, *sizes.values()])
    return {name: slice(int(a), int(b)) for name, a, b in zip(sizes, ends[:-1], ends[1:])}


def _sums(x, is_class, w, coefficients, allowed) -> np.ndarray:
    """Sums of one member. Rows lie along the last axis of ``x`` (features) and ``is_class``,
    which numpy reduces several times faster than short rows."""
    k, d = coefficients.shape
    at = _layout(k, d)
    out = np.zeros(at["curvature"].stop)
    gradient = out[at["gradient"]].reshape(k, d)
    curvature = out[at["curvature"]].reshape(k, d, k, d)
    some = np.flatnonzero(allowed)
    scores = coefficients[some] @ x
    scores -= scores.max(axis=0)
    own = (scores * is_class[some]).sum(axis=0)
    # Lower ones would give numbers that the processor handles many times slower.
    p = np.exp(np.maximum(scores, LEAST_SCORE, out=scores), out=scores)
    total = p.sum(axis=0)
    p /= total
    out[at["weight"]] = w.sum()
    out[at["loss"]] = w @ (np.log(total) - own)
    out[at["classes"]] = is_class @ w
    wp = p * w
    gradient[some] = (wp - is_class[some] * w) @ x.T
    for i, c in enumerate(some):
        for j in range(i, len(some)):
            spread = (x * (wp[i] * ((i == j) - p[j]))) @ x.T
            curvature[c, :, some[j]] = spread
            curvature[some[j], :, c] = spread
    return out


def member_sums(
    blocks: DataFrame, coefficients: dict[int, np.ndarray], allowed: dict[int, np.ndarray] | None = None
) -> DataFrame:
    """``member``, ``position``, ``value``: the sums of every member over packed rows. Members
    without coefficients take no part; ``allowed`` names the classes of a member, all by default."""
    k, d = next(iter(coefficients.values())).shape
    size = _layout(k, d)["curvature"].stop

    def run(batches):
        held = {m: np.zeros(size) for m in coefficients}
        for x, y, w in unpack(batches):
            is_class = (y == np.arange(k)[:, None]).astype(float)
            for m, c in coefficients.items():
                may = np.ones(k, bool) if allowed is None else allowed[m]
                if w[m].any():
                    held[m] += _sums(x, is_class, w[m], c, may)
        members = [m for m in held if held[m][0] > 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(members, pa.int32()), pa.array([held[m] for m in members], pa.list_(pa.float64()))],
            ["member", "sums"],
        )

    parts = blocks.mapInArrow(run, "member int, sums array<double>")
    values = parts.select("member", F.posexplode("sums").alias("position", "value"))
    return values.groupBy("member", "position").agg(F.sum("value").alias("value"))


def _collected(sums: DataFrame, k: int, d: int) -> dict[int, dict[str, np.ndarray]]:
    at = _layout(k, d)
    flat: dict[int, np.ndarray] = {}
    got = sums.toPandas()
    for member, part in got.groupby("member"):
        values = np.zeros(at["curvature"].stop)
        values[part["position"].to_numpy()] = part["value"].to_numpy()
        flat[int(member)] = values
    return {m: {name: v[s] for name, s in at.items()} for m, v in flat.items()}


def _step(gradient: np.ndarray, curvature: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The Newton step over the free weights; least squares, for a shift common to all classes
    changes nothing."""
    out = np.zeros(len(gradient))
    inside = curvature[np.ix_(free, free)]
    scale = np.sqrt(np.where(np.diag(inside) > 0, np.diag(inside), 1.0))
    solved = np.linalg.lstsq(inside / np.outer(scale, scale), gradient[free] / scale, rcond=1e-13)[0]
    out[free] = solved / scale
    return out


def suits(n_classes: int, n_input: int) -> bool:
    return n_classes * n_input <= WEIGHT_LIMIT


def _descended(blocks, members, k, d, masks, tolerance, max_steps) -> tuple[dict, dict]:
    """Newton steps of all members: their weights and the classes they have rows of."""
    now = {m: np.zeros((k, d)) for m in members}
    all_classes = {m: np.ones(k, bool) for m in members}

    def sums_of(points, allowed):
        return _collected(member_sums(blocks, points, allowed), k, d)

    state = sums_of(now, all_classes)
    empty = [m for m in members if m not in state]
    if empty:
        raise ValueError(f"logistic regression was given no rows for members {empty}")
    allowed = {m: state[m]["classes"] > 0 for m in members}
    fewer = {m: now[m] for m in members if not allowed[m].all()}
    if fewer:
        state |= sums_of(fewer, allowed)
    free = {}
    for m in members:
        use = np.repeat(allowed[m][:, None], d, axis=1)
        if k == 2:
            use[0] = False
        if masks is not None:
            # A weight that stays 0 is as good as a feature that is 0.
            use &= np.array(masks[m], dtype=bool)
        free[m] = np.flatnonzero(use.ravel())

    def converged(m: int) -> bool:
        gradient = state[m]["gradient"][free[m]]
        if state[m]["loss"][0] <= SEPARATED * state[m]["weight"][0]:
            return True
        return not len(gradient) or np.abs(gradient).max() <= tolerance * state[m]["weight"][0]

    steps = {m: _step(state[m]["gradient"], state[m]["curvature"].reshape(k * d, -1), free[m]) for m in members}
    length = dict.fromkeys(members, 1.0)
    open_ = [m for m in members if not converged(m)]
    for _ in range(max_steps):
        if not open_:
            break
        tried = {m: now[m] - length[m] * steps[m].reshape(k, d) for m in open_}
        got = sums_of(tried, allowed)
        for m in list(open_):
            loss, before = got[m]["loss"][0], state[m]["loss"][0]
            if np.isfinite(loss) and loss <= before * (1 + 1e-12):
                now[m], state[m], length[m] = tried[m], got[m], 1.0
                steps[m] = _step(state[m]["gradient"], state[m]["curvature"].reshape(k * d, -1), free[m])
                if converged(m):
                    open_.remove(m)
            else:
                length[m] /= 2
                if length[m] < 1e-9:
                    open_.remove(m)
    return now, allowed


def fit_members(
    rows: DataFrame,
    members: Sequence[int],
    n_classes: int,
    n_input: int,
    masks: Sequence[Sequence[bool]] | None = None,
    tolerance: float = TOLERANCE,
    max_steps: int = MAX_STEPS,
    cache=None,
) -> dict[int, LinearModel]:
    """A model for each of ``members``, positions in the ``weights`` of ``rows(features, label,
    weights)``. ``rows`` is read once and kept in blocks, which are read once per step.

    ``masks`` names, by member, the features it sees. Two classes share one weight per feature,
    that of class 1. A class without rows is never predicted. A member without rows raises.
    """
    k, d = n_classes, n_input
    with kept(pack(rows, d, k), cache, passes=2) as blocks:
        now, allowed = _descended(blocks, members, k, d, masks, tolerance, max_steps)
    models = {}
    for m in members:
        weights = now[m]
        if k > 2:
            weights = np.where(allowed[m][:, None], weights - weights[allowed[m]].mean(axis=0), 0.0)
        intercepts = np.where(allowed[m], 0.0, -np.inf)
        models[m] = LinearModel(tuple(float(c) for c in range(k)), intercepts, weights)
    return models
