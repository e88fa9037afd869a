"""Decision trees of many samples at once.

The members of an ensemble (bags, folds) differ in which rows count how much. One scan per
level sums the weights of every member's rows by node, feature, bin and class; the driver picks
the cut of every node from the sums and the next scan sends the rows one level down. What is
shuffled and collected are the sums that are not 0, never a row.

Cuts are chosen as ``pyspark.ml`` chooses them: Gini impurity, candidate cuts halfway between
neighbouring values of the member's sample, or at quantiles where a feature has more values
than bins; both sides must hold a row; a node that gains nothing is a leaf. Of cuts equal to
ROUNDING digits the first feature and the lowest cut win.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.operators.blocks import pack, unpack
from quorum.operators.durable import kept

#: Most sums per member and level; larger trees are left to ``pyspark.ml``.
SUM_LIMIT = 1 << 17
ROUNDING = 6
#: A cut must gain more than this much weighted impurity.
LEAST_GAIN = 1e-9
#: Relative error of quantiles is 1 over this.
QUANTILE_ACCURACY = 10_000


@dataclass(frozen=True, eq=False)
class GroupedTree:
    """A full binary tree by position: node n has the children 2n + 1 and 2n + 2. Below a leaf
    its class is repeated, so that every row walks ``depth`` steps."""

    n_input: int
    depth: int
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return predict_trees(df, [[self]], [out])

    def deepened(self, depth: int) -> GroupedTree:
        """The same tree with more steps."""
        more = (1 << depth) - (1 << self.depth)
        return GroupedTree(
            self.n_input,
            depth,
            np.concatenate([self.features, np.zeros(more, int)]),
            np.concatenate([self.thresholds, np.full(more, np.inf)]),
            np.repeat(self.leaves, 1 << (depth - self.depth)),
        )


def _literal(values: np.ndarray, kind: str) -> str:
    spelled = ",".join(str(v) if kind == "int" else repr(float(v)) for v in values.ravel().tolist())
    spelled = spelled.replace("inf", "Infinity")
    return f"cast(split('{spelled}', ',') AS array<{kind}>)"


def predict_trees(
    df: DataFrame, model_sets: Sequence[Sequence[GroupedTree]], names: Sequence[str], chooser: str | None = None
) -> DataFrame:
    """Add one predicted class column per model set, as ``linear.predict_many`` does: the trees
    of a set are one constant in which a row steps through the tree it chose. A step is a column
    of its own, which keeps the generated code short."""
    for d in {tree.n_input for models in model_sets for tree in models}:
        df = df.filter(f"if(size(features) <=> {d}, true, raise_error('a row must hold {d} features'))")
    spare = []
    for name, models in zip(names, model_sets):
        depth = max(tree.depth for tree in models)
        trees = [tree.deepened(depth) for tree in models]
        features = _literal(np.array([t.features for t in trees], int), "int")
        thresholds = _literal(np.array([t.thresholds for t in trees]), "double")
        leaves = _literal(np.array([t.leaves for t in trees]), "double")
        inner = (1 << depth) - 1
        pick = "0" if chooser is None else chooser
        at = f"_at_{name}"
        df = df.withColumn(f"{at}_0", F.lit(0))
        spare.append(f"{at}_0")
        for step in range(depth):
            here = f"({pick}) * {inner} + {at}_{step}"
            side = f"if(get(features, get({features}, {here})) <= get({thresholds}, {here}), 1, 2)"
            df = df.withColumn(f"{at}_{step + 1}", F.expr(f"cast(2 * {at}_{step} + {side} AS int)"))
            spare.append(f"{at}_{step + 1}")
        leaf = f"get({leaves}, ({pick}) * {inner + 1} + {at}_{depth} - {inner})"
        df = df.withColumn(name, F.expr(leaf if chooser is None else f"if({pick} < {len(trees)}, {leaf}, null)"))
    return df.drop(*spare)


def suits(n_classes: int, n_input: int, depth: int, max_bins: int) -> bool:
    return (1 << max(depth - 1, 0)) * n_input * max_bins * n_classes <= SUM_LIMIT


@dataclass(frozen=True, eq=False)
class Bins:
    """The bins of one feature: ``edges[b]`` is the largest value of bin b; the last bin is open."""

    edges: np.ndarray
    values: bool  # whether the edges are the feature's values

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.edges, x), self.size - 1)

    @property
    def size(self) -> int:
        return len(self.edges) + (not self.values)

    def cut(self, low: int, high: int) -> float:
        """The threshold between two bins that hold rows, with none between them."""
        return float(self.edges[low] + self.edges[high]) / 2 if self.values else float(self.edges[low])


def find_bins(rows: DataFrame, blocks: DataFrame, n_input: int, max_bins: int) -> list[Bins]:
    """All values of a feature that has at most ``max_bins``, else quantiles."""

    def run(batches):
        seen: list[np.ndarray | None] = [np.zeros(0)] * n_input
        for x, _, _ in unpack(batches):
            for j, values in enumerate(seen):
                if values is not None:
                    values = np.union1d(values, x[j])
                    seen[j] = values if len(values) <= max_bins else None
        for j, values in enumerate(seen):
            values = [None] if values is None else values
            yield pa.RecordBatch.from_arrays(
                [pa.array([j] * len(values), pa.int32()), pa.array(values, pa.float64())], ["feature", "value"]
            )

    found: list[set] = [set() for _ in range(n_input)]
    for row in blocks.mapInArrow(run, "feature int, value double").distinct().toLocalIterator():
        if len(found[row.feature]) <= max_bins:
            found[row.feature].add(row.value)
    many = [j for j, values in enumerate(found) if None in values or len(values) > max_bins]
    bins = [Bins(np.array(sorted(v - {None})), True) for v in found]
    if many:
        shares = [i / max_bins for i in range(1, max_bins)]
        quantiles = rows.agg(
            *[F.percentile_approx(F.col("features")[j], shares, QUANTILE_ACCURACY).alias(f"q{j}") for j in many]
        ).first()
        for j in many:
            bins[j] = Bins(np.unique(np.array(quantiles[f"q{j}"], float)), False)
    return bins


def node_sums(blocks: DataFrame, bins: list[Bins], trees: dict[int, list], n_classes: int, level: int) -> DataFrame:
    """``member``, ``position``, ``value``: weight sums of the members' rows by node of the
    level, feature, bin and class. ``trees`` holds, per member, the cut (feature, bin) of every
    node above, or None for a leaf, whose rows are left out."""
    d, k, width = len(bins), n_classes, max(b.size for b in bins)
    first = (1 << level) - 1
    size = (1 << level) * d * width * k
    tables = {}
    for m, cuts in trees.items():
        feature = np.array([c[0] if c else -1 for c in cuts], int)
        tables[m] = feature, np.array([c[1] if c else 0 for c in cuts], int)

    def run(batches):
        held = {m: np.zeros(size) for m in trees}
        for x, y, w in unpack(batches):
            binned = np.stack([b.of(x[j]) for j, b in enumerate(bins)])
            for m, (feature, cut) in tables.items():
                part = np.flatnonzero(w[m] > 0)
                node = np.zeros(len(part), int)
                for _ in range(level):
                    split_on = feature[node]
                    inside = split_on >= 0
                    part, node, split_on = part[inside], node[inside], split_on[inside]
                    node = 2 * node + 1 + (binned[split_on, part] > cut[node])
                for j in range(d):
                    at = (((node - first) * d + j) * width + binned[j, part]) * k + y[part]
                    held[m] += np.bincount(at, w[m, part], size)
        for m, sums in held.items():
            there = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(there), m, np.int32)), pa.array(there), pa.array(sums[there])],
                ["member", "position", "value"],
            )

    parts = blocks.mapInArrow(run, "member int, position long, value double")
    return parts.groupBy("member", "position").agg(F.sum("value").alias("value"))


def _best_cut(sums: np.ndarray, usable: list[np.ndarray]):
    """The cut of one node from its sums by (feature, bin, class): (feature, bin, class sums on
    the left, on the right), or None. ``usable[j]`` are the bins after which feature j may be cut."""
    total = sums[0].sum(axis=0)
    n = total.sum()
    before = n - (total @ total) / n
    best = None
    for j, bins in enumerate(usable):
        if not len(bins):
            continue
        left = sums[j].cumsum(axis=0)[bins]
        right = total - left
        nl, nr = left.sum(axis=1), right.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = nl - (left**2).sum(axis=1) / nl + nr - (right**2).sum(axis=1) / nr
        legal = (nl > 0) & (nr > LEAST_GAIN) & (before - impurity > LEAST_GAIN)
        if legal.any():
            rounded = np.where(legal, np.round(impurity, ROUNDING), np.inf)
            i = int(rounded.argmin())
            if best is None or rounded[i] < best[0]:
                best = rounded[i], j, int(bins[i]), left[i], right[i]
    return best and best[1:]


def fit_members(
    rows: DataFrame,
    members: Sequence[int],
    n_classes: int,
    n_input: int,
    depth: int,
    max_bins: int,
    masks: Sequence[Sequence[bool]] | None = None,
    cache=None,
) -> dict[int, GroupedTree]:
    """A tree for each of ``members``, positions in the ``weights`` of ``rows(features, label,
    weights)``. ``masks`` names, by member, the features it sees. ``rows`` is read once and
    kept in blocks, which are read once for the bins and once per level; only quantiles read
    ``rows`` again. A member without rows raises."""
    with kept(pack(rows, n_input, n_classes), cache, passes=2) as blocks:
        bins = find_bins(rows, blocks, n_input, max_bins)
        return _grown(blocks, bins, members, n_classes, depth, masks)


def _grown(blocks, bins, members, n_classes, depth, masks) -> dict[int, GroupedTree]:
    n_input = len(bins)
    width = max(b.size for b in bins)
    cuts: dict[int, list] = {m: [] for m in members}
    leaves = {m: np.zeros(1, int) for m in members}
    usable: dict[int, list[np.ndarray]] = {}
    following: dict[int, list[np.ndarray]] = {}
    for level in range(max(depth, 1)):
        growing = {m: cuts[m] for m in members if level == 0 or any(cuts[m][(1 << (level - 1)) - 1 :])}
        nodes = 1 << level
        got = {m: np.zeros(nodes * n_input * width * n_classes) for m in growing}
        if growing:
            collected = node_sums(blocks, bins, growing, n_classes, level).toPandas()
            for m, part in collected.groupby("member"):
                got[int(m)][part["position"].to_numpy()] = part["value"].to_numpy()
        for m in members:
            below = np.repeat(leaves[m], 2)
            found: list = [None] * nodes
            if m in growing:
                sums = got[m].reshape(nodes, n_input, width, n_classes)
                if level == 0:
                    if not sums.any():
                        raise ValueError(f"a tree was given no rows for member {m}")
                    leaves[m][0] = sums[0, 0].sum(axis=0).argmax()
                    below[:] = leaves[m][0]
                    there = [np.flatnonzero(sums[0, j].any(axis=1)) for j in range(n_input)]
                    seen = [masks is None or masks[m][j] for j in range(n_input)]
                    usable[m] = [t[:-1] if s else t[:0] for t, s in zip(there, seen)]
                    following[m] = [t[1:] if s else t[:0] for t, s in zip(there, seen)]
                for i in range(nodes if depth else 0):
                    cut = _best_cut(sums[i], usable[m]) if sums[i].any() else None
                    if cut:
                        found[i] = cut[:2]
                        below[2 * i], below[2 * i + 1] = cut[2].argmax(), cut[3].argmax()
            cuts[m] += found
            leaves[m] = below
    models = {}
    for m in members:
        feature, threshold = np.zeros(len(cuts[m]), int), np.full(len(cuts[m]), np.inf)
        for i, cut in enumerate(cuts[m]):
            if cut:
                j, low = cut
                high = following[m][j][np.searchsorted(usable[m][j], low)]
                feature[i], threshold[i] = j, bins[j].cut(low, int(high))
        models[m] = GroupedTree(n_input, max(depth, 1), feature, threshold, leaves[m].astype(float))
    return models
