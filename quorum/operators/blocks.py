"""Training rows in blocks that numpy reads without conversion, for fits that scan them often."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "n int, features binary, label binary, weights binary, whole boolean"
_FIELDS = [("n", pa.int32()), ("features", pa.binary()), ("label", pa.binary()), ("weights", pa.binary()), ("whole", pa.bool_())]


def pack(rows: DataFrame, n_input: int, n_classes: int) -> DataFrame:
    """One row per Arrow batch of ``rows(features, label, weights)``, ``weights`` holding a weight
    per member. Rows that count for no member are left out; a row with another number of
    features or a label that is no class raises."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            features, label, weights = batch.columns
            x = features.flatten().to_numpy(zero_copy_only=False)
            if len(x) != n_input * batch.num_rows or set(features.value_lengths().unique().to_pylist()) != {n_input}:
                raise ValueError(f"a row must hold {n_input} features")
            y = label.to_numpy(zero_copy_only=False)
            if not np.isin(y, np.arange(n_classes)).all():
                raise ValueError(f"labels must be whole numbers from 0 to {n_classes - 1}")
            w = weights.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            counts = (w > 0).any(axis=1)
            x, y, w = x.reshape(-1, n_input)[counts].T, y[counts], w[counts].T
            # Draws are small whole numbers.
            whole = bool(w.size and w.max() < 256 and (w == np.floor(w)).all())
            values = (
                len(y),
                np.ascontiguousarray(x).tobytes(),
                y.astype(np.int32).tobytes(),
                np.ascontiguousarray(w.astype(np.uint8) if whole else w).tobytes(),
                whole,
            )
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, _FIELDS)], [c for c, _ in _FIELDS])

    blocks = rows.select("features", "label", "weights").mapInArrow(run, SCHEMA)
    # Few partitions hold few blocks, which are dealt evenly; many stay where they are.
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return blocks.repartition(tasks) if blocks.rdd.getNumPartitions() < tasks else blocks


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features (by feature), classes and weights (by member) of every block."""
    for batch in batches:
        for row in batch.to_pylist():
            n = row["n"]
            if n:
                weights = np.frombuffer(row["weights"], np.uint8 if row["whole"] else np.float64)
                yield (
                    np.frombuffer(row["features"], np.float64).reshape(-1, n),
                    np.frombuffer(row["label"], np.int32),
                    weights.reshape(-1, n).astype(float),
                )
