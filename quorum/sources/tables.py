"""Labelled sets from ordinary tables (parquet or anything Spark reads)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.functions.encode import UNROLL_LIMIT, class_onehot, nominal_code, rescale, rescale_array
from quorum.schema import REAL, Attribute, Dataset, DatasetMeta, real


def _as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _label_code(label: Column, classes: Sequence, on_bad_row: str) -> Column:
    code = nominal_code(label, classes)
    if on_bad_row == "drop":
        return code
    message = F.concat(F.lit("unknown class: "), F.coalesce(label.cast("string"), F.lit("NULL")))
    return F.when(code < 0, F.raise_error(message)).otherwise(code)


def from_table(
    df: DataFrame,
    attributes: Sequence[Attribute],
    label: str | Column,
    classes: Sequence,
    key: Sequence[str],
    values: Mapping[str, Column] | None = None,
    on_bad_row: str = "raise",
    on_zero_range: str = "nan",
    name: str = "",
) -> Dataset:
    """A :class:`Dataset` from the columns of ``df``.

    ``attributes`` lists the inputs in order; each is read from the column of its name, or
    from ``values[name]`` where that is given. ``classes`` is the ordered class list and
    ``label`` the column (or expression) holding one of them.
    """
    if on_bad_row not in ("raise", "drop"):
        raise ValueError("on_bad_row must be 'raise' or 'drop'")
    values = values or {}
    meta = DatasetMeta(tuple(attributes), tuple(classes))
    key = list(key)
    columns = [_as_column(values.get(a.name, a.name)) for a in attributes]
    number = (lambda c: c.try_cast("double")) if on_bad_row == "drop" else (lambda c: c.cast("double"))
    raw = [
        number(c) if a.kind == REAL else nominal_code(c, a.values)
        for c, a in zip(columns, attributes)
    ]
    code = _label_code(_as_column(label), meta.classes, on_bad_row).alias("_c")
    if meta.n_input <= UNROLL_LIMIT:
        names = [f"_x{i}" for i in range(meta.n_input)]
        rows = df.select(*key, *[c.alias(n) for c, n in zip(raw, names)], code)
        reals = {n: a for n, a in zip(names, attributes) if a.kind == REAL}
        if on_bad_row == "drop":
            for n in reals:
                rows = rows.filter(F.col(n).isNotNull())
        elif reals:
            rows = rows.withColumns(
                {
                    n: F.coalesce(F.col(n), F.raise_error(F.lit(f"NULL in column {a.name}")))
                    for n, a in reals.items()
                }
            )
        inputs = F.array(*names)
        features = F.array(
            *[
                rescale(F.col(n), a.range_min, a.range_max, on_zero_range) if a.kind == REAL else F.col(n)
                for n, a in zip(names, attributes)
            ]
        )
    else:
        rows = df.select(*key, F.array(*raw).alias("_x"), code)
        hole = F.exists("_x", lambda x: x.isNull())
        if on_bad_row == "drop":
            rows = rows.filter(~hole)
        else:
            message = F.lit("NULL in a real input column")
            rows = rows.withColumn("_x", F.when(hole, F.raise_error(message)).otherwise(F.col("_x")))
        inputs = F.col("_x")
        spans = [(a.range_min, a.range_max) if a.kind == REAL else (0.0, 1.0) for a in attributes]
        features = rescale_array(
            inputs, [lo for lo, _ in spans], [hi for _, hi in spans], on_zero_range
        )
    if on_bad_row == "drop":
        rows = rows.filter(F.col("_c") >= 0)
    frame = rows.select(
        *key,
        inputs.alias("inputs"),
        class_onehot(F.col("_c"), meta.n_output).alias("outputs"),
        features.alias("features"),
        F.col("_c").alias("label"),
    )
    return Dataset(frame, meta, tuple(key), name, raw=df)


def from_array_table(
    df: DataFrame,
    column: str,
    size: int,
    low: float,
    high: float,
    label: str | Column,
    classes: Sequence,
    key: Sequence[str],
    on_bad_row: str = "raise",
    on_zero_range: str = "nan",
    name: str = "",
) -> Dataset:
    """A :class:`Dataset` whose inputs are one array column of ``size`` reals that share a
    declared range. The plan does not grow with ``size``."""
    inputs = tuple(real(f"{column}_{i}", low, high) for i in range(size))
    meta = DatasetMeta(inputs, tuple(classes))
    key = list(key)
    array = F.col(column).cast("array<double>")
    if on_bad_row == "drop":
        array = F.transform(column, lambda x: x.try_cast("double"))
    whole = (F.size(array) == size) & ~F.exists(array, lambda x: x.isNull())
    code = _label_code(_as_column(label), meta.classes, on_bad_row)
    if on_bad_row == "drop":
        rows = df.filter(F.coalesce(whole, F.lit(False)) & (nominal_code(_as_column(label), classes) >= 0))
        rows = rows.select(*key, array.alias("inputs"), code.alias("_c"))
    else:
        message = F.lit(f"{column} must hold {size} values and no NULL")
        rows = df.select(
            *key,
            F.when(whole, array).otherwise(F.raise_error(message)).alias("inputs"),
            code.alias("_c"),
        )
    frame = rows.select(
        *key,
        "inputs",
        class_onehot(F.col("_c"), meta.n_output).alias("outputs"),
        rescale_array(F.col("inputs"), [low] * size, [high] * size, on_zero_range).alias("features"),
        F.col("_c").alias("label"),
    )
    return Dataset(frame, meta, tuple(key), name, raw=df)
