"""Scalar and array expressions that turn raw columns into inputs, outputs and labels."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to this many elements an array is built from one expression per element, which Spark
# compiles. Longer ones use higher-order functions: the plan stays small, and the generated
# method stays below the size at which the JVM stops compiling it.
UNROLL_LIMIT = 32
# Declared lists of more values than this are looked up by hash and not walked through.
WIDE_DOMAIN = 256
_SEPARATOR = "\u0001"


def literal_array(values: Sequence) -> Column:
    """A constant array (folded to one literal by the optimizer). Many strings are handed over as
    one, so that a plan of a long list has as few nodes as that of a short one."""
    if len(values) > WIDE_DOMAIN and all(isinstance(v, str) and _SEPARATOR not in v for v in values):
        return F.split(F.lit(_SEPARATOR.join(values)), _SEPARATOR)
    return F.array(*[F.lit(v) for v in values])


def nominal_code(value: Column, values: Sequence) -> Column:
    """Position of ``value`` in the declared list, -1 if it is not there."""
    if len(values) > WIDE_DOMAIN and all(isinstance(v, str) and _SEPARATOR not in v for v in values):
        return _hashed_code(value.cast("string"), values)
    position = F.array_position(literal_array(values), value)
    return (F.coalesce(position, F.lit(0)) - 1).cast("double")


def _numbers(values: Sequence[int]) -> Column:
    """A constant array of many numbers, folded to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _hashed_code(value: Column, values: Sequence[str]) -> Column:
    """:func:`nominal_code` of a long list, in buckets of about two values each by ``crc32``. The
    list is a constant of the plan: it is as large as the header that declares it, whatever the
    number of rows."""
    first = {v: i for i, v in reversed(list(enumerate(values)))}
    buckets: list[list[str]] = [[] for _ in range(1 << (len(first) // 2).bit_length())]
    for v in first:
        buckets[zlib.crc32(v.encode()) % len(buckets)].append(v)
    starts = [0]
    for bucket in buckets:
        starts.append(starts[-1] + len(bucket))
    in_order = [v for bucket in buckets for v in bucket]
    own = F.pmod(F.crc32(value.cast("binary")), F.lit(len(buckets))).cast("int")
    start = F.get(_numbers(starts), own)
    there = F.slice(literal_array(in_order), start + 1, F.get(_numbers(starts), own + 1) - start)
    place = F.array_position(there, value).cast("int")
    code = F.get(_numbers([first[v] for v in in_order]), start + place - 1)
    return F.when(place > 0, code).otherwise(-1).cast("double")


def class_onehot(code: Column, n_classes: int) -> Column:
    """One-hot array with 1.0 at ``code``."""
    if n_classes <= UNROLL_LIMIT:
        return F.array(*[F.when(code == float(i), 1.0).otherwise(0.0) for i in range(n_classes)])
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)),
        lambda i: F.when(code == i.cast("double"), 1.0).otherwise(0.0),
    )


def label_from_onehot(outputs: Column) -> Column:
    """The *last* index holding exactly 1.0, or -1.0 when there is none."""
    hits = F.transform(outputs, lambda x, i: F.when(x == 1.0, i.cast("double")))
    return F.coalesce(F.array_max(hits), F.lit(-1.0))


def rescale(value: Column, low: float, high: float, on_zero_range: str = "nan") -> Column:
    """``(value - low) / (high - low)`` with the declared range; never clipped.

    With a zero range ``"nan"`` gives what a double division gives (NaN for 0/0, a signed
    infinity otherwise) and ``"zero"`` gives 0.0. A plain division would raise under ANSI
    mode, so the case is decided here, on the driver.
    """
    if on_zero_range not in ("nan", "zero"):
        raise ValueError("on_zero_range must be 'nan' or 'zero'")
    if high != low:
        return (value - F.lit(float(low))) / F.lit(float(high) - float(low))
    if on_zero_range == "zero":
        return F.when(value.isNotNull(), 0.0)
    return (
        F.when(F.isnan(value) | (value == low), F.lit(float("nan")))
        .when(value > low, F.lit(float("inf")))
        .when(value < low, F.lit(float("-inf")))
    )


def rescale_array(
    inputs: Column, lows: Sequence[float], highs: Sequence[float], on_zero_range: str = "nan"
) -> Column:
    """Element-wise :func:`rescale` of an array column."""
    if len(lows) <= UNROLL_LIMIT:
        return F.array(
            *[rescale(inputs[i], lo, hi, on_zero_range) for i, (lo, hi) in enumerate(zip(lows, highs))]
        )
    if len(set(lows)) == 1 and len(set(highs)) == 1:
        return F.transform(inputs, lambda x: rescale(x, lows[0], highs[0], on_zero_range))
    ranges = F.arrays_zip(literal_array(lows).alias("lo"), literal_array(highs).alias("hi"))

    def one(x, r):
        width = r["hi"] - r["lo"]
        zero = rescale(x - r["lo"], 0.0, 0.0, on_zero_range)
        return F.when(width == 0.0, zero).otherwise((x - r["lo"]) / F.nullif(width, F.lit(0.0)))

    return F.zip_with(inputs, ranges, one)


def mask_features(features: Column, keep: Sequence[bool]) -> Column:
    """Set every feature whose flag is False to 0.0."""
    if all(keep):
        return features
    if len(keep) <= UNROLL_LIMIT:
        return F.array(*[features[j] if k else F.lit(0.0) for j, k in enumerate(keep)])
    return F.zip_with(features, literal_array(list(keep)), lambda x, k: F.when(k, x).otherwise(0.0))


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Round on the scaled value, half to even: ``rint(x * 100) / 100``."""
    scale = float(10**digits)
    return F.rint(value * scale) / F.lit(scale)
