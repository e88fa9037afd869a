"""Uniform numbers that belong to a row, not to a task.

A draw is a hash of a salt and the row's key. It is the same after a repartition, a task
retry or the loss of an executor, so no draw ever has to be stored to stay valid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("md5", "xxhash64", "random")
DRAWS_PER_DIGEST = 4


def salt_of(name: str, seed=None) -> str:
    """The salt of a draw; the seed is part of it."""
    return name if seed is None else f"{name}#{seed}"


def digest(salt: str, key: Sequence[str | Column]) -> Column:
    """The ``md5`` of salt and key; it holds DRAWS_PER_DIGEST draws."""
    return F.md5(F.concat_ws("|", F.lit(salt), *key))


def draw_of(digest: str | Column, part: int = 0) -> Column:
    """Draw number ``part`` of a digest: 32 of its bits over 2^32."""
    # By way of a long: parsing a double costs more than the digest does.
    return F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("long") / F.lit(2.0**32)


def uniform(salt: str, key: Sequence[str | Column], method: str = "md5") -> Column:
    """A uniform double in [0, 1) per row.

    ``md5`` is repeatable in any SQL engine (first 32 bits of the digest over 2^32).
    ``xxhash64`` is repeatable in Spark only, and several times cheaper. ``random`` is
    Spark's own per-task generator: the draws change when the partitions change.
    """
    if method != "random" and not key:
        raise ValueError(f"{method} draws need key columns; without a key use method='random'")
    if method == "md5":
        return draw_of(digest(salt, key))
    if method == "xxhash64":
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(salt), *key), 11)
        return bits.cast("double") * F.lit(2.0**-53)
    if method == "random":
        return F.rand(int(hashlib.md5(salt.encode()).hexdigest()[:8], 16))
    raise ValueError(f"method must be one of {METHODS}")


def uniform_of(text: str) -> float:
    """The ``md5`` draw of a plain string, on the driver (for per-model draws)."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2.0**32
