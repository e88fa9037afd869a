"""Rendezvous hashing of record keys over weighted shards.

Every shard draws a number for a key, and the key goes to the shard that drew best. A draw
depends on the key and the shard's number alone, so a further shard takes rows only into
itself, a shard that leaves gives up its own rows only, and a changed weight moves rows only
from or to that shard. Nothing is stored and nothing is shuffled to find the shard of a row.

Edge cases: a null key counts as the empty text, whose rows all go to one shard. Rows with
equal keys share a shard whatever else they hold. An empty table gives an empty table. Extra
columns stay; a column that has the name of the result is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.llm.common import stored

#: Hex digits of a draw; 52 bits, which a double holds exactly.
DRAW_HEX = 13
#: Upper bound of (shard, bucket) pairs whose first slots are broadcast.
MAX_OFFSETS = 1 << 18
#: Copies of one row that a task writes out at a time.
COPIES = 1 << 16


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def draw(key: Column, shard: int) -> Column:
    """The shard's number for the key, from md5 so that any SQL engine can repeat it."""
    digest = F.md5(F.concat(key_text(key), F.lit(f"|{shard}")))
    return F.conv(F.substring(digest, 1, DRAW_HEX), 16, 10).cast("long")


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to ``len(weights) - 1``, of a key.

    With equal weights the largest draw wins. Otherwise the shard with the largest
    ``ln(u) / weight``, u being the draw as a fraction, which gives every shard its weight's
    share of the keys. A weight of 0 takes a shard out. Ties go to the lower shard.
    """
    if not weights or min(weights) < 0 or max(weights) == 0:
        raise ValueError("weights must not be negative, and one must be positive")
    draws = [draw(key, s) for s in range(len(weights))]
    if len(set(weights)) > 1:
        unit = 2.0 ** -(4 * DRAW_HEX)
        draws = [
            F.log((d + F.lit(0.5)) * F.lit(unit)) / F.lit(float(w)) if w else F.lit(None).cast("double")
            for d, w in zip(draws, weights)
        ]
    scores = F.array(*draws)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def assign(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """``df`` with the shard of every row."""
    return df.withColumn(out, shard_of(F.col(key), weights))


def slots(df: DataFrame, order: str, shards: int, shard: str = "shard", out: str = "slot") -> DataFrame:
    """The rows of narrow ``df`` with a number that runs from 0 without gaps in every shard.

    ``order`` names a hex digest of the row; within a shard rows are numbered by it and then
    by their other columns, so that numbers depend on the rows and not on partitions. The first
    digits of the digest part a shard into buckets that are numbered side by side. Rows equal
    in every column are counted before anything is sorted and are written out again in pieces,
    so that a row that makes up a third of the table fills no task.
    """
    columns = [c for c in df.columns if c != out]
    digits = next((d for d in (4, 3, 2) if shards * 16**d <= MAX_OFFSETS), 1)
    n, bucket, first, before, piece = (f"_{name}_{uuid.uuid4().hex}" for name in ("n", "b", "f", "o", "p"))
    counted = df.select(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias(n))
    counted = stored(counted.withColumn(bucket, F.substring(order, 1, digits)))

    def so_far(*by, sort):
        window = Window.partitionBy(*by).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(n).over(window), F.lit(0))

    sizes = counted.groupBy(shard, bucket).agg(F.sum(n).alias(n))
    offsets = sizes.select(shard, bucket, so_far(shard, sort=[bucket]).alias(before))
    if shards * 16**digits <= MAX_OFFSETS:
        offsets = F.broadcast(offsets)
    rest = [c for c in columns if c not in (order, shard)]
    placed = counted.withColumn(first, so_far(shard, bucket, sort=[order, *rest]))
    placed = placed.join(offsets, [shard, bucket]).withColumn(first, F.col(first) + F.col(before))
    pieces = placed.withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {COPIES}"))))
    start = F.col(piece) * COPIES
    last = F.least(F.col(n), start + COPIES) - 1
    return pieces.repartition(order, piece).select(
        *columns, F.explode(F.transform(F.sequence(start, last), lambda i: F.col(first) + i)).alias(out)
    )


def write_shards(
    df: DataFrame, path: str, shard: str = "shard", slot: str = "slot", rows_per_file: int = 1 << 20
) -> None:
    """Parquet with a folder per shard; rows of a shard are dealt over files by their slot."""
    part = (F.col(slot) / F.lit(rows_per_file)).cast("long")
    df.repartition(F.col(shard), part).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
