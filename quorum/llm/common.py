"""What several operators share: tables in the shared folder, bounded batches, joins that
survive hot keys, and connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.operators.durable import ensure_checkpoint_dir

#: Rows of text handed to Python at once; whole texts, so memory follows the longest ones.
BATCH_ROWS = 500
#: A key counts as hot when it has more than this share of the rows; at most 1 / HOT_SHARE
#: keys can, which bounds what the hot side of a join broadcasts.
HOT_SHARE = 1e-4
#: Upper bound of a membership bitmap, in bits. A full bitmap only lets more rows through.
MAX_BITMAP_BITS = 24

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with batches of BATCH_ROWS rows where the session has Spark's default."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) == 10_000:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


_STORED: list[str] = []


def shared_path(spark: SparkSession) -> str:
    """A new path in the session's shared checkpoint folder. See ``release``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    path = f"{folder.rstrip('/')}/quorum-{uuid.uuid4().hex}"
    _STORED.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The frame, written as Parquet to the session's shared checkpoint folder and read back:
    its lineage ends there, and a lost executor costs a read."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_since(mark: int) -> list[str]:
    return _STORED[mark:]


def stored_mark() -> int:
    return len(_STORED)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables of ``stored`` (all by default). Frames that read them end with this."""
    for path in list(_STORED if paths is None else paths):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _STORED:
            _STORED.remove(path)


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores added until no column of the frame, in any case, is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is. ``lower`` is far cheaper than
    ``translate`` and means the same where the text has nothing beyond ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())
    )


def doc_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bitmap:
    """A set of 64-bit values with false positives and no false negatives, of bounded size."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, int(words.size * 64).bit_length() - 1

    def has(self, values: np.ndarray) -> np.ndarray:
        at = values.astype(np.int64).view(np.uint64) & np.uint64((1 << self.bits) - 1)
        word = self.words[(at >> np.uint64(6)).astype(np.int64)]
        return ((word >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def bitmap_of(values: DataFrame, column: str) -> Bitmap:
    """The bitmap of a long column. It is folded by ``bit_or`` on the executors: what reaches
    the driver is the bitmap's own words, 2 MB at most, and never the values."""
    n = values.count()
    bits = min(MAX_BITMAP_BITS, max(12, (8 * n).bit_length()))
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        values.select(F.shiftright(at, 6).alias("w"), at.bitwiseAND(F.lit(63)).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v"))
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    got = words.toArrow()
    out[got["w"].to_numpy()] = got["v"].to_numpy().view(np.uint64)
    return Bitmap(out)


def skew_join(
    left: DataFrame, right: DataFrame, key: str | list[str], how: str = "left", weight: str | None = None
) -> DataFrame:
    """``left`` joined with ``right``, unique on ``key``, whatever share of ``left`` a key has.

    Keys with over HOT_SHARE of the rows are counted first; there are at most 1 / HOT_SHARE
    of them, so their rows of ``right`` are broadcast. The other keys go through a plain join.
    Both inputs are read more than once and should be stored; ``right`` should be narrow.
    ``weight`` names a column of ``right`` that holds the count already; it is dropped.
    A null key joins nothing. Nothing runs before the result is asked for.
    """
    keys = [key] if isinstance(key, str) else key
    if weight:
        counts = right.select(*keys, F.col(weight).alias("_n"))
        total = right.agg(F.sum(weight).alias("n"))
        right = right.drop(weight)
    else:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        total = left.agg(F.count(F.lit(1)).alias("n"))
    bound = F.greatest(F.lit(1.0), F.coalesce(total.scalar(), F.lit(0)) * HOT_SHARE)
    hot = F.broadcast(counts.filter(F.col("_n") > bound).select(*keys).dropna())
    in_hot = left.join(F.broadcast(right.join(hot, keys, "left_semi")), keys, "inner")
    # A hot key that ``right`` doesn't have is left to the plain join, and so stays whole there.
    hot_known = F.broadcast(right.select(*keys).join(hot, keys, "left_semi"))
    rest = left.join(hot_known, keys, "left_anti")
    return in_hot.unionByName(rest.join(right, keys, how))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` for every node of the edges ``a``, ``b`` (longs, no self loops).

    Contraction: every node points at the neighbour, or itself, that comes first in a
    pseudo-random order; the edges are renamed by it until none are left. The order keeps
    chains from taking a round per link, and a star takes two rounds. The component's name is
    one of its nodes. Each round is stored, so no lineage builds up.
    """
    spark = edges.sparkSession
    rank = lambda c: F.struct(F.xxhash64(F.lit(17), c).alias("h"), F.col(c).alias("v"))
    edges = stored(edges.select("a", "b").filter("a <> b").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        to = stored(first.select("a", F.least(rank("a"), F.col("m"))["v"].alias("to")))
        steps.append(to)
        renamed = stored(skew_join(edges, to, "a", "inner").select("b", F.col("to").alias("x")))
        to_b = to.select(F.col("a").alias("b"), "to")
        renamed = skew_join(renamed, to_b, "b", "inner").select(
            F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b")
        )
        edges = stored(renamed.filter("a <> b").distinct())
    if not steps:
        return spark.createDataFrame([], "node long, component long")
    out = steps[0].select(F.col("a").alias("node"), F.col("to").alias("component"))
    for to in steps[1:]:
        step = to.select(F.col("a").alias("component"), F.col("to").alias("_to"))
        moved = skew_join(stored(out), step, "component", "left")
        out = moved.select("node", F.coalesce("_to", "component").alias("component"))
    return stored(out)
