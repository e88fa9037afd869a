"""Exact duplicates by composable polynomial fingerprints.

A text's bytes are coefficients of a polynomial, evaluated at a fixed point modulo two primes.
A chunk's value is one vector product; two neighbours combine by shifting the left value by
the right one's length (``combine``). A text of up to LONG_BYTES is folded where it stands; the
chunks of a longer one are dealt to the tasks by themselves, hashed there and shifted by the
bytes behind them, and meet in a grouped sum. Texts whose fingerprints are equal are then compared chunk by chunk: the copies of a
chunk meet in a grouped minimum and maximum, which combine before the shuffle, so no task ever
holds a group or even two whole texts.

* null text counts as empty; empty texts are equal to each other.
* the row with the smallest ``doc_id`` stays (null ids last), among rows with that id exactly one.
* repeated rows are copies like all others; extra columns are not read.
* an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.llm.common import bitmap_of, map_batches, skew_join, stored, unused_names

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
#: Bytes of a chunk. A product of a byte and a power is below 2**39, so a chunk sums exactly.
CHUNK_BYTES = 1 << 14
#: Texts of more bytes are hashed by many tasks. A matter of work alone: both ways give one value.
LONG_BYTES = 1 << 20

KEY = ["n_bytes", "fp"]


def normalised(text: Column) -> Column:
    """Null as empty, every run of ASCII white space as one space. Only runs that change are matched."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def combine(left: int, right: int, right_length: int, base: int, prime: int) -> int:
    """The fingerprint of a concatenation from those of its parts."""
    return (left * pow(base, right_length, prime) + right) % prime


def _powers(base: int, prime: int) -> np.ndarray:
    out = np.ones(CHUNK_BYTES, np.int64)
    done = 1
    while done < CHUNK_BYTES:  # doubling: powers n..2n are powers 0..n times base**n
        out[done : 2 * done] = out[:done] * pow(base, done, prime) % prime
        done *= 2
    return out[::-1].copy()


def chunk_hashes(data: np.ndarray, powers: np.ndarray, prime: int) -> np.ndarray:
    """The values of all chunks at once; only the last may be shorter."""
    full = len(data) // CHUNK_BYTES
    whole = data[: full * CHUNK_BYTES].reshape(full, CHUNK_BYTES)
    values = [int(np.dot(row.astype(np.int64), powers)) % prime for row in whole]
    rest = data[full * CHUNK_BYTES :]
    if len(rest):
        values.append(int(np.dot(rest.astype(np.int64), powers[-len(rest) :])) % prime)
    return np.array(values, np.int64)


def fingerprint(data: bytes, powers: list[np.ndarray], primes=PRIMES, bases=BASES) -> int:
    """Both residues in one signed 64-bit value."""
    array = np.frombuffer(data, np.uint8)
    out = 0
    for p, prime, base in zip(powers, primes, bases):
        value, done = 0, 0
        for h in chunk_hashes(array, p, prime):
            length = min(CHUNK_BYTES, len(array) - done)
            value = combine(value, int(h), length, base, prime)
            done += length
        out = out << 31 | value
    return out


def _fingerprints(primes, bases):
    def run(batches):
        powers = [_powers(b, p) for b, p in zip(bases, primes)]
        for batch in batches:
            data = batch.column(batch.schema.get_field_index("_norm"))
            fps = [fingerprint(v.as_py(), powers, primes, bases) for v in data]
            sizes = [len(v.as_py()) for v in data]
            names = [n for n in batch.schema.names if n != "_norm"]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sizes, pa.int64()), pa.array(fps, pa.int64())], [*names, *KEY]
            )

    return run


def _shifted(primes, bases):
    """The values of chunks of long texts, each shifted by the bytes of its text behind it."""

    def run(batches):
        powers = [_powers(b, p) for b, p in zip(bases, primes)]
        for batch in batches:
            at = {name: batch.column(name) for name in ("data", "chunk", "n_bytes")}
            values: list[list[int]] = [[] for _ in primes]
            for data, chunk, n_bytes in zip(at["data"], at["chunk"].to_pylist(), at["n_bytes"].to_pylist()):
                array = np.frombuffer(data.as_py(), np.uint8)
                behind = n_bytes - chunk * CHUNK_BYTES - len(array)
                for out, power, prime, base in zip(values, powers, primes, bases):
                    out.append(combine(int(chunk_hashes(array, power, prime)[0]), 0, behind, base, prime))
            columns = [pa.array(v, pa.int64()) for v in values]
            names = [f"v{i}" for i in range(len(primes))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return run


def _long_chunks(rows: DataFrame, primes, bases) -> DataFrame:
    """The chunks of ``rows(rid, doc_id, text_sha256, _norm)`` with their shifted values, stored."""
    n_bytes = F.octet_length("_norm").cast("long").alias("n_bytes")
    last = F.floor((F.octet_length("_norm") - 1) / CHUNK_BYTES).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.substring(F.col("_norm"), i * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)),
    )
    pieces = rows.select("rid", "doc_id", "text_sha256", n_bytes, F.posexplode(cut).alias("chunk", "data"))
    pieces = pieces.withColumn("chunk", F.col("chunk").cast("long")).repartition("rid", "chunk")
    schema = T.StructType([*pieces.schema.fields, *(T.StructField(f"v{i}", T.LongType()) for i in range(len(primes)))])
    return stored(map_batches(pieces, _shifted(primes, bases), schema))


def _summed(chunks: DataFrame, primes) -> DataFrame:
    """``rid, doc_id, text_sha256, n_bytes, fp`` of the texts that ``_long_chunks`` has cut."""
    fp = F.lit(0).cast("long")
    for i, prime in enumerate(primes):
        fp = F.shiftleft(fp, 31).bitwiseOR(F.sum(f"v{i}") % prime)
    return chunks.groupBy("rid", "doc_id", "text_sha256", "n_bytes").agg(fp.alias("fp"))


def _chunks(primes, bases, candidates):
    """Chunks of the texts whose fingerprint may be that of a group."""

    def run(batches):
        powers = [_powers(b, p) for b, p in zip(bases, primes)]
        maybe = candidates.value
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for v, digest in zip(batch.column("_norm"), batch.column("text_sha256")):
                data = v.as_py()
                fp = fingerprint(data, powers, primes, bases)
                if not maybe.has(np.array([fp]))[0]:
                    continue
                for i in range(0, max(len(data), 1), CHUNK_BYTES):
                    rows.append((len(data), fp, digest.as_py(), i // CHUNK_BYTES, data[i : i + CHUNK_BYTES]))
                    size += CHUNK_BYTES
                    if size > 1 << 24:
                        yield _chunk_batch(rows)
                        rows, size = [], 0
            if rows:
                yield _chunk_batch(rows)

    return run


_CHUNK_FIELDS = [
    ("n_bytes", pa.int64()),
    ("fp", pa.int64()),
    ("text_sha256", pa.string()),
    ("chunk", pa.int64()),
    ("data", pa.binary()),
]


def _chunk_batch(rows):
    arrays = [pa.array(list(values), kind) for values, (_, kind) in zip(zip(*rows), _CHUNK_FIELDS)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in _CHUNK_FIELDS])


def _mixed(short: DataFrame, summed: DataFrame, cut: DataFrame, groups: DataFrame, key: list[str], primes, bases) -> DataFrame:
    """Those keys of ``groups`` under which texts differ in some chunk. Long texts are ``cut``
    already, their fingerprints are in ``summed``."""
    candidates = short.sparkSession.sparkContext.broadcast(bitmap_of(groups, "fp"))
    norm = normalised(F.col("text"))
    texts = short.select(norm.cast("binary").alias("_norm"), F.sha2(norm, 256).alias("text_sha256"))
    schema = "n_bytes long, fp long, text_sha256 string, chunk long, data binary"
    chunks = map_batches(texts, _chunks(primes, bases, candidates), schema)
    suspects = stored(skew_join(summed, groups, KEY, "inner").select("rid", "fp"))
    known = skew_join(cut, suspects, "rid", "inner")
    chunks = chunks.unionByName(known.select(*KEY, "text_sha256", "chunk", "data"))
    compared = chunks.groupBy(*key, "chunk").agg(F.min("data").alias("a"), F.max("data").alias("b"))
    return compared.filter("a <> b").select(*key).distinct()


def classes(docs: DataFrame, primes=PRIMES, bases=BASES, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``rid`` (a number of the row), ``doc_id``,
    ``text_sha256`` (of the normalised text), ``keep_id``, ``keep_rid``, ``group_size``, ``kept``."""
    is_long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))
    short, long = docs.filter(~is_long), docs.filter(is_long)
    norm = normalised(F.col("text"))

    def numbered(part: DataFrame, odd: int) -> DataFrame:
        """Even and odd numbers, so that the two parts share none."""
        return part.select(
            (F.monotonically_increasing_id() * 2 + odd).alias("rid"),
            "doc_id",
            F.sha2(norm, 256).alias("text_sha256"),
            norm.cast("binary").alias("_norm"),
        )

    schema = f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_sha256 string, n_bytes long, fp long"
    folded = map_batches(numbered(short, 0), _fingerprints(primes, bases), schema)
    cut = _long_chunks(numbered(long, 1), primes, bases)
    summed = stored(_summed(cut, primes))
    rows = stored(folded.unionByName(summed))

    counted = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*KEY)
    mixed = stored(_mixed(short, summed, cut, stored(counted), KEY, primes, bases))
    # Fingerprints that different texts share: their rows are told apart by digest as well,
    # and compared again under it.
    rows = rows.join(mixed.withColumn("_m", F.lit(True)), KEY, "left")
    rows = rows.withColumn("_split", F.when(F.col("_m"), F.col("text_sha256")).otherwise("")).drop("_m")
    if not mixed.isEmpty():
        fine = [*KEY, "text_sha256"]
        if not _mixed(short, summed, cut, mixed, fine, primes, bases).join(mixed, KEY, "left_semi").isEmpty():
            raise ValueError("different texts share length, fingerprint and digest")
    key = [*KEY, "_split"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rid"))
    groups = rows.groupBy(*key).agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.filter("group_size > 1").select(
        *key, F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), "group_size"
    )
    joined = skew_join(stored(rows), stored(groups), key)
    single = F.col("group_size").isNull()
    return joined.select(
        "rid",
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(single, F.col("rid")).otherwise(F.col("keep_rid")).alias("keep_rid"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
    ).withColumn("kept", F.col("rid") == F.col("keep_rid"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text an earlier one has; all columns of the others."""
    sha, at, same = unused_names(docs, "_text_sha", "_id", "_sha")
    kept = classes(docs).filter("kept").select(F.col("doc_id").alias(at), F.col("text_sha256").alias(same))
    marked = docs.withColumn(sha, F.sha2(normalised(F.col("text")), 256))
    on = marked["doc_id"].eqNullSafe(kept[at]) & (marked[sha] == kept[same])
    # Rows that repeat both id and text are the same to the join: one of them stays.
    return marked.join(kept, on, "left_semi").dropDuplicates(["doc_id", sha]).select(*docs.columns)
