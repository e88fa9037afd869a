"""Token ids in binary shards: blocks of ids cut into byte or bit planes, each plane compressed.

A shard is one value of the form (all numbers little-endian)

    magic 4s | plane kind u8 | block size u32 | documents u64 | ids u64 | index bytes u32
    document index, zstandard: ids of each (int64), null flags (u8), lengths (u64)
    chunk index: compressed size of every plane of every block (u32)
    the planes, zstandard, block by block

so that any block can be read alone by the sums of the chunk index. Spark's own writer puts
the shards into a Parquet table, one row each, which makes the output whole or absent on any
file system, whatever executors are lost while it is written. Ids stand in ascending ``doc_id``
order (null ids first, texts of one id in the order of a hash).

* null text counts as empty and has the end id alone.
* repeated rows are written like all others, next to each other; extra columns are not read.
* an empty table gives no shards, and reading them gives no rows.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quorum.llm.bpe import LATIN_END, PieceCache, Remembered, id_bytes, latin_words
from quorum.llm.common import map_batches

MAGIC = b"QPL1"
HEAD = struct.Struct("<4sBIQQI")
BLOCK_IDS = 1 << 16
#: A shard is closed at the first document that brings it to this many ids.
SHARD_IDS = 1 << 20
LEVEL = 3
BYTE_PLANES, BIT_PLANES = 0, 1


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """A block of ids, transposed: all first bytes (or bits), all second ones and so on."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == BYTE_PLANES:
        return [raw[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if kind == BYTE_PLANES:
        raw = np.stack(rows, axis=1)
    else:
        bits = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def write_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, kind: int = BYTE_PLANES) -> bytes:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    index = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    index += np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.array(lengths, "<u8").tobytes()
    index = compressor.compress(index)
    planes = [
        compressor.compress(p)
        for i in range(0, len(ids), BLOCK_IDS)
        for p in to_planes(ids[i : i + BLOCK_IDS], kind)
    ]
    sizes = np.array([len(p) for p in planes], "<u4").tobytes()
    head = HEAD.pack(MAGIC, kind, BLOCK_IDS, len(doc_ids), len(ids), len(index))
    return b"".join([head, index, sizes, *planes])


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a shard."""
    magic, kind, block, n_docs, n_ids, index_size = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    zstd = zstandard.ZstdDecompressor()
    at = HEAD.size
    index = zstd.decompress(data[at : at + index_size])
    at += index_size
    raw_ids = np.frombuffer(index, "<i8", n_docs)
    missing = np.frombuffer(index, np.uint8, n_docs, 8 * n_docs)
    lengths = np.frombuffer(index, "<u8", n_docs, 9 * n_docs)
    per_block = 4 if kind == BYTE_PLANES else 32
    n_blocks = -(-n_ids // block)
    sizes = np.frombuffer(data, "<u4", n_blocks * per_block, at).reshape(n_blocks, per_block)
    at += sizes.nbytes
    out = np.empty(n_ids, "<u4")
    for b in range(n_blocks):
        n = min(block, n_ids - b * block)
        planes = []
        for size in sizes[b]:
            planes.append(zstd.decompress(data[at : at + int(size)]))
            at += int(size)
        out[b * block : b * block + n] = from_planes(planes, n, kind)
    return [None if m else int(d) for d, m in zip(raw_ids, missing)], lengths, out


class LibraryEncoder:
    """Ids of a piece of text by the tokenizer library.

    Texts are cut at ASCII white space, which its words never span and next to which its normal
    forms don't change. Pieces of Latin letters are cut further into the tokenizer's words,
    whose merges the library's model makes, once per word as long as it is remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)").search
        merge = self.tokenizer.model.tokenize
        self.words = Remembered(lambda word: id_bytes([t.id for t in merge(word)]))

    def __call__(self, piece: str) -> bytes:
        if (not piece.isascii() and max(piece) >= LATIN_END) or self.special(piece):
            return id_bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        self.words.turn()
        return b"".join(map(self.words.__getitem__, latin_words(piece)))


_CACHES: dict[str, PieceCache] = {}


def _write(path: str, end_id: int | None, kind: int):
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        if path not in _CACHES:
            _CACHES[path] = PieceCache(LibraryEncoder(path))
        ids_of = _CACHES[path]
        part = TaskContext.get().partitionId()
        seq, first, size = 0, 0, 0
        docs: list[int | None] = []
        parts: list[bytes] = []

        def shard():
            ids = np.frombuffer(b"".join(parts), "<u4")
            data = write_shard(docs, [len(p) // 4 for p in parts], ids, kind)
            arrays = [[part], [seq], [first], [len(ids)], [data]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(a, k) for a, k in zip(arrays, kinds)], ["part", "seq", "first", "n_ids", "payload"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                docs.append(doc_id.as_py())
                parts.append(ids_of(text.as_py()) + end)
                size += len(parts[-1]) // 4
                if size >= SHARD_IDS:
                    yield shard()
                    seq, first, size = seq + 1, first + size, 0
                    docs.clear()
                    parts.clear()
        if docs:
            yield shard()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, kind: int = BYTE_PLANES) -> None:
    """Encode ``docs(doc_id, text)`` and write the shards as a Parquet table at ``path``."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The hash and the row number spread an id that many rows share over several ranges.
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    rows = docs.select(
        F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row")
    )
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    shards = map_batches(
        ordered, _write(tokenizer, end_id, kind), "part int, seq long, first long, n_ids long, payload binary"
    )
    shards.write.option("compression", "uncompressed").parquet(path)


def _read(batches):
    for batch in batches:
        for part, first, payload in zip(batch.column(0), batch.column(1), batch.column(2)):
            docs, lengths, ids = read_shard(payload.as_py())
            ends = np.cumsum(lengths.astype(np.int64))
            starts = ends - lengths.astype(np.int64)
            for i in range(0, len(docs), 1000):
                j = min(i + 1000, len(docs))
                cut = ids[starts[i] : ends[j - 1]]
                offsets = pa.array(np.append(starts[i:j], ends[j - 1]) * 4 - starts[i] * 4, pa.int64())
                data = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), j - i, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(cut))]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * (j - i), pa.int32()),
                        pa.array(docs[i:j], pa.int64()),
                        pa.array(starts[i:j] + first.as_py()),
                        pa.array(lengths[i:j].astype(np.int64)),
                        data.cast(pa.binary()),
                    ],
                    ["part", "doc_id", "first", "n_tokens", "ids"],
                )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian
    unsigned 32-bit integers) of every document in the shards at ``path``."""
    shards = spark.read.parquet(path)
    # One row per written partition: as many as the writer was given, whatever the data.
    sizes = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    base = spark.createDataFrame(offsets, "part int, base long")
    rows = map_batches(
        shards.select("part", "first", "payload"), _read, "part int, doc_id long, first long, n_tokens long, ids binary"
    )
    joined = rows.join(F.broadcast(base), "part")
    return joined.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")
