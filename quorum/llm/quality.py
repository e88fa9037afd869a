"""Quality by compression: two zstandard dictionaries, one built from good and one from bad
labelled text; the better one of them compresses a text, the likelier its label. A text is
compressed in blocks that each start afresh from the dictionary, so that its end counts as much
as its beginning.

``fit`` learns from a bounded sample of labelled rows, of which it reads the whole texts: two
thirds make the dictionaries, the others calibrate the score. The pieces of the texts are dealt to
parts of about PART_BYTES; a task builds the dictionary of a part, and the dictionary of a label's
parts is built from theirs. The driver holds dictionaries and numbers, and no text.
``score`` reads every whole text.

* null or empty text: both sizes are equal up to a constant; the calibrated score of that.
* ids labelled twice with different values are left out of the sample; equal repeats count once.
* no usable label of one of the classes: the score is the share of label 1 among the labels
  (0.5 without any).
* repeated rows and extra columns: every row is scored and keeps its columns; the score
  columns replace columns of the same name.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.llm.common import map_batches, stored

#: Labelled rows of each class that may enter the sample.
SAMPLE_ROWS = 3000
#: Text that one task builds a dictionary from. Longer texts make more parts.
PART_BYTES = 1 << 23
DICTIONARY_BYTES = 112_640
#: Texts are cut into pieces of this size for the dictionary builder.
PIECE_BYTES = 512
LEVEL = 3
#: Texts are compressed in blocks of this size, each on its own.
BLOCK_BYTES = 2048
#: Every third sampled row stays out of the dictionaries and calibrates the score.
CALIBRATE_EVERY = 3


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries of both labels and the logistic curve over the size difference."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float


def _compressors(good: bytes, bad: bytes):
    return [
        zstandard.ZstdCompressor(
            level=LEVEL,
            dict_data=zstandard.ZstdCompressionDict(d),
            write_checksum=False,
            write_content_size=False,
            write_dict_id=False,
        )
        for d in (good, bad)
    ]


def size_difference(compressors, data: bytes) -> float:
    """Compressed size under the bad dictionary less that under the good one, over their sum; a
    size is that of all blocks."""
    view = memoryview(data)
    blocks = [view[i : i + BLOCK_BYTES] for i in range(0, max(len(data), 1), BLOCK_BYTES)]
    good, bad = (sum(len(c.compress(b)) for b in blocks) for c in compressors)
    return (bad - good) / (bad + good)


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(dict.fromkeys(pieces))


def _cut(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]


def _dealt(shared):
    """The pieces of the texts that make dictionaries, each with its label's part it belongs to."""
    names = ["label", "part", "turn", "at", "piece"]

    def batch_of(rows):
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        turns, parts = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for label, turn, text in zip(*batch.columns):
                label, turn = label.as_py(), turn.as_py()
                if turn not in turns:
                    continue
                for at, piece in enumerate(_cut(text.as_py().encode())):
                    part = zlib.crc32(f"{turn}:{at}".encode()) % parts[label]
                    rows.append((label, part, turn, at, piece))
                    if len(rows) == 10_000:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)

    return run


def _of_part(group: pa.Table) -> pa.Table:
    """The dictionary of one part."""
    ordered = group.sort_by([("turn", "ascending"), ("at", "ascending"), ("piece", "ascending")])
    made = _dictionary(ordered["piece"].to_pylist())
    first = [ordered[name].slice(0, 1).cast(pa.int32()) for name in ("label", "part")]
    return pa.table([*first, pa.array([made], pa.binary())], ["label", "part", "made"])


def dictionaries(picked: DataFrame, turns: frozenset[int], n_bytes: dict[int, int], part_bytes: int = PART_BYTES) -> dict[int, bytes]:
    """The dictionary of each label, from all of the texts of ``picked(label, turn, text)`` whose
    turn is in ``turns``; ``n_bytes`` is the size of these by label."""
    parts = {label: -(-n // part_bytes) for label, n in n_bytes.items()}
    shared = picked.sparkSession.sparkContext.broadcast((turns, parts))  # a number per sampled row
    schema = "label int, part int, turn long, at long, piece binary"
    dealt = map_batches(picked.select("label", "turn", "text"), _dealt(shared), schema)
    made = dealt.groupBy("label", "part").applyInArrow(_of_part, "label int, part int, made binary").collect()
    out = {}
    for label in n_bytes:
        own = [bytes(r["made"]) for r in sorted(made, key=lambda r: r["part"]) if r["label"] == label]
        out[label] = own[0] if len(own) == 1 else _dictionary([piece for d in own for piece in _cut(d)])
    return out


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept of a lightly penalised logistic curve, by Newton's method. The weights
    count by their shares: they sum to the number of rows."""
    weight = np.ones_like(x) if weight is None else weight * (len(x) / weight.sum())
    design = np.column_stack([x / 0.01, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 1e-3 * w
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / 0.01), float(w[1])


def _differences(shared):
    """(label, turn, size difference) of the rows that calibrate."""

    def run(batches):
        good, bad, turns = shared.value
        compressors = _compressors(good, bad)
        for batch in batches:
            of = [(k, t, v) for k, t, v in zip(*(c.to_pylist() for c in batch.columns)) if t in turns]
            x = [size_difference(compressors, v.encode()) for _, _, v in of]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in of], pa.int32()), pa.array([t for _, t, _ in of], pa.int64()), pa.array(x, pa.float64())],
                ["label", "turn", "x"],
            )

    return run


def usable(labels: DataFrame, learn_from: Column) -> DataFrame:
    """``doc_id``, ``label`` of the ids that have one label."""
    return (
        labels.filter(learn_from & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("_other"))
        .filter("label = _other")
        .select("doc_id", F.col("label").cast("int").alias("label"))
    )


def sample(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``label``, ``text``, ``turn``: at most ``rows`` rows of each label, picked by a hash of the id."""
    chosen = usable(labels, learn_from)
    turn = F.xxhash64(F.lit(7), "doc_id")
    parts = [
        chosen.filter(F.col("label") == label).select("doc_id", "label", turn.alias("turn")).orderBy("turn").limit(rows)
        for label in (0, 1)
    ]
    # At most 2 * rows ids: a bounded broadcast.
    picked = F.broadcast(parts[0].unionByName(parts[1]))
    texts = docs.select("doc_id", "text").filter(F.length("text") > 0)
    # A repeated id brings one text: the bound holds for rows too.
    one = texts.join(picked, "doc_id").groupBy("doc_id", "label", "turn").agg(F.min("text").alias("text"))
    return one.select("label", "text", "turn")


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS) -> QualityModel:
    """The model of ``docs(doc_id, text)`` and ``labels(doc_id, quality)``, from the labels for
    which ``learn_from`` holds; numbers of at most ``rows`` rows of each label reach the driver."""
    picked = stored(sample(docs, labels, learn_from, rows))
    got = picked.select("label", "turn", F.octet_length("text").alias("size")).collect()
    by_label: dict[int, list] = {0: [], 1: []}
    for r in sorted(got, key=lambda r: (r["turn"], r["size"])):
        by_label[r["label"]].append(r)
    n = {k: len(v) for k, v in by_label.items()}
    # A label has more ids than were asked for where there are many: every row of the sample then
    # stands for several, so that the prior is that of all labels at every size.
    counted = usable(labels, learn_from).groupBy("label").count().collect()
    stands_for = {k: 1.0 for k in n} | {r["label"]: max(1.0, r["count"] / rows) for r in counted}
    stood = {k: n[k] * stands_for[k] for k in n}
    if not n[0] or not n[1]:
        share = stood[1] / (stood[0] + stood[1]) if n[0] + n[1] else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(b"", b"", 0.0, float(np.log(share / (1 - share))))
    train = {k: [r for i, r in enumerate(v) if i % CALIBRATE_EVERY] or v for k, v in by_label.items()}
    n_bytes = {k: sum(r["size"] for r in v) for k, v in train.items()}
    made = dictionaries(picked, frozenset(r["turn"] for v in train.values() for r in v), n_bytes)
    good, bad = made[1], made[0]
    turns = frozenset(r["turn"] for v in by_label.values() for r in v[::CALIBRATE_EVERY])
    shared = docs.sparkSession.sparkContext.broadcast((good, bad, turns))
    differences = map_batches(picked.select("label", "turn", "text"), _differences(shared), "label int, turn long, x double")
    kept = sorted(map(tuple, differences.collect()))
    x, y = np.array([d for _, _, d in kept]), np.array([k for k, _, _ in kept], float)
    slope, intercept = _calibrate(x, y, np.where(y == 1, stood[1] / y.sum(), stood[0] / (1 - y).sum()))
    return QualityModel(good, bad, slope, intercept)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with ``score``, 0 to 1, higher for likelier label 1. Reads the text alone."""
    docs = docs.drop("score")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of 110 KB at most
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType(), False)])

    def scored(batches):
        m = shared.value
        compressors = _compressors(m.good, m.bad) if m.good else None
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(at)):
                d = size_difference(compressors, (text.as_py() or "").encode()) if compressors else 0.0
                out[i] = 1 / (1 + np.exp(-np.clip(m.slope * d + m.intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "score"])

    return map_batches(docs, scored, schema)
