"""N-gram Jaccard join by parity sketches.

A set's *parity sketch* has one bit per cell: every shingle hashes to a cell and flips it, so
what two sets share cancels out of the XOR of their sketches and its weight (the Hamming
distance) is at most the size of their symmetric difference. Sets of at most H shingles that
link differ in at most k = 2H (1 - t) / (1 + t) shingles, so of k + 1 + s blocks of their
sketches at least 1 + s are equal bit for bit. Blocks are therefore join keys:

* sets are dealt to *size bands*; a set also enters a band above its own if a linked partner
  could be there, and within a band all sets use the same number of blocks.
* shingles that very many texts have are left out of the blocks, which loses no link (see
  ``block_keys``) and keeps common lines from being keys. All texts are counted for this.
* of the k + 1 + s blocks a set needs no more than its first k + 1 in one order for all as
  keys. Those with most bits come first, so that blocks of one shingle are rarely keys. An
  empty block tells nothing and is no key: a set of too few blocks with bits repeats this under
  other hash seeds, and after the last is keyed by its first shingles in one order for all,
  frequent ones last (prefix filtering), so no link is lost and sets that share only a common
  line or empty blocks do not all meet under one key.
* equal sets are merged first, so exact copies cost one row.

In a bucket (sets that share a key), no list of pairs is built: a leader is compared with the
others, then leaves the bucket, and members of one component are never compared again. A
bucket is done when its members are all in one component or alone. Candidates must pass the
Hamming bound of a second sketch before their texts are fetched and their shingles counted.

* null and empty texts, and texts without words, have no shingles and link with nothing.
* a text with fewer words than a shingle is one shingle, its whole sequence of words.
* repeated rows are equal sets. Null ids take part; a component of nothing else has a null id.
* extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.llm.common import (
    Bitmap,
    bitmap_of,
    connected_components,
    map_batches,
    mix,
    release,
    skew_join,
    stored,
    stored_mark,
    stored_since,
    unused_names,
)

#: Cells of a block: far more than there are shingles in it, so that unrelated blocks differ.
#: Sketches are sparse, and only the cells with a bit are ever held.
BLOCK_CELLS = 1 << 30
#: The share of the texts that makes a shingle frequent, the cells that shingles are counted
#: in, and how many of these are added up at once.
FREQUENT = 2e-3
CELLS = 1 << 20
CELLS_PART = 1 << 14
#: Bytes of a key as it is stored and dealt out: equal ends of different keys only make
#: candidates, which are compared. Keys that a task deals out, and compares, at once.
KEY_BYTES = 5
KEYS_DEALT = 1 << 19
KEYS_COMPARED = 1 << 20
#: Least bits of the sketch that candidates are compared by; it has at least one per shingle.
SKETCH_BITS = 1 << 8
BAND_RATIO = 1.4
#: Leaders that leave a bucket in each round after the first.
LEADERS = 256
#: Copies of a leader's text that its candidates may be spread over.
SALTS = 4096

U = np.uint64


class Jaccard:
    """Shingle size and threshold, ``num / den``, and the bands they lead to."""

    def __init__(self, shingle: int, num: int, den: int):
        self.shingle, self.num, self.den = shingle, num, den
        self.tops: list[int] = [1]
        self.slacks: dict[int, int] = {}

    def top(self, band: int) -> int:
        while len(self.tops) <= band:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * BAND_RATIO)))
        return self.tops[band]

    def bands(self, n: int) -> list[int]:
        """The band of sets of ``n`` shingles, and those above where a partner could be."""
        band = 0
        while self.top(band) < n:
            band += 1
        out = [band]
        while self.den * n >= self.num * (self.top(out[-1]) + 1):
            out.append(out[-1] + 1)
        return out

    def slack(self, band: int) -> int:
        if band not in self.slacks:
            top = self.top(band)
            below = self.top(band - 1) + 1 if band else 1
            self.slacks[band] = _slack(self.differ(2 * top), max(1.0, self.num / self.den * below))
        return self.slacks[band]

    def differ(self, both: int) -> int:
        """The most shingles in which two linked sets of ``both`` shingles together can differ."""
        return both * (self.den - self.num) // (self.den + self.num)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        same = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * same >= self.num * (len(a) + len(b) - same)


def shingles(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of every text's word shingles. ``bytes.split`` cuts at
    the six ASCII white-space characters, ``bytes.lower`` touches A-Z alone."""
    words = [(t or "").encode().lower().split() for t in texts]
    flat = np.empty(sum(map(len, words)), object)
    flat[:] = [w for ws in words for w in ws]
    hashed = pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, U)
    out, at = [], 0
    for ws in words:
        h = hashed[at : at + len(ws)]
        at += len(ws)
        width = min(size, len(h))
        if not width:
            out.append(np.empty(0, U))
            continue
        acc = np.full(len(h) - width + 1, width, U)
        for i in range(width):
            acc = mix(acc * U(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
        out.append(np.unique(acc))
    return out


def set_hash(grams: np.ndarray) -> tuple[int, int]:
    """Two independent sums over a set, as signed 64-bit integers."""
    a = mix(grams ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U)
    b = mix(grams + U(0x632BE59BD9B4E019)).sum(dtype=U)
    return int(a.view(np.int64)), int(b.view(np.int64))


def sketch(grams: np.ndarray) -> np.ndarray:
    """The parity sketch candidates are compared by, as signed 64-bit words. Its size is a
    power of two; XORing its halves gives the sketch of half the size."""
    bits = max(SKETCH_BITS, 1 << (len(grams) - 1).bit_length()) if len(grams) else SKETCH_BITS
    cells = np.bincount((mix(grams ^ U(0x1F83D9ABFB41BD6B)) & U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _seeds(top: int) -> int:
    return 4 if top < 64 else 2 if top < 256 else 1


def _slack(k: int, least: float) -> int:
    """Blocks beyond k + 1: three deviations more than the empty ones that a set of ``least``
    shingles, the smallest of a band, is expected to have."""
    slack = 1
    for _ in range(20):
        empty = (k + 1 + slack) * math.exp(-least / (k + 1 + slack))
        slack = math.ceil(empty + 3 * math.sqrt(empty))
    return slack


def _blocks(grams: np.ndarray, band: int, seed: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for every block of the set's sketch, and its number of bits."""
    h = mix(grams ^ U(((band << 8 | seed) + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    block = (h >> U(30)) % U(blocks)
    cells = np.sort(block * U(BLOCK_CELLS) + (h & U(BLOCK_CELLS - 1)))
    # A cell that an even number of shingles hit is empty again.
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.empty(0, int)
    odd = cells[first[np.diff(np.append(first, len(cells))) % 2 == 1]]
    of = (odd // U(BLOCK_CELLS)).astype(np.int64)
    value = np.zeros(blocks, U)
    if len(odd):
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        value[of[starts]] = np.bitwise_xor.reduceat(mix(odd + U(1)), starts)
    tag = np.arange(blocks, dtype=U) + U(band << 48 | seed << 40)
    return mix(value ^ mix(tag)), np.bincount(of, minlength=blocks)


def _is_frequent(grams: np.ndarray, frequent: Bitmap | np.ndarray | None) -> np.ndarray:
    """Which shingles ``frequent``, a bitmap or a sorted list, holds."""
    if isinstance(frequent, Bitmap):
        return frequent.has(grams)
    if frequent is None or not len(frequent):
        return np.zeros(len(grams), bool)
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    return frequent[at] == grams


def block_keys(grams: np.ndarray, jaccard: Jaccard, frequent: Bitmap | np.ndarray | None = None) -> np.ndarray:
    """The join keys of a set: blocks with bits, by band and seed.

    Shingles of ``frequent`` are left out first: a block that holds nothing else would join
    texts that share no more than a common line. Leaving the same shingles out of two sets
    never makes them differ in more.

    Blocks are put in one order for all sets, those of most bits first, and a set gives no more
    than its first ``d + 1``, if it can differ by ``d`` from a set that links with it in the
    band. Of these at least one is equal in both, and the first equal one is among the first
    of the other set as well, for no more than ``d`` blocks differ. It is a key of both unless
    it is empty, which takes a set of fewer than ``d + 1`` blocks with bits. Such a set goes on
    to the next seed, where it meets the others of its kind, and after the last one to the
    keys of its first shingles (see ``_prefix``). Blocks of all its shingles would not do:
    those that hold only frequent ones are the same for every text with a common line.
    """
    n = len(grams)
    rare = grams[~_is_frequent(grams, frequent)]
    keys = []
    for band in jaccard.bands(n):
        top = jaccard.top(band)
        k = jaccard.differ(2 * top)
        if k == 0:
            continue  # only equal sets link, and those are merged
        take = jaccard.differ(n + min(top, n * jaccard.den // jaccard.num)) + 1
        for seed in range(_seeds(top)):
            key, bits = _blocks(rare, band, seed, k + 1 + jaccard.slack(band))
            first = np.lexsort((key, -bits))[:take]
            first = first[bits[first] > 0]
            keys.append(key[first])
            if len(first) == take:
                break
        else:
            keys.append(_prefix(grams, band, jaccard, frequent))
    return np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)


def _prefix(grams: np.ndarray, band: int, jaccard: Jaccard, frequent: Bitmap | np.ndarray | None) -> np.ndarray:
    """Keys of the first shingles of a set in one order for all sets, frequent ones last.

    Two sets that link share at least ``num / den`` of the larger one's shingles, so of a set's
    ``n - ceil(num * n / den) + 1`` first ones at least one is in the other's first ones too.
    Unlike empty blocks, which all sparse sets of a band have, these keys are the set's own.
    """
    common = _is_frequent(grams, frequent)
    order = mix(grams ^ U(0x3C6EF372FE94F82B))
    first = np.lexsort((order, common))
    n = len(grams)
    take = n - (jaccard.num * n + jaccard.den - 1) // jaccard.den + 1
    tag = mix(np.array([band << 48 | 0xFF << 40], U) + U(1))
    return mix(grams[first[:take]] ^ tag)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of unsigned 64-bit integers, all first bytes first."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8").astype(U)


def _count_cells(size: int):
    """How many shingles of the task's texts fall into each of CELLS cells, in parts."""

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        held, pending = [], 0
        for batch in batches:
            own = shingles(batch.column(0).to_pylist(), size)
            held += [(g & U(CELLS - 1)).astype(np.int32) for g in own]
            pending += sum(map(len, own))
            if pending >= CELLS // 4:
                counts += np.bincount(np.concatenate(held), minlength=CELLS)
                held, pending = [], 0
        if pending:
            counts += np.bincount(np.concatenate(held), minlength=CELLS)
        if counts.any():
            parts = counts.view(U).reshape(-1, CELLS_PART)
            packed = [pa.compress(_planes(x, 8), "zstd", asbytes=True) for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(packed)], ["part", "counts"])

    return run


def _add_cells(table: pa.Table) -> pa.Table:
    total = np.zeros(CELLS_PART, U)
    for packed in table["counts"]:
        total += _from_planes(pa.decompress(packed.as_py(), 8 * CELLS_PART, "zstd", asbytes=True), 8)
    packed = pa.compress(_planes(total, 8), "zstd", asbytes=True)
    return pa.table({"part": table["part"][:1], "counts": pa.array([packed])})


def frequent_shingles(docs: DataFrame, jaccard: Jaccard) -> Bitmap:
    """Shingles that more than FREQUENT of all texts have.

    All shingles of all texts are counted, in CELLS cells of their hashes, so that neither the
    shuffle nor the result grows with the number of different ones. A cell is frequent if it
    has as many shingles more than the average cell. A rare shingle in one of these cells is
    taken for a frequent one: which ones are has no effect on the links found, only on the
    work it takes.
    """
    total = docs.count()
    counted = map_batches(docs.select("text"), _count_cells(jaccard.shingle), "part int, counts binary")
    got = counted.groupBy("part").applyInArrow(_add_cells, "part int, counts binary").toArrow()
    cells = np.zeros((CELLS // CELLS_PART, CELLS_PART), U)
    for part, packed in zip(got["part"].to_pylist(), got["counts"].to_pylist()):
        cells[part] = _from_planes(pa.decompress(packed, 8 * CELLS_PART, "zstd", asbytes=True), 8)
    cells = cells.reshape(-1)
    over = cells >= max(4.0, FREQUENT * total) + cells.mean()
    return Bitmap(np.packbits(over, bitorder="little").view(U))


def _describe(jaccard: Jaccard, frequent):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            n, fp, fq, words, keys = [], [], [], [], []
            for grams in shingles(texts, jaccard.shingle):
                a, b = set_hash(grams)
                own = block_keys(grams, jaccard, frequent.value) if len(grams) else np.empty(0, np.int64)
                own = np.unique(own.view(U) >> U(64 - 8 * KEY_BYTES))
                n.append(len(grams)), fp.append(a), fq.append(b)
                words.append(sketch(grams))
                keys.append(own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes())
            widths = np.cumsum([0, *map(len, words)])
            sketches = pa.ListArray.from_arrays(pa.array(widths, pa.int32()), pa.array(np.concatenate(words)))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(n, pa.int64()), pa.array(fp), pa.array(fq), sketches, pa.array(keys, pa.binary())],
                [*kept, "n", "fp", "fq", "sketch", "keys"],
            )

    return run


def _fetch(jaccard: Jaccard, wanted):
    """The texts of wanted sets, one per set and task. A set is known by the hash of one of its
    texts, so that only texts which may be wanted are cut into shingles again."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            may = wanted.value.has(batch.column(1).to_numpy())
            texts = batch.column(0).filter(pa.array(may)).to_pylist()
            rows = []
            for text, grams in zip(texts, shingles(texts, jaccard.shingle)):
                if not len(grams):
                    continue
                name = set_hash(grams)
                if name not in seen:
                    seen.add(name)
                    rows.append((*name, text))
            if rows:
                fp, fq, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp, pa.int64()), pa.array(fq, pa.int64()), pa.array(kept)], ["fp", "fq", "text"]
                )

    return run


def _verify(jaccard: Jaccard):
    def run(batches):
        last, grams_a = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts_a, texts_b = batch.column(2), batch.column(3)
            linked = []
            for i, grams_b in enumerate(shingles(texts_b.to_pylist(), jaccard.shingle)):
                if a[i] != last:
                    last, grams_a = a[i], shingles([texts_a[i].as_py()], jaccard.shingle)[0]
                linked.append(jaccard.linked(grams_a, grams_b))
            mask = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _fold(x: Column, to: Column) -> Column:
    """The sketch at the size ``to``, which is its own or half of it."""
    halves = F.zip_with(F.slice(x, F.lit(1), to), F.slice(x, to + 1, to), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(x) == to, x).otherwise(halves)


def _hamming(x: Column, y: Column) -> Column:
    least = F.least(F.size(x), F.size(y))
    x, y = _fold(x, least), _fold(y, least)
    weights = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(weights, F.lit(0), lambda acc, w: acc + w)


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, jaccard: Jaccard) -> DataFrame:
    """Those of the distinct candidate ``pairs`` (``a``, ``b``) that link."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    known = skew_join(pairs, side("a"), "a", "inner")
    known = skew_join(stored(known), side("b"), "b", "inner")
    both = F.col("n_a") + F.col("n_b")
    most = F.floor(both * (jaccard.den - jaccard.num) / F.lit(jaccard.den + jaccard.num))
    close = (
        (jaccard.den * F.least("n_a", "n_b") >= jaccard.num * F.greatest("n_a", "n_b"))
        & (_hamming(F.col("s_a"), F.col("s_b")) <= most)
    )
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS))
    near = stored(known.filter(close).select("a", "b", salt.alias("salt")))

    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    wanted = stored(nodes.join(ends, "node", "left_semi").select("node", "fp", "fq", "text_hash"))
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "text_hash"))
    rows = docs.select("text", F.xxhash64("text").alias("text_hash"))
    texts = map_batches(rows, _fetch(jaccard, bitmap), "fp long, fq long, text string")
    texts = texts.groupBy("fp", "fq").agg(F.first("text").alias("text"))
    texts = stored(texts.join(wanted.drop("text_hash"), ["fp", "fq"]).select("node", "text"))
    # A leader's text is copied once for every salt among its candidates, never more often
    # than it has candidates, so that a leader of very many is spread over tasks.
    copies = near.select("a", "salt").distinct().join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    of_b = near.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    ready = of_b.join(copies, ["a", "salt"]).select("a", "b", "text_a", "text_b")
    return stored(map_batches(ready, _verify(jaccard), "a long, b long"))


def describe(docs: DataFrame, jaccard: Jaccard, keep: list[str]) -> DataFrame:
    """One row per document: its number ``rid``, the columns ``keep``, size, hashes, sketch, and
    its keys, of KEY_BYTES each."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), *keep, F.xxhash64("text").alias("text_hash"), "text")
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, jaccard))
    return map_batches(
        rows, _describe(jaccard, frequent), f"{kinds}, n long, fp long, fq long, sketch array<long>, keys binary"
    )


def components(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``rid``, ``doc_id``, ``keep``, ``n_shingles``,
    ``n_links`` (links found of its set; at least enough to connect it), ``component`` (its
    name) and ``component_id``, the smallest ``doc_id`` that links lead to. Two texts link when ``den`` times the shared
    shingles are at least ``num`` times the united ones."""
    jaccard = Jaccard(shingle, num, den)
    if not 0 < num <= den:
        raise ValueError("the threshold must be over 0 and at most 1")
    mark = stored_mark()
    described = stored(describe(docs, jaccard, ["doc_id", *keep]))
    shared = stored(_shared_keys(described))
    with_keys, described = stored_since(mark)[0], stored(described.drop("keys"))
    release(docs.sparkSession, [with_keys])
    described, nodes = _named_sets(described)
    member = stored(shared.join(described.select("rid", "node"), "rid").select("key", "node").distinct())
    buckets = member.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    member = stored(skew_join(member, stored(buckets), "key", "inner", weight="m"))

    pairs = stored(member.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    links = [_links(docs, nodes, pairs, jaccard)]
    tested = pairs
    # What the first leaders have linked needs no more comparisons among itself; these links
    # are nearly all there are.
    component = connected_components(links[0])
    left = member.filter("node <> leader").select("key", "node")
    left = skew_join(left, component, "node").select("key", "node", F.coalesce("component", "node").alias("c"))
    left = stored(left)
    while True:
        left, pairs = _next_pairs(left, tested)
        if pairs is None:
            break
        tested = stored(tested.unionByName(pairs))
        links.append(_links(docs, nodes, pairs, jaccard))
    if len(links) > 1:
        component = connected_components(_union(links))

    edges = _union(links)
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    linked = stored(component.join(degree, "node"))
    rows = skew_join(described.filter("n > 0").select("rid", "doc_id", *keep, "n", "node"), linked, "node")
    rows = rows.withColumns(
        {"component": F.coalesce("component", "node"), "n_links": F.coalesce("n_links", F.lit(0)).cast("long")}
    )
    rows = stored(rows)
    smallest = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("m"))
    several = stored(smallest.filter("m > 1"))
    named = skew_join(rows, several, "component", weight="m")
    # A component of one row is named after that row.
    named = named.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    columns = ["rid", "doc_id", *keep, F.col("n").alias("n_shingles"), "n_links", "component", "component_id"]
    alone = described.filter("n = 0").withColumns(
        {"n_links": F.lit(0).cast("long"), "component": -1 - F.col("rid"), "component_id": F.col("doc_id")}
    )
    return named.select(*columns).unionByName(alone.select(*columns))


def _named_sets(described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``described`` with ``node``, the name of its set, and one row for every set.

    The name is the set's first hash. Different sets of one hash (the second hash tells) get
    names made of both."""
    sets = described.filter("n > 0").groupBy("fp").agg(
        F.min("fq").alias("fq"), F.max("fq").alias("_fq"), F.first("n").alias("n"), F.first("text_hash").alias("text_hash"), F.first("sketch").alias("sketch")
    )
    sets = stored(sets)
    clash = sets.filter("fq <> _fq").select("fp", F.lit(True).alias("_clash"))
    if clash.isEmpty():
        nodes = sets.select(F.col("fp").alias("node"), "fp", "fq", "n", "text_hash", "sketch")
        return described.withColumn("node", F.col("fp")), nodes
    described = stored(
        described.join(clash, "fp", "left")
        .withColumn("node", F.when(F.col("_clash"), F.xxhash64("fp", "fq")).otherwise(F.col("fp")))
        .drop("_clash")
    )
    sets = described.filter("n > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "fq", "n", "text_hash", "sketch")])
    return described, stored(sets)


def _shared_keys(described: DataFrame) -> DataFrame:
    """``key``, ``rid`` of the keys that several rows of ``described`` have.

    Most keys belong to one row and are never written out as rows of their own: a task deals
    its keys out to the parts in packed lists, and a part gives back those it has twice.
    """
    bytes_ = described.agg(F.sum(F.octet_length("keys")).alias("n")).first()["n"] or 0
    parts = 1 + bytes_ // KEY_BYTES // KEYS_COMPARED
    with_keys = described.filter(F.octet_length("keys") > 0).select("rid", "fp", "fq", "keys")
    dealt = map_batches(with_keys, _deal(parts), "part long, base long, n long, body binary")
    return dealt.groupBy("part").applyInArrow(_several, "key long, rid long")


def _deal(parts: int):
    """Packed lists of a task's keys, and of the rows they belong to, for every part."""

    def packed(rids, keys):
        # One row of a list for every 65,536 rids; sorted keys, so that their steps are small.
        order = np.lexsort((keys, rids >> 16))
        rids, keys = rids[order], keys[order]
        base, part = rids >> 16 << 16, (keys * U(parts) >> U(8 * KEY_BYTES)).view(np.int64)
        new = np.concatenate([[True], (base[1:] != base[:-1]) | (part[1:] != part[:-1])])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(keys))
        body = [
            pa.compress(
                _planes(np.diff(keys[i:j], prepend=U(0)), KEY_BYTES) + _planes((rids[i:j] - base[i]).astype(U), 2),
                "zstd",
                asbytes=True,
            )
            for i, j in zip(starts, ends)
        ]
        arrays = [pa.array(part[starts]), pa.array(base[starts]), pa.array(ends - starts), pa.array(body, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["part", "base", "n", "body"])

    def run(batches):
        rids, keys, seen, held = [], [], set(), 0
        join = lambda: packed(np.repeat(rids, [len(k) // KEY_BYTES for k in keys]), _wide(b"".join(keys)))
        for batch in batches:
            for rid, fp, fq, own in zip(*(c.to_pylist() for c in batch.columns)):
                if (fp, fq) not in seen:  # equal sets share all keys anyway
                    seen.add((fp, fq))
                    rids.append(rid), keys.append(own)
                    held += len(own) // KEY_BYTES
                if held >= KEYS_DEALT:
                    yield join()
                    rids, keys, seen, held = [], [], set(), 0
        if held:
            yield join()

    return run


def _wide(keys: bytes) -> np.ndarray:
    """Keys of KEY_BYTES each as integers."""
    out = np.zeros((len(keys) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(keys, np.uint8).reshape(-1, KEY_BYTES)
    return out.reshape(-1).view("<u8").astype(U)


def _several(table: pa.Table) -> pa.Table:
    """The keys that the lists of a part have more than once, with their rows."""
    keys, rids = [], []
    for base, n, body in zip(table["base"].to_pylist(), table["n"].to_pylist(), table["body"]):
        data = pa.decompress(body.as_py(), n * (KEY_BYTES + 2), "zstd", asbytes=True)
        keys.append(np.cumsum(_from_planes(data[: n * KEY_BYTES], KEY_BYTES), dtype=U))
        rids.append(_from_planes(data[n * KEY_BYTES :], 2).view(np.int64) + base)
    key, rid = np.concatenate(keys), np.concatenate(rids)
    order = np.argsort(key)
    key, rid = key[order], rid[order]
    same = key[1:] == key[:-1]
    several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return pa.table({"key": key[several].view(np.int64), "rid": rid[several]})


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _next_pairs(left: DataFrame, tested: DataFrame):
    """What is left of the buckets (``key``, ``node``, component ``c``) and the next candidates.

    In a bucket of several components, members of all but its largest one are leaders, at most
    LEADERS of them in a round: each is paired with the members of other components, then leaves.
    """
    parts = left.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    order = F.struct("m", "c")
    open_ = parts.groupBy("key").agg(F.max(order).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    open_ = stored(open_.select("key", F.col("top.c").alias("largest")))
    if open_.isEmpty():
        return left, None
    left = stored(skew_join(left, open_, "key", "inner"))
    small = left.filter("c <> largest")
    turn = F.row_number().over(Window.partitionBy("key").orderBy("c", "node"))
    leaders = stored(small.withColumn("_t", turn).filter(F.col("_t") <= LEADERS).select("key", F.col("node").alias("lead"), F.col("c").alias("lead_c")))
    per_key = leaders.groupBy("key").agg(F.collect_list(F.struct("lead", "lead_c")).alias("leads"))
    met = skew_join(left, stored(per_key), "key", "inner").select("key", "node", "c", F.explode("leads").alias("l"))
    met = met.filter("c <> l.lead_c").select(F.least("node", "l.lead").alias("a"), F.greatest("node", "l.lead").alias("b"))
    pairs = stored(met.distinct().join(tested, ["a", "b"], "left_anti"))
    gone = leaders.select("key", F.col("lead").alias("node"))
    left = stored(left.join(gone, ["key", "node"], "left_anti").select("key", "node", "c"))
    return left, pairs


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with the first document (smallest id) of every component; all columns.
    Rows that repeat both id and text count as one."""
    key, same = unused_names(docs, "_text_key", "_key")
    marked = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    mark = stored_mark()
    found = components(marked, shingle, num, den, keep=(key,))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", key, "rid"))
    stays = found.groupBy("component").agg(first.alias("f"))
    kept = stored(stays.select(F.struct("f.doc_id", f"f.{key}").alias(same)))
    release(docs.sparkSession, stored_since(mark)[:-1])
    # One column for both, in which null ids are equal.
    marked = marked.select(*docs.columns, F.struct("doc_id", key).alias(same))
    return marked.join(kept, same, "left_semi").dropDuplicates([same]).select(*docs.columns)
