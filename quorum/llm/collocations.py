"""Phrase collocations from a weighted de Bruijn graph.

Nodes are stretches of LONGEST - 1 words, edges the stretches of LONGEST words that join two
overlapping nodes; the weight of an edge is how often it occurs. Only edges are counted from
the texts, and for every piece of text the shorter stretches at its end, which no edge starts.
A shorter stretch occurs as often as the stretches one word longer that start with it, plus its
own occurrences at the ends of pieces: a node as often as its edges out and its ends, and so on
down to single words. Tasks add up what they read before anything is shuffled. Edges are dealt
by the node they start from, which gives the nodes' counts in the same task; pairs of words and
single words are dealt by themselves, so that a frequent word does not gather all its pairs.

Of the stretches frequent enough, edges joined by a node that has one edge in and one out are
compacted into paths, by pointer jumping. Phrases and the longer phrases around them are read
off the paths.

Counts are exact and cover all pieces. Null texts are empty, a null language is ``und``. Words
may hold any character but those that separate. A language without frequent phrases has no row.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.llm.common import ASCII_UPPER, map_batches, mix, skew_join, stored

LONGEST = 4
UNKNOWN = "und"
#: Rounds: words of a stretch, by how many of them it is dealt, words of what it passes on to.
ROUNDS = ((LONGEST, LONGEST - 1, 2), (2, 2, 1), (1, 1, 0))
#: Bytes of text per partition of a round; the number of partitions follows the input.
PARTITION_BYTES = 1 << 25
#: A partition's stretches are added up a bucket at a time.
BUCKETS_PER_PARTITION = 2
MAX_PARTITIONS = 20_000
#: Words counted together before their counts leave the task.
GROUP_WORDS = 1 << 20
#: Rows of a bucket that wait before equal ones are added up.
HELD_ROWS = 1 << 20

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Marks the end of a piece while a text is split. No UTF-8 text holds this byte.
MARK = b"\xff"
#: What fills a stretch beyond the end of its piece.
END = b""
_TABLE = bytes.maketrans(
    ASCII_UPPER.encode() + SEPARATORS + b"\t", ASCII_UPPER.lower().encode() + MARK * len(SEPARATORS) + b" "
)
#: Either a packed part of a bucket (words, stretches) or a frequent phrase with its count.
ROW = "bucket int, lang string, words binary, stretches binary, phrase string, n long"
_SCHEMA = pa.schema(
    [
        ("bucket", pa.int32()),
        ("lang", pa.string()),
        ("words", pa.binary()),
        ("stretches", pa.binary()),
        ("phrase", pa.string()),
        ("n", pa.int64()),
    ]
)


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case, with END after every piece."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).replace(MARK, b" " + MARK + b" ")
    words = [w if w != MARK else END for w in data.split(b" ") if w]
    words.append(END)
    return words


class Stretches:
    """Counted stretches of equally many words: numbers into a list of words whose first is END."""

    def __init__(self, words: list[bytes], numbers: np.ndarray, counts: np.ndarray):
        self.words, self.numbers, self.counts = words, numbers, counts

    def levels(self) -> list[np.ndarray]:
        """For every length, which rows begin alike: a number of the beginning per row."""
        name = self.numbers[:, 0].astype(np.int64)
        out = [name]
        for k in range(1, self.numbers.shape[1]):
            name = np.unique(name * len(self.words) + self.numbers[:, k], return_inverse=True)[1]
            out.append(name)
        return out

    def beginnings(self, length: int, names: np.ndarray) -> Stretches:
        """The distinct beginnings of ``length`` words with their sums."""
        n = int(names.max()) + 1 if len(names) else 0
        sums, row = np.zeros(n, np.int64), np.full(n, -1)
        np.add.at(sums, names, self.counts)
        row[names] = np.arange(len(names))
        there = row >= 0
        return Stretches(self.words, self.numbers[row[there], :length], sums[there])

    def merged(self) -> Stretches:
        return self.beginnings(self.numbers.shape[1], self.levels()[-1])

    def frequent(self, least: int) -> tuple[list[str], list[int]]:
        """Those that end in a word and occur often enough, spelled out."""
        rows = np.flatnonzero((self.counts >= least) & (self.numbers[:, -1] != 0))
        spelled = [b" ".join([self.words[i] for i in r]).decode("utf-8", "surrogatepass") for r in self.numbers[rows].tolist()]
        return spelled, self.counts[rows].tolist()

    def dealt(self, lang: str, by: int, buckets: int):
        """Batches of packed rows, one per bucket of the first ``by`` words."""
        hashes = np.fromiter(map(zlib.crc32, self.words), np.uint64, len(self.words))
        h = np.zeros(len(self.counts), np.uint64)
        for k in range(by):
            h = mix(h + hashes[self.numbers[:, k]])
        bucket = (h % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1, append=-1))
        rows: list[list] = [[], [], []]
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = order[a:b]
            packed = _pack(self.words, self.numbers[at], self.counts[at])
            for column, value in zip(rows, (int(bucket[at[0]]), *packed)):
                column.append(value)
            # Small batches, so that Spark never holds many packed rows at once.
            if len(rows[0]) == 64:
                yield _batch(rows[0], [lang] * 64, *rows[1:])
                rows = [[], [], []]
        if rows[0]:
            yield _batch(rows[0], [lang] * len(rows[0]), *rows[1:])


def _batch(bucket, lang, words, stretches, phrase=None, n=None) -> pa.RecordBatch:
    none = [None] * len(bucket)
    columns = [bucket, lang, words or none, stretches or none, phrase or none, n or none]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _small(values: np.ndarray) -> np.ndarray:
    """The values in the smallest unsigned type that holds them."""
    top = int(values.max()) if values.size else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _pack(words: list[bytes], numbers: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    used, at = np.unique(np.append(numbers.ravel(), 0), return_inverse=True)
    at = _small(at[:-1].reshape(numbers.shape))
    columns = [pa.array(np.ascontiguousarray(at[:, k])) for k in range(at.shape[1])] + [pa.array(_small(counts))]
    batch = pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(columns))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    # No word holds a line end.
    return zstandard.compress(b"\n".join([words[i] for i in used.tolist()]), 1), sink.getvalue().to_pybytes()


def _unpack(words: bytes, stretches: bytes) -> Stretches:
    table = pa.ipc.open_stream(stretches).read_all()
    columns = [c.to_numpy().astype(np.int64) for c in table.columns]
    return Stretches(zstandard.decompress(words).split(b"\n"), np.stack(columns[:-1], axis=1), columns[-1])


def _windows(words: list[bytes]) -> Stretches:
    """What starts at every word: LONGEST words, or as many as its piece has left."""
    distinct = sorted({*words, END})
    number = {w: i for i, w in enumerate(distinct)}
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    window = np.zeros((len(at), LONGEST), np.int32)
    window[:, 0] = at
    for k in range(1, LONGEST):
        more = window[: max(len(at) - k, 0)]
        more[:, k] = np.where(more[:, k - 1] != 0, at[k:], 0)
    window = window[at != 0]
    return Stretches(distinct, window, np.ones(len(window), np.int64)).merged()


def _first_round(buckets: int):
    def run(batches):
        waiting: defaultdict[str, list[bytes]] = defaultdict(list)
        n_waiting = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                words = tokens(text.as_py())
                waiting[lang.as_py()] += words
                n_waiting += len(words)
                while n_waiting >= GROUP_WORDS:
                    most = max(waiting, key=lambda x: len(waiting[x]))
                    n_waiting -= len(waiting[most])
                    yield from _windows(waiting.pop(most)).dealt(most, ROUNDS[0][1], buckets)
        for lang, words in waiting.items():
            yield from _windows(words).dealt(lang, ROUNDS[0][1], buckets)

    return run


class _Bucket:
    """Stretches of one bucket and language as they come in."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        assert self.number[END] == 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows, self.limit = 0, HELD_ROWS

    def add(self, part: Stretches) -> None:
        numbers = np.fromiter(map(self.number.__getitem__, part.words), np.int64, len(part.words))
        self.parts.append((numbers[part.numbers].astype(np.int32), part.counts))
        self.rows += len(part.counts)
        if self.rows > self.limit:
            whole = self.whole().merged()
            self.parts, self.rows = [(whole.numbers, whole.counts)], len(whole.counts)
            self.limit = max(HELD_ROWS, 2 * self.rows)

    def whole(self) -> Stretches:
        return Stretches(list(self.number), *(np.concatenate(c) for c in zip(*self.parts)))


def _round(length: int, then: int, by: int, least: int, buckets: int):
    """Sums of the stretches of ``length`` words and their beginnings down to ``then + 1``
    words; frequent ones become rows of their own. The sums of ``then`` words are dealt again,
    or, after the last round, the number of all words of a language is left as an empty phrase."""

    def finished(bucket: int, lang: str, held: _Bucket):
        whole = held.whole()
        levels = whole.levels()
        for k in range(length, then, -1):
            sums = whole.beginnings(k, levels[k - 1])
            phrases, counts = sums.frequent(least)
            if phrases:
                yield _batch([bucket] * len(phrases), [lang] * len(phrases), None, None, phrases, counts)
        if then:
            yield from whole.beginnings(then, levels[then - 1]).dealt(lang, by, buckets)
        else:
            yield _batch([bucket], [lang], None, None, [""], [int(whole.counts.sum())])

    def run(batches):
        held, current = None, None
        for batch in batches:
            packed = batch.column(2).is_valid()
            if packed.false_count:
                yield batch.filter(pc.invert(packed))
                batch = batch.filter(packed)
            for key, words, stretches in zip(
                zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2), batch.column(3)
            ):
                if key != current:
                    if held:
                        yield from finished(*current, held)
                    held, current = _Bucket(), key
                held.add(_unpack(words.as_py(), stretches.as_py()))
        if held:
            yield from finished(*current, held)

    return run


def frequent_stretches(docs: DataFrame, least: int) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``n`` of the stretches of 1 to LONGEST words of
    ``docs(lang, text)`` that occur at least ``least`` times within pieces, and per language a
    row of 0 words with the number of all words."""
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = min(max(1, -(-size // PARTITION_BYTES)), MAX_PARTITIONS)
    buckets = partitions * BUCKETS_PER_PARTITION
    rows = map_batches(texts, _first_round(buckets), ROW)
    for i, (length, _, then) in enumerate(ROUNDS):
        by = ROUNDS[i + 1][1] if then else 0
        dealt = rows.repartition(partitions, "bucket").sortWithinPartitions("bucket", "lang")
        rows = map_batches(dealt, _round(length, then, by, least, buckets), ROW)
    # The rows of no words are parts of a language's total; the others are whole.
    sums = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return sums.select("lang", "phrase", words.alias("words"), "n")


def _spell(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def compacted(edges: DataFrame) -> DataFrame:
    """Paths of a graph: ``lang``, ``words`` and the ``weights`` of its edges, in order.

    ``edges(lang, phrase, n)`` join the nodes of their first and of their last words. Edges
    meeting in a node that no other edge touches follow each other in a path. Every edge jumps
    along its predecessors, twice as far each round, until it knows the path's first edge.
    Edges on a circle of such nodes have no first one and stay paths of their own.
    """
    words = F.split("phrase", " ")
    edges = stored(
        edges.select(
            "lang",
            "phrase",
            "n",
            _spell(words, F.lit(1), F.size(words) - 1).alias("tail"),
            _spell(words, F.lit(2), F.size(words) - 1).alias("head"),
        )
    )
    ends = edges.select("lang", F.col("head").alias("node"), F.col("phrase").alias("into"), F.lit(None).cast("string").alias("out"))
    ends = ends.unionByName(
        edges.select("lang", F.col("tail").alias("node"), F.lit(None).cast("string").alias("into"), F.col("phrase").alias("out"))
    )
    unary = ends.groupBy("lang", "node").agg(
        F.count("into").alias("ins"), F.count("out").alias("outs"), F.min("into").alias("into"), F.min("out").alias("phrase")
    )
    unary = unary.filter("ins = 1 and outs = 1").select("lang", "phrase", "into")
    start = edges.select("lang", "phrase").join(unary, ["lang", "phrase"], "left")
    state = stored(
        start.select(
            "lang",
            "phrase",
            F.coalesce("into", "phrase").alias("at"),
            F.col("into").isNotNull().cast("long").alias("steps"),
            F.col("into").isNull().alias("done"),
        )
    )
    left, before = state.filter("not done").count(), None
    while left and left != before:
        # What stands at a path's first edge is there already; only the others look further.
        there = state.select("lang", F.col("phrase").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"), "done")
        moved = state.filter("not done").drop("done").join(there, ["lang", "at"])
        moved = moved.select("lang", "phrase", F.col("to").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), "done")
        state = stored(state.filter("done").unionByName(moved))
        left, before = state.filter("not done").count(), left
    # The number of open edges falls each round until only circles are left.
    place = state.select(
        "lang",
        "phrase",
        F.when(F.col("done"), F.col("at")).otherwise(F.col("phrase")).alias("path"),
        F.when(F.col("done"), F.col("steps")).otherwise(0).alias("step"),
    )
    placed = place.join(edges.select("lang", "phrase", "n"), ["lang", "phrase"])
    # A path is no longer than the longest piece of text.
    paths = placed.groupBy("lang", "path").agg(F.sort_array(F.collect_list(F.struct("step", "phrase", "n"))).alias("e"))
    more = F.transform(F.slice("e", 2, F.greatest(F.size("e") - 1, F.lit(0))), lambda e: F.substring_index(e["phrase"], " ", -1))
    return paths.select(
        "lang", F.concat(F.split("path", " "), more).alias("words"), F.transform("e", lambda e: e["n"]).alias("weights")
    )


def collocations(
    docs: DataFrame, least: int = 30, scale: int = 2_000_000, share: int = 80, top: int | None = 2000
) -> DataFrame:
    """Phrases of 2 to LONGEST words of ``docs(lang, text)``: ``lang``, ``rank``, ``phrase``,
    ``a`` (occurrences), ``l`` and ``r`` (those of its parts at the cut that ties it least),
    ``n`` (all words of the language) and ``score``, ``floor(scale * a / (l + r))``.

    Phrases that occur ``least`` times count, unless a longer one around them has ``share``
    percent of their occurrences. ``top`` phrases of a language are returned, by score,
    occurrences and bytes; None returns all.
    """
    counts = stored(frequent_stretches(docs, least))
    edges = counts.filter(F.col("words") == LONGEST).select("lang", "phrase", "n")
    nodes = counts.filter(F.col("words") == LONGEST - 1).select("lang", "phrase", "n")
    paths = stored(compacted(edges))

    # Read off a path: its phrases of full length, and its nodes with their heaviest edge.
    full = paths.select(
        "lang",
        F.explode(
            F.transform("weights", lambda n, i: F.struct(_spell(F.col("words"), i + 1, F.lit(LONGEST)).alias("phrase"), n.alias("n")))
        ).alias("w"),
    ).select("lang", "w.*")
    weight_at = lambda i: F.coalesce(F.get("weights", i), F.lit(0))
    around = paths.select(
        "lang",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size("weights")),
                lambda i: F.struct(
                    _spell(F.col("words"), i + 1, F.lit(LONGEST - 1)).alias("phrase"),
                    F.greatest(weight_at(i - 1), weight_at(i)).alias("longer"),
                ),
            )
        ).alias("w"),
    ).select("lang", "w.*")
    found = full.withColumn("longer", F.lit(0).cast("long"))
    shorter = nodes
    for size in range(LONGEST - 1, 1, -1):
        if size < LONGEST - 1:
            words = F.split("phrase", " ")
            inner = F.array(_spell(words, F.lit(1), F.lit(size)), _spell(words, F.lit(2), F.lit(size)))
            around = shorter.select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("longer"))
            shorter = counts.filter(F.col("words") == size).select("lang", "phrase", "n")
        # A longer phrase of more than one word more occurs no more often than one in between.
        most = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        joined = shorter.join(most, ["lang", "phrase"], "left")
        found = found.unionByName(joined.select("lang", "phrase", "n", F.coalesce("longer", F.lit(0)).alias("longer")))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    found = found.filter(wide("longer") * 100 < wide("n") * share).drop("longer")

    words = F.split("phrase", " ")
    cut = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1),
        lambda k: F.struct(
            k.alias("cut"), _spell(words, F.lit(1), k).alias("first"), _spell(words, k + 1, F.size(words)).alias("rest")
        ),
    )
    cuts = stored(found.select("lang", "phrase", F.col("n").alias("a"), F.explode(cut).alias("c")).select("lang", "phrase", "a", "c.*"))
    parts = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    cuts = stored(skew_join(cuts, parts, ["lang", "first"], "inner"))
    parts = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    cuts = skew_join(cuts, parts, ["lang", "rest"], "inner")
    # The product is a decimal, which 64 bits might not hold.
    scored = cuts.withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * {scale}) div (l + r)"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    rows = weakest.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order))
    if top is not None:
        rows = rows.filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", F.col("n").alias("n"))
    rows = rows.join(totals, "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
