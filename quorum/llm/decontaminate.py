"""Benchmark decontamination with DataFrame functions alone.

The n-gram windows of the benchmark form a hash set. Every document's token windows are hashed
inside its own row; a bitmap of the set, held by the plan as one small value, lets through the
windows that may be in it, which are then looked up in the set and verified word by word.
Nothing but those candidates leaves the row, so the scan has no shuffle in proportion to the
text.

The set is broadcast while it has at most BROADCAST_WINDOWS windows and BROADCAST_BYTES of words
and item ids; a larger one is joined by shuffling the candidates.

* null text has no words; a text or item without words is never hit.
* items with fewer words than a window are one window of their own length.
* repeated rows (documents or items) are treated one by one; null item ids are not reported.
* extra columns stay, whatever their names: they travel as one struct. The result columns replace
  columns of the same name. Empty tables: an
  empty benchmark hits nothing, empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import lower_ascii, unused_names

WINDOW = 10
#: Fixed value: the characters of a word, after A-Z are in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS = 500_000
BROADCAST_BYTES = 256 << 20
#: The bitmap has at least 32 bits for each window, up to this many in all (1 MB).
MAX_BITMAP_BITS = 23
RESULT = ["n_words", "n_hit", "n_items", "item_ids", "hits"]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``hash``, ``length``, ``gram`` (the words), ``items`` of every distinct window."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = items.select("item_id", "w", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("at"))
    grams = starts.select("item_id", "length", F.slice("w", F.col("at"), F.col("length")).alias("gram"))
    return grams.groupBy(F.xxhash64("gram").alias("hash"), "length", "gram").agg(
        F.collect_set("item_id").alias("items")
    )


def _bitmap(windows: DataFrame, bits: int) -> Column:
    """A scalar subquery: bit ``hash mod 2**bits`` is set for every window's hash."""
    at = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    word = windows.select(F.shiftright(at, 6).cast("int").alias("w"), at.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    word = word.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("v"))
    # Dense, so that a look-up is one array access.
    spark = windows.sparkSession
    all_words = spark.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("w"))
    dense = all_words.join(word, "w", "left").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0)).alias("v")))), lambda s: s["v"]).alias("bits")
    )
    return dense.scalar()


def _may_hold(bitmap: Column, h: Column, bits: int) -> Column:
    at = h.bitwiseAND(F.lit((1 << bits) - 1))
    word = F.get(bitmap, F.shiftright(at, 6).cast("int"))
    return F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1


def _covered(hits: Column) -> Column:
    """Words covered by sorted (start, end) spans, each counted once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda acc, h: F.struct(
        (acc["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(h["start"], acc["to"]))).cast("long").alias("n"),
        F.greatest(acc["to"], h["end"]).alias("to"),
    )
    return F.aggregate(hits, start, step, lambda acc: acc["n"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (but for ``text``) with ``n_words``, ``n_hit`` (words inside any benchmark window), ``n_items``,
    ``item_ids`` (sorted as strings) and ``hits`` (sorted spans of word numbers, end exclusive).

    ``text`` is not returned. The other columns go through one shuffle with the hits; pass
    only those needed.
    """
    kept = [c for c in docs.columns if c not in (*RESULT, "text")]
    windows = windows_of(benchmark, window)
    size = F.octet_length(F.to_json(F.struct("gram", "items")))
    found = windows.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.collect_set("length").alias("lengths")
    ).first()
    lengths = sorted(found["lengths"])  # at most ``window`` numbers
    bits = min(MAX_BITMAP_BITS, max(12, (32 * found["n"]).bit_length()))
    rows = docs.select(
        F.struct(*[docs[c] for c in kept]).alias("own"), words_of(docs["text"]).alias("_w"), F.monotonically_increasing_id().alias("_row")
    )
    rows = rows.withColumn("_bitmap", _bitmap(windows, bits))

    def candidates(n: int) -> Column:
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - n + 1))
        hashed = F.transform(
            F.coalesce(starts, F.array().cast("array<int>")),
            lambda i: F.struct(i.alias("at"), F.lit(n).alias("length"), F.xxhash64(F.slice("_w", i, n)).alias("hash")),
        )
        # Cut out here, so that the words need not follow every candidate through the join.
        return F.transform(
            F.filter(hashed, lambda c: _may_hold(F.col("_bitmap"), c["hash"], bits)),
            lambda c: F.struct(c["at"].alias("at"), c["length"].alias("length"), c["hash"].alias("hash"), F.slice("_w", c["at"], n).alias("gram")),
        )

    found_here = F.concat(*[candidates(n) for n in lengths]) if lengths else F.array().cast(
        "array<struct<at:int,length:int,hash:bigint,gram:array<string>>>"
    )
    rows = rows.select("_row", "own", F.size("_w").cast("long").alias("n_words"), found_here.alias("_c"))
    rows = rows.select("_row", "own", "n_words", F.explode_outer("_c").alias("_c"))
    rows = rows.select("_row", "own", "n_words", "_c.*")
    if found["n"] <= BROADCAST_WINDOWS and found["bytes"] <= BROADCAST_BYTES:
        windows = F.broadcast(windows)
    # The word arrays themselves are compared: equal hashes alone are no hit.
    matched = rows.join(windows, ["hash", "length", "gram"], "left")
    hit = F.when(F.col("items").isNotNull(), F.struct((F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.col("length")).alias("end")))
    per_row = matched.groupBy("_row").agg(
        F.first("own").alias("own"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set(hit)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))).cast("array<string>")).alias("item_ids"),
    )
    return per_row.select(
        *[F.col("own")[c].alias(c) for c in kept],
        "n_words",
        _covered(F.col("hits")).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        "item_ids",
        "hits",
    )


def _leaked(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame, list[Column]]:
    """``docs`` with a hash of the text, the documents with hits by id and that hash, once each,
    and the condition that joins them. Texts stay out of the search: they are not shuffled with it."""
    key, at, same, hits = unused_names(docs, "_text_key", "_id", "_key", "_hits")
    marked = docs.withColumn(key, F.xxhash64("text"))
    found = find_leaks(marked.select("doc_id", key, "text"), benchmark, window).filter("n_hit > 0")
    found = found.select(F.col("doc_id").alias(at), F.col(key).alias(same), F.col("hits").alias(hits))
    found = found.dropDuplicates([at, same])
    on = [marked[key] == found[same], marked["doc_id"].eqNullSafe(found[at])]
    return marked, found, on


def drop_leaked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; columns as they were."""
    marked, found, on = _leaked(docs, benchmark, window)
    return marked.join(found, on, "left_anti").select(*docs.columns)


def cut_leaked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the words inside benchmark windows cut out of ``text``; what stands between
    words stays. Untouched texts are returned as they were."""
    marked, found, on = _leaked(docs, benchmark, window)
    joined = marked.join(found, on, "left")
    hits = found.columns[-1]
    # The same words in their own case: only A-Z differ, so the pattern takes them as well.
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = F.regexp_extract_all("text", F.lit(word), F.lit(0))
    gaps = F.split("text", word, -1)
    number = F.sequence(F.lit(0), F.size(words) - 1)
    kept_words = F.zip_with(
        words, number, lambda w, i: F.when(F.exists(hits, lambda h: (h["start"] <= i) & (i < h["end"])), "").otherwise(w)
    )
    tail = F.zip_with(kept_words, F.slice(gaps, 2, F.size(words)), lambda w, g: F.concat(w, g))
    cut = F.when(F.col(hits).isNotNull(), F.concat(gaps[0], F.array_join(tail, ""))).otherwise(F.col("text"))
    return joined.withColumn("text", cut).select(*docs.columns)
