"""Periodic runs, shards and collocations: against plain versions, and at the edges."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import duck
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorum.llm import collocations, periodic, sharding
from quorum.llm.queries import QUERIES, SHARDS

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=12):
    """All runs by comparing the words with themselves at every distance."""
    found = {}
    n = len(words)
    array = np.array(words)
    for p in range(1, n // 2 + 1):
        equal = np.concatenate([[False], array[:-p] == array[p:], [False]]) if n else np.zeros(2, bool)
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if hi - lo + p >= max(least, 2 * p):
                found.setdefault((lo, hi + p), p)
    return sorted(((lo, end - lo, p) for (lo, end), p in found.items()), key=lambda r: (r[0], r[2]))


def numbered(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


letters = st.integers(1, 3).flatmap(lambda k: st.lists(st.integers(0, k), max_size=60))
repeated = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=13), st.integers(1, 4)), max_size=4).map(
    lambda parts: [x for unit, times in parts for x in unit * times]
)


@settings(max_examples=300, deadline=None)
@given(st.one_of(letters, repeated), st.sampled_from([2, 4, 12]))
def test_runs_of_small_alphabets(words, least):
    got = [tuple(r) for r in periodic.find_runs(numbered(words), least).tolist()]
    assert got == plain_runs(words, least)


def test_runs_where_no_progression_is_aligned():
    # The repeated half itself ends and starts in parts of another period.
    for words in ("aabaaabaa" * 2, "b" + "abababa" * 2 + "babab", "x" + "a" * 20 + "b" + "a" * 20, "ab" * 40 + "a" + "ab" * 40):
        assert [tuple(r) for r in periodic.find_runs(numbered(words), 2).tolist()] == plain_runs(list(words), 2)


def test_periodic_query_equals_the_plain_search(spark):
    texts = dict(duck(SF_SMALL).sql("SELECT doc_id, text FROM documents").fetchall())
    rows = QUERIES["op11_periodic_runs"](spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = SPACE.findall(texts[r["doc_id"]] or "")
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = plain_runs(numbered(words))
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r["n_runs"] == len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_runs_at_the_edges(spark):
    line = "eins zwei\x85drei vier "
    rows = [
        (1, None, "x"),
        (2, "", "x"),
        (3, " \t\n", None),
        (4, line * 50_000, "x"),
        (4, line * 50_000, "x"),
        (5, "a " * 11, "x"),
        (6, "a " * 12, "x"),
        (None, "漢字 \x1c " * 6, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("at", F.lit("mine"))
    got = periodic.runs(docs).collect()
    assert {r["at"] for r in got} == {"mine"} and len(got) == len(rows)
    runs = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["n_words"], r["collapsed"]) for r in got}
    assert runs[1] == runs[2] == runs[3] == ([], 0, "")
    assert runs[4] == ([(0, 150_000, 3)], 150_000, "eins zwei\x85drei vier")
    assert runs[5] == ([], 11, " ".join("a" * 11)) and runs[6] == ([(0, 12, 1)], 12, "a")
    assert runs[None] == ([(0, 12, 2)], 12, "漢字 \x1c")
    assert periodic.runs(docs.limit(0)).count() == 0


def test_slices_cut_no_word(monkeypatch):
    text = "one  two\tthree " * 40 + "end"
    whole = periodic.word_numbers(text)
    monkeypatch.setattr(periodic, "SLICE_BYTES", 7)
    parts = periodic.word_numbers(text)
    assert parts[1] == whole[1] and (parts[0] == whole[0]).all()


def test_more_shards_take_rows_only_into_themselves(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    weights = [1, 2, 0, 1.5]
    made = keys.select(
        "doc_id",
        sharding.shard_of(F.col("doc_id"), weights).alias("a"),
        sharding.shard_of(F.col("doc_id"), [*weights, 1]).alias("b"),
        sharding.shard_of(F.col("doc_id"), [1, 3, 0, 1.5]).alias("c"),
    ).collect()
    share = Counter(r["a"] for r in made)
    assert share[2] == 0 and all(abs(share[s] / 4000 - w / 4.5) < 0.03 for s, w in enumerate(weights))
    assert {r["b"] for r in made if r["b"] != r["a"]} == {4}
    # A heavier shard only gains.
    assert {r["c"] for r in made if r["c"] != r["a"]} == {1}
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), [0, 0])


def test_shards_at_the_edges(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "COPIES", 4)
    rows = [(i % 7 or None, "t") for i in range(60)] + [(99, "hot")] * 41
    docs = spark.createDataFrame(rows, "doc_id long, slot string")
    made = sharding.assign(docs, "doc_id", [1, 1, 1])
    # The key decides alone, a null key too.
    assert all(r["n"] == 1 for r in made.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).collect())
    digest = F.md5(sharding.key_text(F.col("doc_id")))
    numbered_ = sharding.slots(made.withColumn("digest", digest), "digest", 3)
    got = numbered_.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    for shard in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    sharding.write_shards(numbered_, str(tmp_path / "out"), rows_per_file=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in back.collect()) == Counter(
        (r["doc_id"], r["shard"], r["slot"]) for r in got
    )
    empty = sharding.assign(docs.limit(0), "doc_id", [1, 1]).withColumn("digest", digest)
    assert sharding.slots(empty, "digest", 2).count() == 0


def test_shards_are_even(spark):
    rows = QUERIES["op12_rendezvous_shards"](spark, SF_SMALL).collect()
    share = Counter(r["shard"] for r in rows)
    assert set(share) <= set(range(SHARDS)) and all(r["grown_shard"] in (r["shard"], SHARDS) for r in rows)


def plain_phrases(rows, least, share=80, scale=2_000_000, top=2000):
    """rows(lang, text) -> the rows of ``collocations``, by plain counting."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + m])) for m in range(1, 5) for i in range(len(words) - m + 1))
    phrases = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    covered = set()
    for (lang, w), c in phrases.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * c >= share * phrases[lang, w[i : i + m]]:
                    covered.add((lang, w[i : i + m]))
    out = []
    for (lang, w), a in phrases.items():
        if (lang, w) not in covered:
            cuts = [(scale * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    ranked, place = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return ranked


TEXTS = [
    ("en", "the cat sat on the mat. The CAT sat\ton it, the cat; sat on the mat!" * 3),
    ("en", "a a a a a a a a\nb a b a b a b a"),
    ("en", None),
    ("en", ""),
    (None, "x y z x y z x y z"),
    ("und", "x y z"),
    ("de land", "ÄÖ ÄÖ\x1cÄÖ ÄÖ. ÄÖ\x00 k ÄÖ\x00 k"),
    ("fr", "..,,\r\n  \t"),
    ("long", "one two three four five " * 3000),
    ("alone", "unique words only here"),
]


@pytest.mark.parametrize("least, top", [(2, 2000), (3, 2), (1, 2000)])
def test_phrases_equal_plain_counts(spark, monkeypatch, least, top):
    monkeypatch.setattr(collocations, "PARTITION_BYTES", 1 << 14)
    docs = spark.createDataFrame(TEXTS, "lang string, text string").repartition(3).withColumn("n", F.lit("mine"))
    got = [tuple(r) for r in collocations.collocations(docs, least, top=top).collect()]
    assert sorted(got) == plain_phrases(TEXTS, least, top=top)


def test_counts_survive_small_groups(monkeypatch):
    """Windows, buckets and rounds by themselves, with merges in between."""
    import pyarrow as pa

    for name, value in (("GROUP_WORDS", 50), ("HELD_ROWS", 8)):
        monkeypatch.setattr(collocations, name, value)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([lang or "und" for lang, _ in TEXTS]), pa.array([t for _, t in TEXTS], pa.string())], ["lang", "text"]
    )
    rows = list(collocations._first_round(5)([batch, batch]))
    for i, (length, _, then) in enumerate(collocations.ROUNDS):
        table = pa.Table.from_batches(rows).sort_by([("bucket", "ascending"), ("lang", "ascending")])
        by = collocations.ROUNDS[i + 1][1] if then else 0
        rows = list(collocations._round(length, then, by, 1, 5)(table.to_batches(max_chunksize=7)))
    got = Counter()
    for r in pa.Table.from_batches(rows).to_pylist():
        got[r["lang"], r["phrase"]] += r["n"]
    f = Counter()
    for lang, text in TEXTS * 2:
        lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            f[lang or "und", ""] += len(words)
            f.update((lang or "und", " ".join(words[i : i + m])) for m in range(1, 5) for i in range(len(words) - m + 1))
    assert got == Counter({k: v for k, v in f.items() if v})


def test_paths_follow_unary_nodes_and_stop_at_circles(spark):
    text = "a b c d e f g h"
    grams = lambda t: [" ".join(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)]
    edges = [("en", g, i + 1) for i, g in enumerate(grams(text))] + [("en", "q q q q", 9), ("en", "x c d e", 3)]
    edges += [("fr", g, 1) for g in grams("k l m k l m")]
    paths = collocations.compacted(spark.createDataFrame(edges, "lang string, phrase string, n long")).collect()
    got = {(r["lang"], " ".join(r["words"])): list(r["weights"]) for r in paths}
    # c d e has two edges in, so the path breaks there; circles stay single edges.
    assert got[("en", "a b c d e")] == [1, 2] and got[("en", "c d e f g h")] == [3, 4, 5]
    assert got[("en", "x c d e")] == [3] and got[("en", "q q q q")] == [9]
    assert sum(len(w) for w in got.values()) == len(edges)


def test_no_text_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
