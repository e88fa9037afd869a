"""Every query of the folder against SQL or a plain version, at the smallest scale."""

import hashlib
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from compare import TYPES, difference, duck
from conftest import SF, SF_SMALL
from tokenizers import Tokenizer

import corpus_pipeline
from quorum.llm import decontaminate, near
from quorum.llm.queries import ORACLE, QUALITY_THRESHOLD, QUERIES

TYPES["BOOLEAN"] = "boolean"


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_SMALL), con, ORACLE[name]) is None


def test_pages_keep_all_visible_characters(spark, con):
    import re

    pages = dict(con.sql("SELECT page_id, html FROM pages").fetchall())
    rows = QUERIES["op1_html_text"](spark, SF_SMALL).collect()
    assert {r["page_id"] for r in rows} == set(pages)
    for r in rows:
        plain = brute.VisibleText()
        plain.feed(pages[r["page_id"]])
        plain.close()
        bare = lambda t: re.sub(r"[\s\xa0-]+|\d+\.", "", t)  # noqa: E731  marks of lists are ours
        assert bare(r["text"]) == bare("".join(plain.parts))


def test_languages_of_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op4_language_id"](spark, SF).collect()}
    truth = duck(SF).sql("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall()
    held = [(rows[d], lang) for d, lang in truth if rows[d]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    assert sum(r["lang_pred"] == lang for r, lang in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_id_files_equal_the_library(spark, texts, library):
    rows = {r["doc_id"]: r for r in QUERIES["op5_token_id_files"](spark, SF_SMALL).collect()}
    start = 0
    for doc_id in sorted(texts):
        ids = [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(rows[doc_id]) == (doc_id, start, len(ids), crc)
        start += len(ids)


def test_base_spans_equal_the_plain_patterns(spark):
    texts = dict(duck(SF).sql("SELECT doc_id, text FROM documents").fetchall())
    for r in QUERIES["op6_bootstrapped_pii"](spark, SF).collect():
        expected = brute.base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(",".join(expected))
        assert [r[f"n_{k}"] for k in brute.KINDS] == [sum(s.startswith(k + ":") for s in expected) for k in brute.KINDS]
        assert set(expected) <= set(r["spans"].split(",")) or not expected


def test_secrets_are_learned(spark):
    """Every assigned secret of the table is found through its context, and nothing else is learned."""
    texts = dict(duck(SF).sql("SELECT doc_id, text FROM documents").fetchall())
    rows = {r["doc_id"]: [s for s in r["spans"].split(",") if s] for r in QUERIES["op6_bootstrapped_pii"](spark, SF).collect()}
    assert rows == brute.all_spans(texts)
    learned = {(d, s) for d, spans in rows.items() for s in spans if s.startswith("secret:")}
    planted = {
        (d, f"secret:{m.start(1)}:{m.end(1)}") for d, t in texts.items() for m in re.finditer(r'\btoken = "(\w+)"', t or "", re.I)
    }
    assert planted and learned == planted


def test_quality_of_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op7_quality_classifier"](spark, SF).collect()}
    labels = duck(SF).sql("SELECT doc_id, quality FROM labels").fetchall()
    held = [(rows[d], q) for d, q in labels if rows[d]["held_out"]]
    assert sum(r["predicted"] == q for r, q in held) / len(held) > 0.9
    assert all(r["predicted"] == (r["score"] >= QUALITY_THRESHOLD) for r in rows.values())


def test_quality_scores_equal_the_plain_ones(spark, texts, con):
    """The same scores from dictionaries of whole texts, built and applied one text at a time."""
    labels = con.sql("SELECT doc_id, quality FROM labels").fetchall()
    learned = [(d, q) for d, q in labels if zlib.crc32(str(d).encode()) % 5]
    expected = brute.quality_scores(texts, learned)
    rows = {r["doc_id"]: r["score"] for r in QUERIES["op7_quality_classifier"](spark, SF_SMALL).collect()}
    assert rows.keys() == expected.keys()
    assert all(abs(rows[d] - s) < 1e-6 for d, s in expected.items())


def test_languages_equal_the_plain_ones(spark, texts, con):
    """Counting and backing off word by word, without caps or caches."""
    langs = con.sql("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall()
    learned = [(texts[d], lang) for d, lang in langs if zlib.crc32(str(d).encode()) % 4 != 2]
    for r in QUERIES["op4_language_id"](spark, SF_SMALL).collect():
        lang, score = brute.language(texts[r["doc_id"]], learned)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-6


def test_codec_equals_the_library(spark, texts, library):
    for r in QUERIES["op8_bpe_codec"](spark, SF_SMALL).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == brute.sha(library.decode(ids, skip_special_tokens=False))


def test_near_duplicates_equal_all_pairs(spark, texts):
    expected = brute.near_components(texts.items(), 4, 85, 100)
    rows = QUERIES["op9_parity_sketch_join"](spark, SF_SMALL).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == expected


def test_pipeline_stages_against_plain_versions(spark, con):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    benchmark = con.sql("SELECT item_id, text FROM benchmark").fetchall()
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    _, quality, exact_, near_, leaks, last = [None, *(f for _, f in corpus_pipeline.STAGES)]

    good = quality(spark, docs, SF_SMALL)
    assert good.columns == docs.columns
    scored = QUERIES["op7_quality_classifier"](spark, SF_SMALL).count()
    before = rows(docs)
    kept = rows(good)
    assert scored == len(before) > len(kept) > 0.6 * len(before)

    first: dict[str, int] = {}
    for d in sorted(before):
        first.setdefault(brute.SPACES.sub(" ", before[d] or ""), d)
    assert set(rows(exact_(spark, docs, SF_SMALL))) == set(first.values())

    groups = brute.near_components(before.items(), 5, 80, 100)
    assert set(rows(near_(spark, docs, SF_SMALL))) == {c for _, c in groups.values()}

    clean = {d for d, t in before.items() if not brute.leaks(t, benchmark)[1]}
    out = leaks(spark, docs, SF_SMALL)
    assert out.columns == docs.columns and rows(out) == {d: before[d] for d in clean}

    ids = last(spark, docs, SF_SMALL)
    assert ids.count() == len(before) and {"tokens", "decoded", "n_tokens"} <= set(ids.columns)


def test_pipeline_run_is_the_stages_in_turn(spark, con):
    out = corpus_pipeline.run(spark, SF_SMALL).select("doc_id", "text", "n_tokens").collect()
    texts = {r["doc_id"]: r["text"] for r in out}
    assert len(texts) == len(out) > 0
    benchmark = con.sql("SELECT item_id, text FROM benchmark").fetchall()
    assert not any(brute.leaks(t, benchmark)[1] for t in texts.values())
    groups = brute.near_components(texts.items(), 5, 80, 100)
    assert all(d == c for d, (_, c) in groups.items())


@pytest.mark.parametrize("window", [3, 10])
def test_cut_texts_lose_the_hit_words_alone(spark, window):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Lone pair"), (None, "null id item here"), (3, None)]
    docs = [
        (1, "Before, ONE two; three four five six seven eight nine ten! after"),
        (2, "a lone PAIR. b"),
        (3, None),
        (4, "clean text"),
        (4, "clean text"),
    ]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["doc_id"], r["n_hit"], tuple(r["item_ids"])) for r in decontaminate.find_leaks(d, b, window).collect()}
    assert found == {(d_, h, tuple(i)) for d_, t in docs for _, h, i in [brute.leaks(t, [x for x in items if x[0]], window)]}
    cut = {(r["doc_id"], r["text"]) for r in decontaminate.cut_leaked(d, b, window).collect()}
    assert cut == {(1, "Before,  ;        ! after"), (2, "a  . b"), (3, None), (4, "clean text")}
    assert decontaminate.drop_leaked(d, b, window).count() == 3


def test_larger_benchmarks_are_joined_by_shuffling(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "MAX_BITMAP_BITS", 12)
    con = duck(SF_SMALL)
    assert difference(QUERIES["op2_decontaminate"](spark, SF_SMALL), con, ORACLE["op2_decontaminate"]) is None


def test_families_with_and_without_links(spark):
    """Chains whose ends don't link, and many texts that share much but never enough."""
    import random

    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(40):  # each differs from the next by a little
        base[i * 3 % 120] = word()
        rows.append((100 + i, " ".join(base)))
    common = [word() for _ in range(60)]
    rows += [(300 + i, " ".join(common + [word() for _ in range(25)])) for i in range(40)]
    rows += [(500 + i, rows[0][1].upper()) for i in range(5)] + [(600, None), (601, ""), (602, " \t"), (603, "two words"), (604, "Two  WORDS")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.components(df, 4, 85, 100).collect()}
    assert got == brute.near_components(rows, 4, 85, 100)


def test_few_leaders_a_round_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(near, "LEADERS", 1)
    texts = duck(SF_SMALL).sql("SELECT doc_id, text FROM documents").fetchall()
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = near.components(df, 5, 60, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.near_components(texts, 5, 60, 100)
