"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from quorum.llm import bpe, chat, decontaminate, exact, html_text, idfiles, language, near, pii, quality
from quorum.llm.common import shared_path

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lang word " * 30_000
ROWS = [
    (1, "the cat sat on the mat, the end", "en", "s", 1),
    (1, "the cat sat on the mat, the end", "en", "s", 1),
    (2, "the cat sat on the mat, the end", None, None, None),
    (3, None, "de", "s", 0),
    (4, "", "de", "s", 0),
    (None, "der hund und die katze", "de", None, 2),
    (None, None, None, None, None),
    (5, " \t\n", "en", "s", 3),
    (6, LONG, "en", "s", 4),
    (7, "1234567 !!! 漢字", "en", "s", 5),
]
#: Columns with the names that operators make.
CLASH = ["score", "tokens", "decoded", "n_hit", "hits", "lang_pred", "rid", "node", "kept", "_row", "n_words", "predicted"]
#: Working names of the leak search.
CLASH += ["_c", "_w", "_bitmap", "_text_key", "_text_sha", "_key", "_id", "hash", "length", "at", "items", "gram", "own"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.withColumns({c: F.lit("mine") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def labels_of(spark, rows=((1, 1, 0), (6, 0, 0), (None, 1, 0), (4, None, None), (2, 0, 0), (2, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark_of(spark, rows=((1, "the cat sat on the mat"), (2, None), (None, "hund"), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x or 0))


ALL_IDS = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x or 0))


def test_quality(spark, docs, wide, empty):
    for labels in (labels_of(spark), labels_of(spark, ())):
        model = quality.fit(docs, labels, F.lit(True))
        scored = quality.score(wide, model)
        rows = scored.collect()
        assert ids(scored) == ALL_IDS and all(0 <= r["score"] <= 1 for r in rows)
        assert {r["kept"] for r in rows} == {"mine"}
        assert quality.score(empty, model).count() == 0
    assert quality.fit(empty, labels_of(spark), F.lit(True)).good == b""


def test_quality_keeps_the_prior_of_all_labels(spark):
    """Ten times as many good labels as bad ones, over and under the bound of the sample."""
    words = {1: "careful clear honest plain".split(), 0: "cheap click offer winner".split()}
    kind = [int(i % 11 > 0) for i in range(1320)]
    text = lambda i: " ".join(words[kind[i] if i % 4 else 1 - kind[i]][(i * j) % 4] for j in range(1, 30))
    docs = spark.createDataFrame([(i, text(i)) for i in range(1320)], "doc_id long, text string")
    labels = labels_of(spark, [(i, k, 0) for i, k in enumerate(kind)])
    model = [quality.fit(docs, labels, F.lit(True), rows) for rows in (3000, 120)]
    at = [1 / (1 + np.exp(-m.intercept)) for m in model]
    assert abs(at[0] - at[1]) < 0.1 and min(at) > 0.7


def test_quality_of_long_texts(spark):
    """The end of a long text counts like its beginning, and long texts are learned from."""
    import random

    rnd = random.Random(4)
    # The classes have half their words in common.
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    text = lambda k, n: " ".join(rnd.choice(words[:600] if k else words[300:]) for _ in range(n))
    kind = [i % 2 for i in range(300)]
    for rows in ([(i, text(k, 100)) for i, k in enumerate(kind)], [(i, text(k, 6500)) for i, k in enumerate(kind[:40])]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        model = quality.fit(docs, labels_of(spark, [(i, k, 0) for i, k in enumerate(kind)]), F.lit(True))
        new = [(k, text(k, n)) for k in (0, 1) for n in (100, 2000, 60_000)]
        scores = quality.score(spark.createDataFrame(new, "doc_id long, text string"), model).collect()
        assert all((r["score"] > 0.9) if r["doc_id"] else (r["score"] < 0.1) for r in scores), [r["score"] for r in scores]


def test_exact(spark, docs, wide, empty):
    rows = exact.classes(wide).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in rows if r["keep_id"] != 3)
    assert (False, 1, 1, 3, True) in got and (False, 1, 1, 3, False) in got and (False, 2, 1, 3, False) in got
    empties = [r for r in rows if r["keep_id"] == 3]
    assert len(empties) == 3 and sum(r["kept"] for r in empties) == 1
    assert {r[c] for r in exact.drop_duplicates(wide).collect() for c in CLASH} == {"mine"}
    kept = exact.drop_duplicates(docs)
    assert kept.columns == docs.columns and ids(kept) == [1, 3, 5, 6, 7, None]
    assert exact.classes(empty).count() == 0 and exact.drop_duplicates(empty).count() == 0


def test_chunks_of_long_texts_are_hashed_by_many_tasks(spark, docs):
    """One huge text lies in many partitions, and its fingerprint is that of the local fold."""
    data = "".join(chr(97 + i * i % 26) for i in range(40 * exact.CHUNK_BYTES + 5))
    huge = [(10, data), (11, data), (12, data[:-1] + "!"), (13, data.replace("a", "\t ")), (14, data.replace("a", " \n ")), (15, None)]
    df = spark.createDataFrame(huge, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    norm = exact.normalised(F.col("text")).cast("binary").alias("_norm")
    rows = df.filter("doc_id = 10").select(F.lit(0).cast("long").alias("rid"), "doc_id", F.lit("").alias("text_sha256"), norm)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # of partitions under a megabyte, as all are here
    spark.conf.set(merging, "false")
    cut = exact._long_chunks(rows, exact.PRIMES, exact.BASES)
    spark.conf.unset(merging)
    assert len(cut.inputFiles()) > 4
    powers = [exact._powers(b, p) for b, p in zip(exact.BASES, exact.PRIMES)]
    (one,) = exact._summed(cut, exact.PRIMES).collect()
    assert (one["n_bytes"], one["fp"]) == (len(data), exact.fingerprint(data.encode(), powers))
    shown = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    order = lambda frame: sorted(map(str, frame.select(*shown).collect()))
    expected = order(exact.classes(df))
    assert order(exact.classes(df, long_bytes=0)) == expected
    assert order(exact.classes(df, primes=(3, 5), bases=(2, 3), long_bytes=20)) == expected


def test_exact_with_colliding_fingerprints(spark):
    """Tiny primes: most texts of one length share a fingerprint, and are told apart all the same."""
    texts = [(i, f"text {i % 40:02d}") for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = exact.classes(df, primes=(3, 5), bases=(2, 3)).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows} == {i: (i % 40, 5) for i, _ in texts}


def test_near(spark, docs, wide, empty):
    rows = near.components(wide, 4, 85, 100).collect()
    assert ids(near.components(docs, 4, 85, 100)) == ALL_IDS
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    assert {r[c] for r in near.drop_near_duplicates(wide).collect() for c in CLASH} == {"mine"}
    kept = near.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and ids(kept) == [1, 3, 4, 5, 6, 7, None, None]
    assert near.components(empty).count() == 0 and near.drop_near_duplicates(empty).count() == 0


def test_decontaminate(spark, docs, wide, empty):
    bench = benchmark_of(spark)
    rows = decontaminate.find_leaks(wide, bench).collect()
    assert sorted((r["n_hit"], r["n_items"]) for r in rows)[-4:] == [(1, 0), (6, 1), (6, 1), (6, 1)]
    assert {r["score"] for r in rows} == {"mine"}
    assert {r[c] for r in rows for c in CLASH if c not in decontaminate.RESULT} == {"mine"}
    kept = decontaminate.drop_leaked(wide, bench)
    assert kept.columns == wide.columns and {r[c] for r in kept.collect() for c in CLASH} == {"mine"}
    cut = decontaminate.cut_leaked(wide, bench)
    assert cut.columns == wide.columns and {r[c] for r in cut.collect() for c in CLASH} == {"mine"}
    assert ids(decontaminate.drop_leaked(docs, bench)) == [3, 4, 5, 6, 7, None]
    assert decontaminate.find_leaks(empty, bench).count() == 0
    nothing = benchmark_of(spark, ())
    assert ids(decontaminate.drop_leaked(docs, nothing)) == ALL_IDS


def test_language(spark, docs, wide, empty):
    model = language.fit(docs, F.lit(True))
    rows = language.predict(wide, model).collect()
    assert len(rows) == len(ROWS)
    by = {(r["doc_id"], r["text"]): r for r in rows}
    assert by[None, "der hund und die katze"]["lang_pred"] == "de" and by[1, ROWS[0][1]]["lang_pred"] == "en"
    assert by[3, None]["lang_pred"] == by[4, ""]["lang_pred"] == by[5, " \t\n"]["lang_pred"] == "und"
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(empty, F.lit(True))).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_codec(spark, docs, wide, empty):
    rows = bpe.decode(bpe.encode(wide, PATH), PATH).collect()
    assert len(rows) == len(ROWS)
    assert all((r["tokens"] == [] and r["decoded"] == "") == (not (r["text"] or "").strip()) for r in rows)
    assert len(next(r for r in rows if r["doc_id"] == 6)["tokens"]) == 60_000
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0


def test_id_files(spark, wide, empty):
    path = shared_path(spark)
    idfiles.write_ids(wide, path, PATH, 2)
    rows = sorted(idfiles.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    none = shared_path(spark)
    idfiles.write_ids(empty, none, PATH, 2)
    assert idfiles.read_ids(spark, none).count() == 0


def test_pii(spark, wide, empty):
    assert ids(pii.find(wide)) == ALL_IDS and pii.find(empty).count() == 0
    many = "a@b.c " * 3000 + "9" * 5000 + " " + "a" * 100_000 + " " + "1.1.1.1 " * 500
    rows = pii.find(spark.createDataFrame([(1, many), (2, None)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: len(r["base"]) for r in rows} == {1: 3500, 2: 0}


def test_pii_keeps_texts_whose_matches_all_fail(spark):
    texts = ["In 2020 we met", "about 1,000 people", "room 12", "v 1.2.3.999", "call +1 23", "no number", "12345 token"]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], len(r["base"]), len(r["spans"])) for r in rows) == [(i, 0, 0) for i in range(len(texts))]


def test_pii_contexts_reach_over_earlier_matches(spark):
    texts = [
        "ID: 48213 Phone: 555-01999 or +1 555 0199 123, mail a@b.org",
        "x 12 34  56 7  89 " * 9 + "1.2.3.4 1.2.3.5\t1.2.3.6 é a@b.cc,c@d.ee 漢字 f@g.hh 11111 22222",
        "12\t34\t" * 30 + "4111 1111 1111 1111",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii._all_matches(df, "doc_id").filter("kind IS NOT NULL").collect()
    assert {r["kind"] for r in rows} == {*pii.KINDS, pii.TOKEN_KIND}
    for r in rows:
        text, start = texts[r["doc_id"]], r["start"]
        assert text[start : r["end"]] == r["found"] and r["before"] == text[max(0, start - pii.CONTEXT_CHARS) : start]


def test_pii_learns_in_records(spark):
    seeds = [(i, f"ID: 4821{i} Phone: +1 555 0199 12{i}") for i in range(8)]
    new = [(100, "ID: 48213 Phone: 555-01999")]
    rows = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(seeds + new, "doc_id long, text string")).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in rows[100]["spans"]] == [("phone", 17, 26)]


def spelled(rows):
    return {r["doc_id"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"]] for r in rows}


def test_pii_learns_contexts(spark):
    """14 of 17 instances are seeds, enough to trust the context; 8 of 11 are not."""
    where = ((14, "reach me by mail: {} thanks"), (8, "he wrote to: {} once"))
    seeds = [(1000 * k + i, f.format(f"user{i}@mail.example.org")) for k, (n, f) in enumerate(where) for i in range(n)]
    new = [(1000 * k + 100 + i, f.format(f"user{i}-at-home{k}")) for k, (_, f) in enumerate(where) for i in range(3)]
    other = [(2000 + i, f"the model number: x{i}00-{i} is out") for i in range(9)]
    rows = pii.find(spark.createDataFrame(seeds + new + other, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows if r["base"]} == {d for d, _ in seeds}
    found = spelled(rows)
    assert all(found[d] == ([f"email:18:{len(text) - 7}"] if d < 1000 else []) for d, text in new)
    assert all(not found[d] for d, _ in other)
    assert found == brute.all_spans(dict(seeds + new + other))


def test_pii_bootstraps_in_turns(spark):
    """Secrets of the seeds' shape induce a context, its other secrets the next one; a context that
    holds as many other things induces none, nor does a hexadecimal number that is not assigned."""
    digits = [f"{i:04x}" * 2 + "0123456789abcdef0123456789abcdef" for i in range(50)]
    texts = [f'set token = "{d}" here' for d in digits]
    hops = [*(f"key-{i}-hop" for i in range(5)), *(f"AKIA{i}XY" for i in range(5))]
    hop = [f"set token = {t}" for t in hops]
    hop += [f"signed in as {t}" for t in (*hops, "qq-77-zz")]
    hop += ["renewed after expiry qq-77-zz"]
    mixed = [f"the checksum is {d[::-1]}" for d in digits] + [f"build of {i}.{i}.{i}.{i} and build of host-{i}-{i}" for i in range(9)]
    docs = dict(enumerate(texts + hop + mixed + ["", None]))
    rows = pii.find(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    found = spelled(rows)
    assert found == brute.all_spans(docs)
    by_text = {docs[d]: [s.split(":")[0] for s in spans] for d, spans in found.items() if docs[d]}
    assert by_text[texts[0]] == by_text["set token = key-0-hop"] == by_text["signed in as AKIA0XY"] == ["secret"]
    assert by_text["signed in as qq-77-zz"] == ["secret"]
    assert by_text["renewed after expiry qq-77-zz"] == by_text[mixed[0]] == []
    assert by_text[mixed[-1]] == ["ip"]


def test_html(spark):
    df = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "x"), (2, None, None), (3, "", "y")], "page_id long, html string, text string")
    out = html_text.extract(df)
    assert sorted((r["page_id"], r["text"]) for r in out.collect()) == [(1, "a"), (1, "a"), (2, ""), (3, "")]
    assert out.columns == ["page_id", "text"]
    assert html_text.extract(df.limit(0)).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", r"a \l < </turn> \\"),
        (1, 1, "assistant", None),
        (1, 1, "assistant", "<turn>x<says>"),
        (1, None, None, "first"),
        (2, 0, "system", "only"),
        (None, 0, "assistant", "no id"),
        (None, 0, "assistant", "no id"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("target", F.lit("mine"))
    made = chat.examples(df).select(
        "*", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss")
    )
    got = sorted(((r["conv_id"] or 0, r["target"], [tuple(t) for t in r["turns"]], r["loss"]) for r in made.collect()), key=lambda x: x[:2])
    user = ("user", r"a \l < </turn> \\")
    assert got == [
        (0, 1, [("assistant", "no id")], "no id"),
        (0, 2, [("assistant", "no id")] * 2, "no id"),
        (1, 3, [("", "first"), user, ("assistant", "")], ""),
        (1, 4, [("", "first"), user, ("assistant", ""), ("assistant", "<turn>x<says>")], "<turn>x<says>"),
        (2, 1, [("system", "only")], None),
    ]
    assert chat.examples(df.limit(0)).count() == 0


@pytest.mark.parametrize("which", ["rows", "empty"])
def test_pipeline_stages(spark, docs, empty, which, monkeypatch):
    """Every stage over odd rows and over none; labels and benchmark are as odd."""
    tables = {"labels": labels_of(spark), "benchmark": benchmark_of(spark)}
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: tables[name])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs if which == "rows" else empty, "")
        assert set(docs.columns) <= set(out.columns)
        assert (out.count() == 0) == (which == "empty")
