"""The pieces of the operators that need no Spark, and the shared joins."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quorum.llm import bpe, common, exact, html_text, idfiles, language, near, quality

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def tables():
    return bpe.BpeTables(PATH)


ODD_TEXTS = [
    "",
    "   ",
    "don't we'll 's 'S ''s",
    "x<|endoftext|>y <|startoftext|><|startoftext|>",
    "ΑΣ ΣΑΣ İI ẞ é̀ ́a",
    "a\x1cb\x85c\xa0d e　f",
    "Жизнь 漢字かな 123４５ ½²",
    "a" * 3000,
    "ab" * 500 + "!" * 500,
]


def test_backtracking_gives_the_merges_of_the_library(library, tables):
    rnd = random.Random(3)
    texts = ODD_TEXTS + ["".join(rnd.choice("aeinorstthing' x-!?É") for _ in range(rnd.randint(1, 80))) for _ in range(800)]
    ids_of = bpe.PieceCache(tables.encode_piece)
    of_library = bpe.PieceCache(idfiles.LibraryEncoder(PATH))
    offsets = bpe.OffsetTable(PATH)
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        ours = np.frombuffer(ids_of(text), "<u4")
        assert ours.tolist() == expected
        assert np.frombuffer(of_library(text), "<u4").tolist() == expected
        assert offsets.spell(ours) == library.decode(expected, skip_special_tokens=False)


def test_every_token_is_reachable_only_if_its_text_merges_to_it(library, tables):
    spelled = {i: t for t, i in library.get_vocab().items()}
    for i in random.Random(5).sample(range(512, 49406), 300):
        if spelled[i].endswith("</w>") and spelled[i][:-4].isascii() and spelled[i][:-4].isalpha():
            expected = library.encode(spelled[i][:-4], add_special_tokens=False).ids == [i]
            assert tables.reachable(i) == expected


def test_caches_stay_bounded():
    made = []
    cache = bpe.Remembered(lambda k: made.append(k) or len(k), half=10)
    for i in range(1000):
        cache.turn()
        assert cache[str(i)] == len(str(i))
    assert len(cache) + len(cache.old) <= 20
    assert cache["999"] == 3 and len(made) == 1000
    assert cache["x" * 1000] == 1000 and "x" * 1000 not in cache


@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.sampled_from([idfiles.BYTE_PLANES, idfiles.BIT_PLANES]))
@settings(max_examples=30, deadline=None)
def test_shards_come_back_exactly(ids, kind):
    cut = len(ids) // 3
    lengths = [cut, 0, len(ids) - cut]
    data = idfiles.write_shard([None, -5, 7], lengths, np.array(ids, "<u4"), kind)
    docs, got_lengths, got = idfiles.read_shard(data)
    assert docs == [None, -5, 7] and list(got_lengths) == lengths and got.tolist() == ids


def test_shards_of_several_blocks():
    ids = np.arange(3 * idfiles.BLOCK_IDS + 5, dtype="<u4") * 7919
    docs, lengths, got = idfiles.read_shard(idfiles.write_shard([1], [len(ids)], ids))
    assert (got == ids).all()


@given(st.binary(max_size=200), st.binary(max_size=200))
@settings(max_examples=50, deadline=None)
def test_fingerprints_combine(a, b):
    powers = [exact._powers(base, p) for base, p in zip(exact.BASES, exact.PRIMES)]

    def residues(data):
        fp = exact.fingerprint(data, powers)
        return fp >> 31, fp & (1 << 31) - 1

    for whole, x, y, base, prime in zip(residues(a + b), residues(a), residues(b), exact.BASES, exact.PRIMES):
        assert whole == exact.combine(x, y, len(b), base, prime)


def test_long_texts_are_hashed_by_chunks():
    data = bytes(random.Random(1).randrange(256) for _ in range(3 * exact.CHUNK_BYTES + 77))
    powers = [exact._powers(base, p) for base, p in zip(exact.BASES, exact.PRIMES)]
    value = 0
    for byte in data:
        value = (value * exact.BASES[0] + byte) % exact.PRIMES[0]
    assert exact.fingerprint(data, powers) >> 31 == value


@given(st.integers(1, 400), st.floats(0, 1), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_linked_sets_share_a_block_key(n, share, seed):
    rnd = np.random.default_rng(seed)
    grams = np.unique(rnd.integers(0, 2**64, n, np.uint64))
    for num, den in ((80, 100), (85, 100)):
        jaccard = near.Jaccard(4, num, den)
        most = jaccard.differ(2 * len(grams))
        gone = rnd.integers(0, most + 1) if share < 0.5 else most
        other = np.unique(np.concatenate([grams[: len(grams) - gone // 2], rnd.integers(0, 2**64, gone - gone // 2, np.uint64)]))
        if not len(other) or not jaccard.linked(grams, other) or near.set_hash(grams) == near.set_hash(other):
            continue
        for share in (0.0, 0.3, 0.95, 1.0):  # of the shingles are frequent ones
            frequent = np.sort(rnd.choice(np.union1d(grams, other), int(share * len(grams)), replace=False))
            a, b = near.block_keys(grams, jaccard, frequent), near.block_keys(other, jaccard, frequent)
            assert np.intersect1d(a, b).size
        x, y = near.sketch(grams), near.sketch(other)
        while len(x) != len(y):  # the longer one is folded
            x, y = sorted((x, y), key=len)
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        distance = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y)
        assert distance <= len(np.setxor1d(grams, other))


def test_sets_sharing_a_common_line_do_not_share_a_key():
    # Each set is one common line's frequent shingles and ten of its own: no two link, and
    # blocks that hold only the common shingles must not be keys that all of them share.
    rnd = np.random.default_rng(5)
    common = np.unique(rnd.integers(0, 2**64, 40, np.uint64))
    jaccard = near.Jaccard(4, 85, 100)
    counts = {}
    for _ in range(200):
        grams = np.unique(np.concatenate([common, rnd.integers(0, 2**64, 10, np.uint64)]))
        for key in set(near.block_keys(grams, jaccard, common).tolist()):
            counts[key] = counts.get(key, 0) + 1
    assert max(counts.values()) <= 2


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        (None, ""),
        ("just text", "just text"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n  - c\n\nd"),
        ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
        ("<table><tr><th>N<th>Q<tr><td>pear<td>3</table>", "N     Q\npear  3"),
        ("<table><tr><td rowspan=2>x<td>1<tr><td>2</table>", "x  1\n   2"),
        ("<table><tr><td colspan=2>wide one<td>z<tr><td>a<td>b<td>c</table>", "wide one  z\na  b  c"),
        ("<table>stray<tr><td>a</table>", "stray\na"),
        ("<td>lost", "lost"),
        ("a<script>if (a<b) '</p>'</script>b<!-- c -->d", "abd"),
        ("<div hidden>a</div><p style='Display: none'>b</p>c", "c"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"),
        ("<details>a<summary>s</summary>b</details><dialog>c</dialog>", "s"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("<blockquote>a<p>b</blockquote><dl><dt>t<dd>d</dl>", "    a\n\n    b\n\nt\n    d"),
        ("1 < 2 &lt; 3 &amp; <b>x</b> </b></i>y", "1 < 2 < 3 & x y"),
        ("a<p title='it>'s'>b", "a\n\nb"),
        ("a<img alt=\"never ends", "a"),
        ("<head><title>t</title>x<p>y", "x\n\ny"),
    ],
)
def test_pages_are_laid_out(page, text):
    assert html_text.render(page) == text


def test_deep_and_wide_pages_stay_linear():
    assert html_text.render("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert html_text.render("<table>" * 2000 + "x").strip() == "x"
    row = "<tr><td>" + "w" * 5000 + "<td>b</tr>"
    assert len(html_text.render("<table>" + row * 300 + "</table>")) < 2 * 300 * 5010
    assert html_text.render("<b>" * 50_000 + "</i>" * 50_000) == ""
    assert html_text.render("<a " + "x='" * 10_000) == ""


@pytest.mark.parametrize("shell", ["<font>", "<div>", "<span><b>", "<ul><li>", "<blockquote>", "<table><tr><td>", "<dl><dd>"])
def test_rules_hold_at_any_depth(shell):
    page = "x<script>var a = 1;</script><style>b {}</style><p hidden>c</p><i style='display:none'>d</i><video>e</video>one<br>two<div>three</div>"
    page += "<ol start=4><li>four<li></li><li>five<ul><li><li>deep</ul></ol><table><tr><td>p<td>q<tr><td>r</table><pre>s\n t</pre></i>end"
    for n in (600, 3000):
        lines = [x.strip() for x in html_text.render(shell * n + page).split("\n")]
        assert lines[0].lstrip("- ") == "xone"
        lines = [x for x in lines[1:] if x]
        assert lines == ["two", "three", "4. four", "6. five", "- deep", "p  q", "r", "s", "t", "end"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><mtext> if </mtext></math>b", "a x=2 if b"),
        ("<math><semantics><mi>x</mi><annotation encoding=tex>\\x</annotation></semantics></math>y", "xy"),
        ("<svg><title>t</title><desc>d</desc><text>one</text><text>two</text></svg> c", "one two c"),
        ("<svg><defs/><path d='M0'/><style/><title/><text x=1>one</text></svg>c", "onec"),
        ("<svg><defs><text>no</text></defs><metadata>m</metadata><g display=none><text>no</text></g></svg>c", "c"),
        ("<svg><text visibility='hidden'>no</text><text><![CDATA[a > b]]></text><style>s {}</style></svg>", "a > b"),
        ("<svg><foreignObject><div>in</div><p>it</foreignObject><text>l</text></svg>", "in\n\nit\n\nl"),
        ("<svg><defs><p>out", "out"),
        ("<p>a <svg><desc><div>no</div></desc></svg>b", "a b"),
        ("<desc>plain</desc><metadata>too</metadata>", "plaintoo"),
    ],
)
def test_labels_and_formulas_are_text(page, text):
    assert html_text.render(page) == text


def test_deep_pages_take_linear_time():
    import time

    start = time.process_time()
    page = "<p><td>" + "<b>" * 30_000 + "<div>x</b>" * 30_000
    assert html_text.render(page).count("x") == 30_000
    assert html_text.render("<ul><li>a" * 20_000).count("a") == 20_000
    assert html_text.render("<table><tr><td>a<td>b" * 5_000).count("b") == 5_000
    assert time.process_time() - start < 60


def test_language_scorer_backs_off():
    import numpy as np

    model = language.LanguageModel(
        ("aa", "bb"),
        {"word": np.log([0.9, 0.1])},
        {4: {}, 3: {"zzz": np.log([0.1, 0.9])}, 2: {}, 1: {}},
        {k: np.log([0.01, 0.01]) for k in range(5)},
    )
    scorer = language.Scorer(model)
    assert scorer("Word word")[0] == "aa"
    assert scorer("azzzb")[0] == "bb"
    assert scorer(None) == scorer("12 !") == ("und", 0.0)
    assert scorer("qqq") == ("aa", 0.5)


def test_scores_are_calibrated_on_the_size_difference():
    x = np.concatenate([np.full(100, 0.05), np.full(100, -0.05)])
    slope, intercept = quality._calibrate(x, (x > 0).astype(float))
    assert 1 / (1 + np.exp(-(slope * 0.05 + intercept))) > 0.9 > 0.1 > 1 / (1 + np.exp(-(slope * -0.05 + intercept)))


def test_skew_join_is_a_join(spark):
    left = spark.range(20_000).select(F.when(F.col("id") < 9000, 7).when(F.col("id") > 15_000, F.col("id") % 900).alias("k"), "id")
    right = spark.range(600).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    left = left.withColumn("k", F.col("k").cast("int"))
    for how in ("inner", "left"):
        ours = common.skew_join(left, right, "k", how).select("k", "id", "v")
        plain = left.join(right, "k", how).select("k", "id", "v")
        assert sorted(map(tuple, ours.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_bitmap_has_no_false_negatives(spark):
    values = spark.range(5000).select(F.xxhash64("id").alias("v"))
    bitmap = common.bitmap_of(values, "v")
    inside = np.array([r[0] for r in values.collect()], np.int64)
    assert bitmap.has(inside).all()
    outside = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    assert bitmap.has(outside).mean() < 0.3


def test_components_of_chains_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    names: dict[int, set[int]] = {}
    for node, component in got:
        names.setdefault(component, set()).add(node)
    assert sorted(map(len, names.values())) == [2, 201, 300]
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stored_tables_can_be_released(spark):
    mark = common.stored_mark()
    df = common.stored(spark.range(5))
    assert df.count() == 5
    common.release(spark, common.stored_since(mark))
    assert common.stored_mark() == mark
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_ascii_words_are_the_tokenizers_words():
    """The plain module's pattern cuts ASCII text as the tokenizer's own does."""
    random = np.random.default_rng(5)
    for n in (1, 3, 40, 2000):
        for _ in range(300):
            text = bytes(random.integers(0, 128, n, np.uint8)).decode().lower()
            assert bpe.ASCII_WORDS(text) == bpe.WORD.findall(text)
    for text in ("it's we'll o'd 's't a'lll 12ab3", "\x00\x1c\x1f\x7f a\x0bb"):
        assert bpe.ASCII_WORDS(text) == bpe.WORD.findall(text)
