"""What the n-gram Jaccard join writes down, and what it counts."""

from collections import defaultdict

import numpy as np
import pyarrow as pa

from quorum.llm import common, near


def words(rnd, n: int) -> str:
    return " ".join(f"w{x}" for x in rnd.integers(0, 1 << 40, n))


def test_frequent_shingles_are_counted_over_all_texts(spark):
    # Every partition holds one text with the line, so that no batch has it twice.
    rnd, jaccard = np.random.default_rng(3), near.Jaccard(5, 80, 100)
    line, own = words(rnd, 12), [words(rnd, 40) for _ in range(16)]
    docs = spark.createDataFrame([(i, f"{line} {o}") for i, o in enumerate(own)], "doc_id long, text string").repartition(16)
    frequent = near.frequent_shingles(docs, jaccard)
    assert near._is_frequent(near.shingles([line], 5)[0], frequent).all()
    rare = np.concatenate(near.shingles(own, 5))
    assert near._is_frequent(rare, frequent).mean() < 0.05


def test_a_set_gives_no_more_blocks_than_it_needs():
    rnd, jaccard = np.random.default_rng(4), near.Jaccard(5, 80, 100)
    for n in (20, 100, 400, 3000):
        grams = np.sort(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        most = sum(jaccard.differ(n + min(jaccard.top(b), n * 100 // 80)) + 1 for b in jaccard.bands(n))
        assert len(near.block_keys(grams, jaccard)) <= most * near._seeds(jaccard.top(jaccard.bands(n)[0])), n
        if n >= 100:
            assert len(near.block_keys(grams, jaccard)) <= most, n


def test_shared_keys_are_exactly_those_of_several_rows(monkeypatch):
    monkeypatch.setattr(near, "KEYS_DEALT", 500)
    rnd, parts = np.random.default_rng(5), 7
    dealt, rows = defaultdict(list), defaultdict(set)
    for task in range(3):
        batches = []
        for b in range(4):
            rids = (task << 33) + b * 40_000 + np.arange(30)  # lists of several bases
            sets = [np.unique(rnd.integers(0, 1 << 40, 25).astype(np.uint64) >> np.uint64(27 * (i % 3 == 0))) for i in range(30)]
            for rid, keys in zip(rids.tolist(), sets):
                for key in keys.tolist():
                    rows[key].add(rid)
            packed = [k.view(np.uint8).reshape(-1, 8)[:, : near.KEY_BYTES].tobytes() for k in sets]
            fp = pa.array(rids)
            batches.append(pa.RecordBatch.from_arrays([pa.array(rids), fp, fp, pa.array(packed)], ["rid", "fp", "fq", "keys"]))
        for out in near._deal(parts)(iter(batches)):
            for row in out.to_pylist():
                dealt[row["part"]].append(row)
    assert len(dealt) == parts
    got = defaultdict(set)
    for of_part in dealt.values():
        for row in near._several(pa.Table.from_pylist(of_part)).to_pylist():
            got[row["key"]].add(row["rid"])
    assert got == {k: v for k, v in rows.items() if len(v) > 1} and len(got) > 100


def test_only_the_kept_rows_stay_stored(spark):
    rnd = np.random.default_rng(6)
    base = words(rnd, 60)
    texts = [base, base + " more", words(rnd, 60), None, "", base, ""]
    ids = [3, 1, 2, 4, None, 3, None]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    mark = common.stored_mark()
    out = near.drop_near_duplicates(docs)
    assert len(common.stored_since(mark)) == 1
    rows = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert rows == sorted([(1, base + " more"), (2, texts[2]), (4, None), (None, "")], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 1
