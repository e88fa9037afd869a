"""Runs of periodically repeated words, by a dictionary of basic factors.

A basic factor is a stretch of 2^k words. Factors of 2^(k+1) words are named by the pair of
names of their halves; positions whose factor occurs once in the text are left out, for no
longer factor there can repeat. A run of period p with 2^k <= p < 2^(k+1) repeats the factor
at its start p words later. Neighbouring occurrences of a factor at most half its length apart
all have the same distance, so occurrences fall into arithmetic progressions, of which at most
four start within twice the length. Where the run reaches beyond the end of the progression,
the last terms are p apart; where it does not, some term is p before the first term of a later
one. Both kinds of pairs are proposed, extended to both sides as far as words p apart are
equal, and kept if long enough. Of equal stretches the smallest period stays.

Words are stretches without ASCII white space, numbered from 0. Null and empty texts have no
words and no runs. Nothing is shuffled; memory follows the longest text.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quorum.llm.common import map_batches

#: A run has at least so many words, and at least two periods.
MIN_WORDS = 12
#: Texts are searched together up to so many words.
GROUP_WORDS = 200_000
#: Bytes of text split into words at a time.
SLICE_BYTES = 1 << 20

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", RUNS),
    T.StructField("collapsed", T.StringType()),
]


def word_numbers(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the distinct words by number."""
    data = (text or "").encode("utf-8", "surrogatepass")
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    parts, at = [], 0
    while at < len(data):
        end = at + SLICE_BYTES
        # A slice ends before a white space, so that no word is cut.
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        words = data[at:end].split()
        parts.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
        at = end
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), list(seen)


def _proposed(at: np.ndarray, name: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods proposed by the occurrences of factors of ``size`` words, which
    come sorted by name and position."""
    same = name[1:] == name[:-1]
    # True between two progressions.
    cut = ~same | (2 * (at[1:] - at[:-1]) > size)
    first = np.flatnonzero(np.concatenate([[True], cut]))
    last = np.flatnonzero(np.concatenate([cut, [True]]))
    member = np.concatenate([[0], np.cumsum(cut)])
    places, periods = [], []
    for step in (1, 2, 3):
        a, b = last[:-step], last[step:]
        if not len(a):
            break
        has_later = member < len(first) - step
        c = np.flatnonzero(has_later)
        d = first[member[has_later] + step]
        a, b = np.concatenate([a, c]), np.concatenate([b, d])
        period = at[b] - at[a]
        fits = (name[a] == name[b]) & (period >= size) & (period < 2 * size)
        places.append(at[a[fits]])
        periods.append(period[fits])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def _reach(words: np.ndarray, x: int, p: int) -> tuple[int, int]:
    """The longest stretch ``[lo, hi)`` around x whose words equal those p later."""
    lo, step = x, 16
    while lo > 0:
        b = max(0, lo - step)
        differ = np.flatnonzero(words[b:lo] != words[b + p : lo + p])
        if len(differ):
            lo = b + int(differ[-1]) + 1
            break
        lo, step = b, min(4 * step, 1 << 16)
    hi, step, end = x, 16, len(words) - p
    while hi < end:
        b = min(end, hi + step)
        differ = np.flatnonzero(words[hi:b] != words[hi + p : b + p])
        if len(differ):
            hi += int(differ[0])
            break
        hi, step = b, min(4 * step, 1 << 16)
    return lo, hi


def find_runs(words: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, by start and then period."""
    n = len(words)
    best: dict[tuple[int, int], int] = {}
    at, name, size = np.arange(n), np.asarray(words, np.int64), 1
    while len(at) and 2 * size <= n:
        order = np.argsort(name, kind="stable")
        ranked = name[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.cumsum(new) - 1
        often = np.bincount(group)[group] > 1
        at, name = at[order][often], group[often]
        if not len(at):
            break
        places, periods = _proposed(at, name, size)
        pairs = np.unique(np.stack([periods, places], axis=1), axis=0) if len(places) else np.zeros((0, 2), np.int64)
        bounds = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1, append=-1)) if len(pairs) else []
        for low, high in zip(bounds[:-1], bounds[1:]):
            p, xs, i = int(pairs[low, 0]), pairs[low:high, 1], 0
            while i < len(xs):
                lo, hi = _reach(words, int(xs[i]), p)
                if hi - lo >= max(p, min_words - p):
                    key = (lo, hi + p)
                    best[key] = min(best.get(key, p), p)
                # Later places in the same stretch tell nothing new.
                i += max(1, int(np.searchsorted(xs[i:], hi)))
        names = np.full(n, -1)
        names[at] = name
        at = np.flatnonzero(names[: n - size] >= 0) if size < n else at[:0]
        at = at[names[at + size] >= 0]
        name = names[at] * (int(group[-1]) + 1) + names[at + size]
        size *= 2
    runs = sorted((lo, end - lo, p) for (lo, end), p in best.items())
    return np.array(sorted(runs, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: all but those a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def _join(words: np.ndarray, vocabulary: list[bytes]) -> str:
    return b" ".join([vocabulary[i] for i in words.tolist()]).decode("utf-8", "surrogatepass")


def _searched(texts: list[tuple[np.ndarray, list[bytes]]]) -> list[tuple[int, np.ndarray, str]]:
    """Number of words, runs and collapsed text of every text, from one search over all."""
    sizes = np.array([len(w) for w, _ in texts], np.int64)
    ends = np.cumsum(sizes)
    # Words of different texts get different numbers, so that no factor repeats across texts.
    bases = np.cumsum([0, *(len(v) for _, v in texts)])
    runs = find_runs(np.concatenate([w + b for (w, _), b in zip(texts, bases)]))
    owner = np.searchsorted(ends, runs[:, 0], side="right")
    out = []
    for i, (words, vocabulary) in enumerate(texts):
        own = runs[owner == i] if len(runs) else runs
        own = own - np.array([ends[i] - sizes[i], 0, 0])
        left = words[kept_words(len(words), own)] if len(own) else words
        out.append((len(words), own, _join(left, vocabulary)))
    return out


def _with_tail(words: np.ndarray, start: int | None, period: int | None) -> np.ndarray:
    if start is None or period is None:
        return words
    i = np.arange(len(words))
    return words[np.where(i < start, i, start + (i - start) % period)]


def runs(docs: DataFrame, text: str = "text", tail: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start, then period) and ``collapsed``, the text's
    words outside the repeated periods, joined by one space.

    Extra columns stay; columns that have one of these three names are replaced. ``tail`` names
    two columns, a word number and a period: where both are given, the words from that number
    on are first replaced by a repetition of that many, which plants a known run.
    """
    docs = docs.drop(*(f.name for f in ADDED))
    schema = T.StructType([*docs.schema.fields, *ADDED])
    at = docs.columns.index(text)
    planted = [docs.columns.index(c) for c in tail] if tail else None
    list_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def packed(results):
        counts = [len(r) for _, r, _ in results]
        rows = np.concatenate([r for _, r, _ in results]) if results else np.zeros((0, 3), np.int64)
        fields = pa.StructArray.from_arrays([pa.array(rows[:, j]) for j in range(3)], ["start", "length", "period"])
        offsets = pa.array(np.cumsum([0, *counts]), pa.int32())
        return [
            pa.array([n for n, _, _ in results], pa.int64()),
            pa.ListArray.from_arrays(offsets, fields).cast(list_type),
            pa.array([t for _, _, t in results], pa.string()),
        ]

    def run(batches):
        for batch in batches:
            low, size, group = 0, 0, []
            tails = [batch.column(c).to_pylist() for c in planted] if planted else None
            for i, value in enumerate(batch.column(at)):
                words, vocabulary = word_numbers(value.as_py())
                if tails:
                    words = _with_tail(words, tails[0][i], tails[1][i])
                group.append((words, vocabulary))
                size += len(words)
                if size >= GROUP_WORDS or i == batch.num_rows - 1:
                    part = batch.slice(low, len(group))
                    yield pa.RecordBatch.from_arrays([*part.columns, *packed(_searched(group))], schema.names)
                    low, size, group = i + 1, 0, []

    return map_batches(docs, run, schema)
