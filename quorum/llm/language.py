"""Language identification by words, backing off to character n-grams.

Training counts every word of every learning row with Spark and keeps the most frequent of each
language; the n-grams are counted over the same words, weighted by their frequency. Prediction
adds up a log frequency per language and word: a known word's own, else that of its longest
known n-grams, order by order from the longest to single characters.

* null text or text without a letter: language ``und``, score 0.
* no learning row at all: ``und`` for every row.
* a text of unknown words and characters only: the first language by name, as all tie; its
  score is one over the number of languages.
* repeated rows count as often as they stand there; rows without a language teach nothing.
  Extra columns stay; the result columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.llm.common import map_batches

#: Most frequent words of a language that the model keeps, and n-grams of each order.
WORDS = 30_000
GRAMS = 20_000
ORDERS = (4, 3, 2, 1)
#: A count that stands for never seen.
UNSEEN = 0.5
#: Log frequency taken off for every order a word is backed off by.
BACKOFF = 0.7
UNKNOWN = "und"
#: Words scored by one worker and remembered.
CACHE_WORDS = 300_000
MARK = "\u0002"

LETTERS = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, and for words and each order of n-grams a row of log frequencies."""

    languages: tuple[str, ...]
    words: dict[str, np.ndarray]
    grams: dict[int, dict[str, np.ndarray]]
    floors: dict[int, np.ndarray]


def _top(counted: DataFrame, by: list[str], n: int) -> DataFrame:
    """The ``n`` most frequent of each group; one row per distinct value and group comes in."""
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "item")
    return counted.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def counts(docs: DataFrame, learn_from: Column, words: int = WORDS, grams: int = GRAMS) -> DataFrame:
    """``order`` (0 for words), ``lang``, ``item``, ``n``: what the model keeps of all learning rows."""
    rows = docs.filter(learn_from & F.col("lang").isNotNull()).select("lang", F.lower("text").alias("t"))
    said = rows.select("lang", F.explode(F.regexp_extract_all("t", F.lit(r"\p{L}+"), F.lit(0))).alias("item"))
    per_word = said.groupBy("lang", "item").agg(F.count(F.lit(1)).alias("n"))
    # A word's n-grams, once per distinct word; its ends are marked.
    marked = F.concat(F.lit(MARK), "item", F.lit(MARK))
    spelled = per_word.select("lang", marked.alias("w"), F.length(marked).alias("len"), "n")

    def cut(k: int) -> Column:
        starts = F.when(F.col("len") >= k, F.sequence(F.lit(1), F.col("len") - k + 1))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")),
            lambda i: F.struct(F.lit(k).alias("order"), F.substring(F.col("w"), i, F.lit(k)).alias("item")),
        )

    cuts = F.flatten(F.array(*map(cut, ORDERS)))
    per_gram = spelled.select("lang", "n", F.explode(cuts).alias("g")).groupBy("g.order", "lang", "g.item")
    per_gram = per_gram.agg(F.sum("n").alias("n"))
    kept = _top(per_gram, ["order", "lang"], grams)
    kept_words = _top(per_word, ["lang"], words).select(F.lit(0).alias("order"), "lang", "item", "n")
    return kept_words.unionByName(kept.select("order", "lang", "item", "n"))


def fit(docs: DataFrame, learn_from: Column, words: int = WORDS, grams: int = GRAMS) -> LanguageModel:
    """The model of ``docs(text, lang)``. What reaches the driver is the model: at most ``words``
    and four times ``grams`` rows of each language."""
    got = counts(docs, learn_from, words, grams).toArrow().to_pandas()
    languages = tuple(sorted(got["lang"].unique()))
    at = {lang: i for i, lang in enumerate(languages)}
    tables: dict[int, dict[str, np.ndarray]] = {0: {}, **{k: {} for k in ORDERS}}
    for order, lang, item, n in got.itertuples(index=False):
        tables[order].setdefault(item, np.zeros(len(languages)))[at[lang]] = n
    floors = {}
    for order, table in tables.items():
        if not table:
            floors[order] = np.zeros(len(languages))
            continue
        matrix = np.stack(list(table.values()))
        total = matrix.sum(axis=0)
        # One floor for all: less text to learn from must not make unseen words likelier.
        floor = np.log(UNSEEN) - np.log(total.max())
        floors[order] = np.full(len(languages), floor)
        with np.errstate(divide="ignore"):
            logs = np.where(matrix > 0, np.log(matrix) - np.log(total), floor)
        for row, item in zip(logs, table):
            table[item] = row
    return LanguageModel(languages, tables[0], {k: tables[k] for k in ORDERS}, floors)


class Scorer:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.seen: dict[str, int] = {}
        self.rows = np.empty((1024, len(model.languages)))

    def word(self, word: str) -> np.ndarray:
        """Known: its log frequency. Else the mean over its n-grams of the longest order of which
        it has a known one; unknown n-grams of that order count as never seen."""
        known = self.model.words.get(word)
        if known is not None:
            return known
        marked = MARK + word + MARK
        for step, k in enumerate(ORDERS, 1):
            table = self.model.grams[k]
            grams = [table.get(marked[i : i + k]) for i in range(len(marked) - k + 1)]
            if any(g is not None for g in grams):
                floor = self.model.floors[k]
                return np.mean([floor if g is None else g for g in grams], axis=0) - BACKOFF * step
        return np.zeros(len(self.model.languages))

    def row_of(self, word: str) -> int:
        at = self.seen.get(word)
        if at is None:
            if len(self.seen) >= CACHE_WORDS:
                self.seen.clear()
            at = len(self.seen)
            if at >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[at] = self.word(word)
            self.seen[word] = at
        return at

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall((text or "").lower())
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.model.languages))
        for i in range(0, len(words), 10_000):
            if len(self.seen) + 10_000 > CACHE_WORDS:
                self.seen.clear()  # row numbers must not change between look-up and sum
            part = words[i : i + 10_000]
            rows = list(map(self.seen.get, part))
            if None in rows:
                rows = [self.row_of(w) if r is None else r for w, r in zip(part, rows)]
            total += self.rows[rows].sum(axis=0)
        best = int(total.argmax())
        weights = np.exp(np.maximum(total - total[best], -700))
        return self.model.languages[best], float(1 / weights.sum())


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the share of the best language's likelihood)."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS and GRAMS
    at = docs.columns.index("text")
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]
    )

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            names, scores = [], []
            for text in batch.column(at):
                lang, score = scorer(text.as_py())
                names.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    return map_batches(docs, run, schema)
