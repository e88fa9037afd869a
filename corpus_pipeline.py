"""A training corpus from ``documents``: drop low quality, exact and near duplicates and
benchmark leaks, then encode.

Every stage reads all rows the one before kept, as ``(spark, docs, sf_dir) -> DataFrame``.
``run`` writes each stage's rows as Parquet to the session's shared folder and rereads them.
Rows of ``documents`` that repeat both id and text count as one row from the second stage on.
An empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.llm import bpe, decontaminate, exact, near, quality
from quorum.llm.common import release, stored, stored_mark, stored_since, table
from quorum.llm.queries import QUALITY_THRESHOLD, TOKENIZER


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; learned from all of ``labels``."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, F.lit(True))
    return quality.score(docs, model).filter(F.col("score") >= QUALITY_THRESHOLD).drop("score")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    return exact.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by five-word shingles at a similarity of 0.8."""
    return near.drop_near_duplicates(docs, shingle=5, num=80, den=100)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids and the text these decode to."""
    path = public_tokenizers.path(TOKENIZER)
    out = bpe.decode(bpe.encode(docs, path), path)
    return out.withColumn("n_tokens", F.size("tokens").cast("long"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_leaks),
    ("BPE encoding and decoding", encoded),
]

#: The quality score is a compressed size, which SQL cannot compute.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    previous: list[str] = []
    for _, stage in STAGES:
        mark = stored_mark()
        out = stage(spark, docs, sf_dir)
        working = stored_since(mark)
        docs = stored(out)
        release(spark, working + previous)
        previous = stored_since(stored_mark() - 1)
    return docs
