"""Copies are numbered by many tasks, however few the different rows."""

from pyspark.sql import functions as F

from quorum.operators.sampling import COPY_BLOCK, numbered_copies


def test_copies_of_few_rows_are_written_by_many_tasks(spark):
    n = 8 * COPY_BLOCK
    df = spark.range(0, n, 1, 8).select(F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("value"))
    numbered = numbered_copies(df)
    # Before, the adaptive plan put the few counted rows into one task, which wrote out all copies.
    sizes = numbered.rdd.glom().map(len).collect()
    assert sum(1 for s in sizes if s) > 1
    got = numbered.groupBy("value").agg(F.count("*").alias("n"), F.min("copy").alias("lo"), F.max("copy").alias("hi"), F.countDistinct("copy").alias("d"))
    assert sorted(map(tuple, got.collect())) == [("a", n // 4, 0, n // 4 - 1, n // 4), ("b", 3 * n // 4, 0, 3 * n // 4 - 1, 3 * n // 4)]


def test_no_rows(spark):
    assert numbered_copies(spark.createDataFrame([], "value string")).count() == 0
