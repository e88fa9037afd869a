"""The orders files: one per part under the same header, written without one task sorting a file."""

from pyspark.sql import functions as F

from quorum.checks import datasets as sets


def test_file_lines_are_sorted_by_ranges_and_in_order(spark):
    header = spark.createDataFrame([(1, None, "@b"), (0, None, "@a")], "position int, row_id long, value string")
    rows = spark.range(0, 2000, 1, 8).select(F.lit(None).cast("int").alias("position"), (1999 - F.col("id")).alias("row_id"))
    rows = rows.withColumn("value", F.col("row_id").cast("string"))
    lines = sets.file_lines(header.unionByName(rows))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    # Before, a file's lines were hash-partitioned into ORDERS_FILES tasks and each task sorted all of its file.
    assert "rangepartitioning" in plan
    assert [r.value for r in lines.collect()] == ["@a", "@b", *[str(i) for i in range(2000)]]


def test_every_file_has_the_header_and_its_rows(spark):
    path = sets.orders_files(spark, "/root/testdata/sf0.001")
    read = spark.read.text(path).select("part", "value", F.col("_metadata.file_path").alias("file"))
    assert read.select("file").distinct().count() == sets.ORDERS_FILES
    orders = sets.table(spark, "/root/testdata/sf0.001", "orders").count()
    assert read.filter(~F.col("value").startswith("@")).count() == orders
    assert read.filter(F.col("value") == "@data").groupBy("part").count().filter("count = 1").count() == sets.ORDERS_FILES
