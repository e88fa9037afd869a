"""Views of a labelled set: labelled points, summary, value counts."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.functions.encode import literal_array
from quorum.schema import NOMINAL, Dataset


def labelled_points(ds: Dataset) -> DataFrame:
    """``label`` and ``features`` (a dense vector without attribute metadata).

    A plain array turned into a vector carries no nominal metadata, so a tree splits
    nominal codes as ordered numbers.
    """
    return ds.frame.select(*ds.key, "label", array_to_vector("features").alias("features"))


def dataset_summary(ds: Dataset) -> DataFrame:
    """One row: counts of inputs, outputs, attributes and instances, and the class list."""
    meta = ds.meta
    # A plain count would read no column, and rows that fail to parse would count.
    whole = (F.col("label") >= -1) & ~F.exists("inputs", lambda x: x.isNull())
    return ds.frame.agg(F.count_if(whole).alias("n_instances")).select(
        F.lit(meta.n_input).alias("n_input"),
        F.lit(meta.n_output).alias("n_output"),
        F.lit(meta.n_attributes).alias("n_attributes"),
        "n_instances",
        F.array(*[F.lit(str(c)) for c in meta.classes]).alias("classes"),
    )


def _nominal_values(ds: Dataset, by_class: bool) -> DataFrame:
    nominals = [(j, a) for j, a in enumerate(ds.meta.inputs) if a.kind == NOMINAL]
    if not nominals:
        raise ValueError("the set has no nominal input")
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(a.name).alias("attribute"), F.col("inputs")[j].cast("int").alias("code"))
                for j, a in nominals
            ]
        )
    )
    label = ["label"] if by_class else []
    seen = ds.frame.select(*label, pairs.alias("p")).select(
        "p.attribute", "p.code", *label, F.lit(1).cast("long").alias("n")
    )
    # Declared values nobody uses count 0. This list is as long as the header.
    labels = [float(c) for c in range(ds.meta.n_output)] if by_class else [None]
    zeros = [
        (a.name, code, *([] if c is None else [c]), 0)
        for _, a in nominals
        for code in range(len(a.values))
        for c in labels
    ]
    schema = T.StructType(
        [T.StructField("attribute", T.StringType()), T.StructField("code", T.IntegerType())]
        + ([T.StructField("label", T.DoubleType())] if by_class else [])
        + [T.StructField("n", T.LongType())]
    )
    declared = ds.spark.createDataFrame(zeros, schema)
    counts = (
        seen.unionByName(declared)
        .groupBy("attribute", "code", *label)
        .agg(F.sum("n").alias("n"))
    )
    names = F.lit(None).cast("string")
    for _, a in nominals:
        domain = literal_array(a.values)
        names = F.when(F.col("attribute") == a.name, F.get(domain, F.col("code"))).otherwise(names)
    return counts.select("attribute", "code", names.alias("value"), *label, "n")


def nominal_value_counts(ds: Dataset) -> DataFrame:
    """Rows per value of each nominal input; an undeclared value has code -1."""
    return _nominal_values(ds, by_class=False)


def nominal_value_class_counts(ds: Dataset) -> DataFrame:
    """Rows per value and class of each nominal input."""
    return _nominal_values(ds, by_class=True)
