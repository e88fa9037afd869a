"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores. Every shape runs
once on the smallest data beside it before it is timed. ``runs`` also holds bagging over four
copies of the rows, which tells cost per row from fixed cost, and with 1 and 4 partitions.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quorum import run_report  # noqa: E402
from quorum.checks import datasets as sets  # noqa: E402
from quorum.checks.queries import BAGS, DT, FIT_PARALLELISM, LR, NB, QUERIES  # noqa: E402
from quorum.plans.runs import bagging, single_model, stacking  # noqa: E402

RUNS = {
    "single_nb": lambda ds: single_model(ds, NB),
    "single_dt": lambda ds: single_model(ds, DT),
    "bagging_nb": lambda ds: bagging(ds, [NB] * BAGS),
    "bagging_nb_xxhash64": lambda ds: bagging(ds, [NB] * BAGS, method="xxhash64"),
    "stacking_nb": lambda ds: stacking(ds, [NB] * 2, NB),
    "single_lr": lambda ds: single_model(ds, LR),
    "bagging_mixed": lambda ds: bagging(ds, [NB, LR, DT], parallelism=FIT_PARALLELISM),
    "stacking_mixed": lambda ds: stacking(ds, [NB, LR, DT], LR, parallelism=FIT_PARALLELISM),
}
TABLES = ("keel_load", "labelled_points", "train_test_split", "bootstrap_weights", "nominal_value_class_counts")
DOCUMENT_QUERIES = ("single_nb_accuracy", "bagging_nb_documents", "stacking_nb_documents")


def overlapping(spark, sf_dir):
    """Classes that no linear score separates, so that the fit has an optimum to reach."""
    return single_model(sets.orders(spark, sf_dir), LR)


def four_copies(spark, sf_dir):
    df = sets.table(spark, sf_dir, "lineitem").withColumn("copy", F.explode(F.array(*map(F.lit, range(4)))))
    q, _, d, t = [sets.rescale(F.col(a.name), a.range_min, a.range_max) for a in sets.LINEITEM_REALS]
    label = F.when((q >= d) & (q >= t), 0).when(d >= t, 1).otherwise(2)
    ds = sets.from_table(df, sets.LINEITEM_REALS, label, (0, 1, 2), (*sets.LINEITEM_KEY, "copy"), name="four_copies")
    return bagging(ds, [NB] * BAGS)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quorum-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def jobs_and_shuffle(spark: SparkSession, before=(0, 0)) -> tuple[int, int]:
    """Jobs launched and shuffle bytes written since ``before``."""
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = sum(
        store.executorList(False).apply(i).totalShuffleWrite()
        for i in range(store.executorList(False).size())
    )
    tracker = spark.sparkContext.statusTracker()
    jobs = max(tracker.getJobIdsForGroup(None), default=-1) + 1
    return jobs - before[0], shuffled - before[1]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    queries: dict[str, float] = {}
    details: dict[str, dict] = {}

    runs = {name: (lambda s, d, run=run: run(sets.lineitem_dominant(s, d))) for name, run in RUNS.items()}
    runs |= {"single_lr_orders": overlapping, "bagging_nb_x4": four_copies}
    # Compile every shape and start the Python workers outside the timings.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in (*TABLES, *DOCUMENT_QUERIES):
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
        for run in runs.values():
            run_report(run(spark, small)).collect()

    for name in TABLES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        queries[name] = round(time.perf_counter() - start, 3)
    for name in DOCUMENT_QUERIES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).collect()
        queries[name] = round(time.perf_counter() - start, 3)

    for name, run in runs.items():
        before = jobs_and_shuffle(spark)
        start = time.perf_counter()
        result = run(spark, sf_dir)
        (row,) = run_report(result).collect()
        elapsed = time.perf_counter() - start
        jobs, shuffled = jobs_and_shuffle(spark, before)
        trained = result.dataset.frame.count() - row["total"]
        queries[name] = round(elapsed, 3)
        details[name] = {
            "total_seconds": row["total_seconds"],
            "execution_seconds": row["execution_seconds"],
            "accuracy": row["accuracy_rounded"],
            "rows_trained": trained,
            "models_fitted": result.fits,
            "fits_per_second": round(result.fits / elapsed, 3),
            "jobs": jobs,
            "shuffle_bytes": shuffled,
        }
    for n in (1, 4):
        ds = sets.lineitem_dominant(spark, sf_dir)
        start = time.perf_counter()
        bagging(ds, [NB, DT], num_partitions=n, parallelism=1).accuracy().collect()
        details[f"partitions_{n}"] = {"total_seconds": round(time.perf_counter() - start, 2)}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": details,
            }
        )
    )


if __name__ == "__main__":
    main()
