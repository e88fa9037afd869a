"""Keeping a frame that several jobs read."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

KEEP_MODES = (None, False, True, "checkpoint")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local session without one gets a temporary one;
    on a cluster the folder has to be shared and is the caller's to name."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="quorum-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and cut its lineage. What reads it may be lazy,
    so its files stay until Spark's cleaner removes them
    (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def kept(df: DataFrame, keep, passes: int):
    """The frame, stored for the length of the block if it pays.

    ``keep=None`` decides by the number of passes over it; True stores it in executor
    memory and disk (lost blocks are recomputed); ``"checkpoint"`` writes it to the shared
    folder, so that a lost executor costs a read and not a recomputation, and deletes the
    files when the block ends.
    """
    if keep not in KEEP_MODES:
        raise ValueError(f"cache must be one of {KEEP_MODES}")
    if keep == "checkpoint":
        spark = df.sparkSession
        path = shared_folder(spark, "kept")
        df.write.parquet(path)
        try:
            yield spark.read.schema(df.schema).parquet(path)
        finally:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        return
    if keep is False or (keep is None and passes < 2):
        yield df
        return
    stored = df.persist(StorageLevel.MEMORY_AND_DISK)
    # Filled before the passes start: side by side they would each compute what is not there yet.
    stored.count()
    try:
        yield stored
    finally:
        stored.unpersist()
