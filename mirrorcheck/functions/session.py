"""Cutting lineage safely on a cluster."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; where it is unset, one below the warehouse folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below the checkpoint folder; what is written there goes when the driver ends."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


@contextmanager
def pieces(spark: SparkSession, size: str = "16MB", most: int = 1000):
    """Frames stored inside read their shuffles in pieces of about that size, of which there are ``most`` before small ones are put together.

    So the memory of a task stays the same as the input grows, up to ``size`` times ``most`` in a shuffle.
    """
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": size, "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(most)}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stable(df: DataFrame) -> DataFrame:
    """Write a frame to the checkpoint folder, so that all its readers see the same rows, once computed."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``stable``, but by columns and compressed (Parquet): for wide frames of which readers want some columns."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
