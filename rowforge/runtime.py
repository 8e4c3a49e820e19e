"""Shared scratch storage for results that two branches of a plan must see identically."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what jobs inside store below the scratch folder, such as the rows of an export.

    Frames returned by such jobs, manifests included, must have been used by then. Without a scope all is
    left to the retention rules of the storage.
    """
    made: list[str] = []
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for folder in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared ``spark.checkpoint.dir``.

    On a cluster the setting must name storage every executor can reach. Only a local session, as in
    tests, falls back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rowforge-"))
        base = context.getCheckpointDir()
    folder = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if (made := _SCOPE.get()) is not None:
        made.append(folder)
    return folder


def pin_splits(spark: SparkSession) -> None:
    """Keep the split of files into scan tasks the same in all jobs of a session.

    Spark sizes the splits of small inputs by the cores at hand, which dynamic allocation changes.
    Row ids in scan order rest on the splits, so their number of cores is fixed at first use.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)


def materialize(df: DataFrame, purpose: str = "stage", folders: Sequence[str] = ()) -> DataFrame:
    """Write a frame to shared scratch storage and read it back, one folder per value of ``folders``.

    This cuts lineage in storage that outlives executors. Unlike an RDD checkpoint the result is
    columnar: later branches read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
