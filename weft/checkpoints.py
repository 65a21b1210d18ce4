"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def checkpoint(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and all executors are threads of this process (tests). On a cluster an unset folder is an error, as executors could not see ours."""
    if _SCRATCH.get():
        return _SCRATCH.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="weft-checkpoint-")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder within the shared one for all checkpoints and tables between; it is deleted at the end, also after an error.

    Results have to be written or collected before the end, as they may read from there.
    Jobs that run side by side in one session should share one scratch folder: a session has
    one place for checkpoints.
    """
    sc = spark.sparkContext
    before = sc.getCheckpointDir() or shared_folder(spark)
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(folder)
    sc.setCheckpointDir(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(token)
        sc.setCheckpointDir(before)
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
