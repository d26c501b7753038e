"""Tables written to the folder that all executors share.

Operators that need a second look at a result (a dense index, a split, a
restart) write it here instead of caching it: a written table survives the loss
of an executor, cuts the lineage, and tells Spark its size, so that a join with
it is broadcast only when it is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import contextlib
import contextvars
import functools
import gc
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"
CODEC = "zstd"  # of stored tables; texts take about two thirds of what they take with snappy
_SCRATCH: contextvars.ContextVar[str] = contextvars.ContextVar("scratch", default="")


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="pairloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the cluster; a temporary one only where driver and tasks are one process."""
    path = spark.conf.get(_DIR_KEY, None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError(f"set {_DIR_KEY} to a folder all executors can reach")
    return _local_dir()


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/pairloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{run_dir(spark)}/{_SCRATCH.get()}{name}-{uuid.uuid4().hex}"


def worker_cache() -> dict:
    """A dict that lives as long as a Python worker process.

    Functions reach workers by value, so their own globals last one task. What is kept here
    is a function of its key; a lost worker only costs the time to make it again.
    """
    module = sys.modules.setdefault("pairloom_kept", types.ModuleType("pairloom_kept"))
    return module.__dict__.setdefault("entries", {})


def delete_path(spark: SparkSession, folder: str) -> None:
    """Delete a folder and all below it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def remove_intermediates(spark: SparkSession) -> None:
    """Delete the tables this application has put into the shared folder.

    To be called when its results are stored elsewhere: a DataFrame that still reads an
    intermediate table fails afterwards.
    """
    delete_path(spark, run_dir(spark))


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is written to fresh paths inside.

    For work whose result is stored at a path made before it: DataFrames that read the
    tables written inside fail afterwards.
    """
    folder = f"{_SCRATCH.get()}scratch-{uuid.uuid4().hex}/"
    token = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        delete_path(spark, f"{run_dir(spark)}/{folder}")


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over.

    It does so when the driver has collected what refers to them, which a driver with much memory
    left may not do for a whole job.
    """
    gc.collect()
    spark._jvm.System.gc()


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def committed_parts(spark: SparkSession, folder: str, name: str, mark: str = "=") -> set[int]:
    """Numbers k of the folders ``name=k`` in which a job has committed its table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(path):
        return set()
    parts = [entry.getPath().getName() for entry in files.listStatus(path)]
    done = lambda part: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}/_SUCCESS"))
    return {int(p.removeprefix(name + mark)) for p in parts if p.startswith(name + mark) and done(p)}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a scan with fewer input splits than cores out to all cores, by ``key``.

    One small file would otherwise keep one core busy. A table large enough to
    fill the cluster has more splits than cores and is returned as it is, without
    a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
