"""Sinks: splits, augmented languages, feature caches, result records."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.sampling import split_sizes
from pairloom.schemas import require_columns
from pairloom.shared import CODEC, committed_parts, delete_path


# Row groups of 32 MB, because a task has a file open in each folder.
_PARQUET = {"compression": CODEC, "parquet.block.size": str(32 << 20)}


@contextlib.contextmanager
def _unsorted(spark: SparkSession, folders: int = 16) -> Iterator[None]:
    """Writes inside keep a file open for each of a few folders, in place of a sort of all rows by folder."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(folders))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> dict[str, int]:
    """Write a table with a ``split`` column, one folder per split; return the sizes.

    The sizes are counted on the written files, where the split is a folder name
    and Parquet keeps row counts, so the plan behind ``df`` runs only once.
    """
    require_columns(df, "split")
    spark = df.sparkSession
    writer = df.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        with _unsorted(spark):
            writer.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
        schema = df.drop("split").schema.add("split", "string")
        stored = spark.read.schema(schema).options(
            header=True, quote='"', escape='"', multiLine=True
        ).csv(path)
    else:
        with _unsorted(spark):
            writer.options(**_PARQUET).parquet(path)
        stored = spark.read.parquet(path)
    return {row["split"]: row["n_rows"] for row in split_sizes(stored).collect()}


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None when no job has committed one there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    names = [entry.getPath().getName() for entry in files.listStatus(folder)]
    if all(name.startswith(("_", ".")) for name in names):
        return None
    return spark.read.parquet(path)


def stored_languages(spark: SparkSession, path: str) -> set[str]:
    """Languages with a committed folder at ``path``; lists folders and reads no rows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return set()
    names = [entry.getPath().getName() for entry in files.listStatus(folder)]
    return {name.removeprefix("lang=") for name in names if name.startswith("lang=")}


def add_languages(rows: DataFrame, path: str) -> None:
    """Store rows in a folder for each ``lang``, in one job; other languages stay as they are.

    The job commits all its folders together at its end, so a failed one leaves none.
    """
    require_columns(rows, "lang")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    with _unsorted(rows.sparkSession):
        writer.options(**_PARQUET).partitionBy("lang").parquet(path)


def cached_features(
    spark: SparkSession,
    folder: str,
    mode: str,
    model: str,
    max_len: int,
    make: Callable[[], DataFrame],
    reprocess: bool = False,
) -> DataFrame:
    """Features stored under ``(mode, model, max_len)``; computed when missing."""
    path = f"{folder.rstrip('/')}/cached_{mode}_{model}_{max_len}_binary"
    found = None if reprocess else stored_table(spark, path)
    if found is None:
        make().write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    return found


def append_records(records: DataFrame, path: str) -> None:
    """Append ``{config, results}`` records as JSON lines, one folder per attempt and dataset.

    An attempt counts when its job has committed it; a failed one leaves nothing that
    ``read_records`` would read. An attempt may repeat what an earlier one has appended.
    """
    require_columns(records, "config", "results")
    spark = records.sparkSession
    attempt = max(committed_parts(spark, path, "attempt"), default=-1) + 1
    (
        records.withColumn("dataset", F.col("config.dataset"))
        .write.mode("overwrite")  # of what a failed attempt has left
        .partitionBy("dataset")
        .option("ignoreNullFields", False)
        .json(f"{path.rstrip('/')}/attempt={attempt}")
    )


def read_records(spark: SparkSession, path: str, schema) -> DataFrame:
    """The records of all committed attempts; of several with one config the last attempt's."""
    path = path.rstrip("/")
    done = sorted(committed_parts(spark, path, "attempt"))
    if not done:
        return spark.createDataFrame([], schema).select("config", "results")
    rows = spark.read.schema(schema).option("basePath", path).json([f"{path}/attempt={k}" for k in done])
    attempt = F.regexp_extract(F.col("_metadata.file_path"), "/attempt=([0-9]+)/", 1).cast("int")
    last = F.max_by("results", attempt).alias("results")
    return rows.groupBy("config").agg(last).select("config", "results")


def write_report(report: DataFrame, path: str, *order: str, line: str = "line") -> None:
    """Write the ``line`` column, sorted by ``order``, as one text file at ``path``.

    The lines, a few for each run, are written by one task to a folder beside the file, which
    then takes the file's place by a rename: readers see the old report or the new one.
    """
    spark = report.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}"
    rows = report.select(line, *order).repartition(1).sortWithinPartitions(*order)
    rows.select(F.col(line).alias("value")).write.text(folder)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    parts = [entry.getPath() for entry in files.listStatus(hadoop.Path(folder)) if entry.getPath().getName().startswith("part-")]
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    if not parts:  # no lines: an empty file
        parts = [hadoop.Path(f"{folder}/empty")]
        files.create(parts[0]).close()
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(parts[0], target, overwrite)
    delete_path(spark, folder)
