"""Cut a plan where an intermediate table is used many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate results that every executor reaches (``spark.checkpoint.dir``).

    A folder of our own is made only for a local master; on a cluster the setting is needed, since each
    machine would write to a disk of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="leafquery-"))
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back.

    Cuts the plan where several branches read one intermediate table; columns stay prunable, and
    the result outlives the executors that made it.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``stage`` wrote for ``df``, once nothing reads it any more."""
    remove_folder(df.sparkSession, df.staged_at)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies; one that is not there is passed over."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    For narrow per-group tables that join to large ones: without the hint both sides would be
    shuffled by a key of few values.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a source yields fewer partitions than there are cores.

    A small file is one scan task; a large input has many and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
