"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes the shuffle files of an execution when it has ended, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables that are still there, and their sessions; removed when the driver's Python ends.
_KEPT: dict[str, SparkSession] = {}


@atexit.register
def _remove_all() -> None:
    for folder, spark in _KEPT.items():
        _remove(spark, folder)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; in local mode one of our own where that is unset.

    Elsewhere the setting is needed: a machine's own folder would be a different one on each executor.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='factorlab-')}")
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/factorlab-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, lost executors cost nothing.

    The shuffle files of the write go when it ends; the table goes with freed(), or when the driver's Python ends.
    """
    spark = df.sparkSession
    folder, before = shared_folder(spark), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.parquet(folder)
    out.folder_of_ours = folder
    _KEPT[folder] = spark
    return out


def freed(*tables: DataFrame | None) -> None:
    """Removes tables that stored() gave; nothing may read them any more. Others are left alone."""
    for table in tables:
        folder = table.__dict__.get("folder_of_ours") if table is not None else None
        if folder:
            _remove(table.sparkSession, folder)
            _KEPT.pop(folder, None)
