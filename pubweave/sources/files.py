"""Small file-system helpers on the session's Hadoop file systems."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def _locate(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _locate(spark, path)
    return fs.exists(jpath)


def size_bytes(spark: SparkSession, path: str) -> int:
    fs, jpath = _locate(spark, path)
    return fs.getContentSummary(jpath).getLength()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, jpath = _locate(spark, path)
    if not fs.exists(jpath):
        return []
    return [status.getPath().getName() for status in fs.listStatus(jpath)]


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _locate(spark, path)
    fs.delete(jpath, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, jpath = _locate(spark, path)
    fs.mkdirs(jpath)


def overwrite_parquet(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``, also if ``df`` reads from it.

    The old table stays until the new one is written in full.  It is then deleted
    before the new one takes its name: readers in between fail, and after a crash
    just there the complete new table is found as ``path.writing-...``.
    """
    spark = df.sparkSession
    draft = f"{path}.writing-{uuid.uuid4().hex}"
    try:
        df.write.parquet(draft)
        delete(spark, path)
        fs, jpath = _locate(spark, path)
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(draft), jpath):
            raise OSError(f"Cannot move {draft} to {path}")
    except BaseException:
        if exists(spark, path):
            delete(spark, draft)
        raise


def scratch_root(spark: SparkSession, fallback: str) -> str:
    """Shared folder for intermediate tables: the cluster's checkpoint folder
    if it names one, else ``fallback``."""
    return spark.conf.get(CHECKPOINT_DIR, None) or fallback


def shared_scratch(spark: SparkSession) -> str:
    """The folder of ``scratch_root``, which a cluster has to name: its machines share no
    temporary folder.  A local session without the setting gets one of its own."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_DIR} to a folder that all machines share")
    return _local_scratch()


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="pubweave-")
