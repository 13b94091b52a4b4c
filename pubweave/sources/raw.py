"""Snapshots of raw papers."""

from __future__ import annotations

import warnings
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pubweave.sources import files
from pubweave.sources.atom import empty_raw

DEFAULT_NAME = "papers"
DEFAULT_DIR = "raw-data"


def save_raw_data(
    df: DataFrame, name: str = DEFAULT_NAME, directory: str = DEFAULT_DIR
) -> dict[str, Any]:
    """Overwrite the snapshot; returns its path, number of rows and size.

    Rows are counted from the written files' footers, not by a second run.
    """
    if not isinstance(df, DataFrame):
        raise TypeError("df must be a DataFrame")
    spark, path = df.sparkSession, f"{directory}/{name}"
    files.overwrite_parquet(df, path)
    return {
        "path": path,
        "rows": spark.read.schema(df.schema).parquet(path).count(),
        "size_bytes": files.size_bytes(spark, path),
    }


def load_raw_data(
    spark: SparkSession, name: str = DEFAULT_NAME, directory: str = DEFAULT_DIR
) -> DataFrame:
    """The snapshot, or a warning and no rows if there is none."""
    path = f"{directory}/{name}"
    if not files.exists(spark, path):
        warnings.warn(f"Snapshot '{path}' not found; returning no papers", stacklevel=2)
        return empty_raw(spark)
    return spark.read.parquet(path)
