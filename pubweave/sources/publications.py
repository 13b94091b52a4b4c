"""The stored publications: a Parquet table partitioned by month of publication.

A save writes the rows it changes to a staging table first and from there into the
table: months that lose or replace a row are overwritten, others are appended to, so
what a save costs follows its batch, the months it updates and the stored keys, which
are shuffled without their texts.  A whole row of the batch is shuffled twice, by key
and by month, one of an updated month once, by month.  A year filter reads the
partitions of its months only.

The table has no versions.  Spark moves the finished files of a save into their
months one after another, so a reader at that moment may fail, or see some months
before and others after the save, and one job at a time may save.  A save that was
interrupted there is repeated with the same batch: what is stored with the same update
date is skipped.
"""

from __future__ import annotations

import os
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pubweave.operators.search import (
    as_integer,
    filter_publications,
    latest_publications,
)
from pubweave.operators.upsert import (
    DECISION_COLUMNS,
    INSERT,
    UPDATE,
    decide_changes,
    newest_per_key,
    stage_publications,
)
from pubweave.schemas import PUBLICATION_COLUMNS, PUBLICATIONS_SCHEMA
from pubweave.sources import files

STORE_ENV = "PUBWEAVE_STORE"
STORE_CONF = "spark.pubweave.store"
DEFAULT_STORE = "data/publications"

#: Up to this size, keys or marks of replaced rows travel to every task; beyond it both
#: sides are shuffled.
BROADCAST_BYTES = 8 * 1024 * 1024
#: Memory a broadcast mark takes: a bitmap of 32,768 rows and the name of their file.
MARK_BYTES = 4608
#: The month of papers without publication date.
NO_MONTH = "none"

#: Texts take a third less room than in Spark's default.
_CODEC = "zstd"

_MONTH = T.StructField("month", T.StringType())
_STORED = T.StructType([*PUBLICATIONS_SCHEMA.fields, _MONTH])
#: Where a stored row is.
_PLACE = [
    T.StructField("old_month", T.StringType()),
    T.StructField("old_file", T.StringType()),
    T.StructField("old_row", T.LongType()),
]
_CHANGES = T.StructType([
    *PUBLICATIONS_SCHEMA.fields,
    *_PLACE,
    T.StructField("action", T.StringType()),
    T.StructField("copies", T.LongType()),
    _MONTH,
])


def store_path(spark: SparkSession, path: str | None = None) -> str:
    """Argument, else environment, else session setting, else the default.

    Blank counts as unset.
    """
    candidates = (path, os.environ.get(STORE_ENV), spark.conf.get(STORE_CONF, None))
    return next((c for c in candidates if c), DEFAULT_STORE)


def init_store(spark: SparkSession, path: str | None = None) -> str:
    """Create the empty table if there is none; returns its folder."""
    store = store_path(spark, path)
    files.make_folder(spark, store)
    return store


def _read_months(spark: SparkSession, store: str, places: bool = False) -> DataFrame:
    """All stored columns and ``month``, the partition column, on request with the place of
    every row; no rows if there is no table."""
    if not files.exists(spark, store):
        return spark.createDataFrame([], T.StructType([*_STORED, *_PLACE]) if places else _STORED)
    stored = spark.read.schema(_STORED).parquet(store)
    if not places:
        return stored
    return stored.select(
        *_STORED.names,
        F.col("month").alias("old_month"),
        F.col("_metadata.file_path").alias("old_file"),
        F.col("_metadata.row_index").alias("old_row"),
    )


def read_publications(
    spark: SparkSession, path: str | None = None, year: Any = None
) -> DataFrame:
    """All stored columns, of one year's months if it is given; no rows, with all columns,
    if nothing is stored."""
    stored = _read_months(spark, store_path(spark, path))
    whole_year = as_integer(year)
    if whole_year is not None:
        first, last = f"{whole_year:04d}-01", f"{whole_year:04d}-12"
        stored = stored.filter(F.col("month").between(first, last))
    return stored.drop("month")


def load_publications(
    spark: SparkSession,
    path: str | None = None,
    *,
    year: Any = None,
    category: str | None = None,
    text: str | None = None,
    limit: Any = None,
) -> DataFrame:
    """Stored publications, filtered, latest update first.

    A year reads its twelve months only.  Reports need no order; they start from
    ``read_publications``.
    """
    stored = read_publications(spark, path, year).select(*PUBLICATION_COLUMNS)
    return latest_publications(filter_publications(stored, year, category, text), limit)


def save_publications(
    papers: DataFrame, path: str | None = None, *, strict: bool = True
) -> dict[str, Any]:
    """Merge classified papers into the store; returns what was done.

    ``papers`` is computed once, and what is decided on them goes into an intermediate
    table.  Later steps read it back from files, so a lost executor costs a re-read, and
    no count depends on task retries.
    """
    spark = papers.sparkSession
    store = store_path(spark, path)
    staged = stage_publications(papers, strict)
    scratch = f"{files.scratch_root(spark, store + '/_staging')}/staging-{uuid.uuid4().hex}"
    try:
        changes = decide_changes(
            _read_months(spark, store, places=True),
            newest_per_key(staged),
            carried=[field.name for field in _PLACE],
            counted=True,
        )
        changes.withColumn("month", _month("published_date")).write.parquet(
            f"{scratch}/changes", compression=_CODEC
        )
        total, inserted, updated = _apply(spark, store, scratch)
    finally:
        files.delete(spark, scratch)
    return {
        "inserted": inserted,
        "updated": updated,
        "skipped": total - inserted - updated,
        "path": store,
    }


def _apply(spark: SparkSession, store: str, scratch: str) -> tuple[int, int, int]:
    """Bring the staged changes into the table; returns the papers of the batch, and those
    inserted and updated."""
    changes = spark.read.schema(_CHANGES).parquet(f"{scratch}/changes")
    # One row per pair of months, so its size does not depend on the batch.
    done = changes.groupBy("month", "old_month").agg(
        F.sum("copies").alias("papers"),
        F.count_if(F.col("action") == INSERT).alias("inserted"),
        F.count_if(F.col("action") == UPDATE).alias("updated"),
        F.sum(F.when(F.col("action") == UPDATE, _key_bytes())).alias("key_bytes"),
    ).collect()
    total, inserted, updated = (
        sum(row[name] for row in done) for name in ("papers", "inserted", "updated")
    )
    if not total:
        return 0, 0, 0
    updates = [row for row in done if row["updated"]]
    touched = {row["month"] for row in updates} | {row["old_month"] for row in updates}
    changes = changes.filter(F.col("action").isin(INSERT, UPDATE))
    init_store(spark, store)
    if touched:
        key_bytes = sum(row["key_bytes"] for row in updates)
        _overwrite_months(spark, store, changes, touched, key_bytes)
    if {row["month"] for row in done if row["inserted"]} - touched:
        added = changes.filter(~F.col("month").isin(sorted(touched)))
        _by_month(added.select(*_STORED.names)).write.mode("append").partitionBy(
            "month"
        ).parquet(store, compression=_CODEC)
    return total, inserted, updated


def _overwrite_months(
    spark: SparkSession, store: str, changes: DataFrame, months: set[str], key_bytes: int
) -> None:
    """Write what the months hold after the changes, and put it in their place."""
    here = F.col("month").isin(sorted(months))
    stored = _read_months(spark, store, places=True).filter(here)
    kept = _without_replaced(stored, changes.filter(F.col("action") == UPDATE), key_bytes)
    kept, added = kept.select(*_STORED.names), changes.filter(here).select(*_STORED.names)
    merged = kept.unionByName(added)
    left = {row["month"] for row in merged.select("month").distinct().collect()}
    # Spark reads the months to the end before it puts the new ones in their place.
    _by_month(merged).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("month").parquet(store, compression=_CODEC)
    for month in months - left:
        files.delete(spark, f"{store}/month={month}")


def _without_replaced(stored: DataFrame, updates: DataFrame, key_bytes: int) -> DataFrame:
    """Stored rows that no update replaces.

    They stay where they are, unless neither the keys of the updates can be broadcast nor
    the places of the replaced rows, one bit for each row of a file.
    """
    replaced = updates.select("paper_id")
    if key_bytes <= BROADCAST_BYTES:
        return stored.join(F.broadcast(replaced), "paper_id", "left_anti")
    marks = updates.groupBy(
        F.col("old_file").alias("file"), F.bitmap_bucket_number("old_row").alias("bucket")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("old_row")).alias("bits"))
    if marks.count() * MARK_BYTES > BROADCAST_BYTES:
        return stored.join(replaced, "paper_id", "left_anti")
    bit = F.bitmap_bit_position("old_row")
    byte = F.conv(F.hex(F.substr("bits", F.floor(bit / 8) + 1, F.lit(1))), 16, 10).cast("int")
    marked = (
        (F.col("old_file") == F.col("file"))
        & (F.bitmap_bucket_number("old_row") == F.col("bucket"))
        & (F.getbit(byte, (bit % 8).cast("int")) == 1)
    )
    return stored.join(F.broadcast(marks), marked, "left_anti")


def _by_month(rows: DataFrame) -> DataFrame:
    # Few tasks per month, more for a large one: adaptive execution evens them out.
    return rows.hint("rebalance", "month").sortWithinPartitions("month", "published_date")


def _month(column: str) -> Column:
    return F.coalesce(F.date_format(column, "yyyy-MM"), F.lit(NO_MONTH))


def _key_bytes() -> Column:
    """Memory a broadcast key takes, generously."""
    return F.octet_length("paper_id") + 64
