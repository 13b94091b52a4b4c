"""Exact deduplication by skew-safe combining.

1. Local: every input task keeps one row per distinct text (the map side of
   the first aggregation).
2. Salted: the local winners of a digest meet in up to ``SALTS`` groups, so
   that the copies of one text never gather in a single task.
3. Global: the salt winners of a digest, at most ``SALTS`` of them, are combined.

The full text is a grouping key at every stage: a digest only says where rows
meet, never that they are equal.  Members find their class by digest; should
two texts share a digest, they find it by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pubweave.llm.common import lookup, one_row_each, saved, whole_text

SALTS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def classes_of_equal_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """One row per distinct text: digest, text, keep_id (largest id), group_size."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        whole_text(text_col).alias("text"),
        # All rows of a task share a salt, so local winners stay single.
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
    ).withColumn("digest", digest(F.col("text")))
    salted = rows.groupBy("digest", "salt", "text").agg(
        F.max("doc_id").alias("winner"), F.count("*").alias("n")
    )
    return salted.groupBy("digest", "text").agg(
        F.max("winner").alias("keep_id"), F.sum("n").alias("group_size")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """The class of every document, dropped ones too.

    Returns doc_id, keep_id (the largest id of equal texts, which stays),
    group_size, kept, and digest.  Null texts are equal to empty ones.  Rows that
    repeat an id and its text share one verdict and count one each in
    group_size.  Null ids never win against others; a class of null ids only
    has a null keep_id and keeps all its rows.  No rows give no rows; other
    columns are ignored, whatever their names.
    """
    classes = classes_of_equal_texts(docs, id_col, text_col, digest, salts)
    narrow = saved(classes.select("digest", "keep_id", "group_size"), "equal-texts")
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    if narrow.groupBy("digest").count().filter("count > 1").isEmpty():
        found = lookup(rows.drop("text"), narrow, "digest", "group_size")
    else:
        by_text = classes.drop("digest")
        found = lookup(rows, by_text, "text", "group_size")
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "digest",
    )


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row per distinct text, all columns unchanged.

    The row with the largest id stays, one of those that repeat it with the text; a null
    text is empty, and a null id is less than others.
    """
    winners = classes_of_equal_texts(docs, id_col, text_col).select(
        F.col("keep_id").alias("__id"), F.col("digest").alias("__digest")
    )
    wins = F.col(id_col).eqNullSafe(F.col("__id")) & (
        sha256(whole_text(text_col)) == F.col("__digest")
    )
    return one_row_each(docs, id_col, text_col).join(winners, wins, "left_semi")
