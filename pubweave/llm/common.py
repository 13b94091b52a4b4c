"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pubweave.sources import files

#: Folder of the package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: A key is hot if it holds more than one in so many rows; there can be no
#: more hot keys than this, so a table of them may be broadcast.
HOT_SHARE = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and files.

    The cluster names it in ``spark.checkpoint.dir``; only a local session without that
    setting, as in a test, gets a temporary folder.
    """
    return f"{files.shared_scratch(spark)}/pubweave-llm"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders of the intermediate tables that this process has written, in order.
_WRITTEN: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here,
    and a lost executor costs no more than the task it ran."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """How many intermediate tables there have been so far, see delete_tables."""
    return len(_WRITTEN)


def delete_tables(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Delete the intermediate tables with these numbers, by default all.

    What an operator returns may still read its tables, so a job does this once it has
    written the result.
    """
    for path in _WRITTEN[first:last]:
        files.delete(spark, path)


def whole_text(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lookup(
    rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner"
) -> DataFrame:
    """``rows`` with the columns of ``table`` on an equal ``key``, safe for hot keys.

    ``table`` has one row per key and in ``weight`` the number of rows with that
    key.  There can be fewer than a thousand keys with more than a thousandth of
    all rows: these are broadcast, and their rows are not shuffled at all.
    ``rows`` is read twice if there are such keys.  ``how`` is inner or left; null
    is a key like others.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    mark = F.xxhash64(key)
    heavy = table.filter(F.col(weight) * HOT_SHARE > F.lit(total))
    marks = [row[0] for row in heavy.select(mark).collect()]
    columns = [c for c in table.columns if c != key]
    keyed = table.select(F.col(key).alias("__k"), *columns)
    same = F.col(key).eqNullSafe(F.col("__k"))
    if not marks:
        return rows.join(keyed, same, how).drop("__k")
    hot = rows.filter(mark.isin(marks)).join(
        F.broadcast(keyed.filter(F.xxhash64("__k").isin(marks))), same, how
    )
    cold = rows.filter(~mark.isin(marks)).join(
        keyed.filter(~F.xxhash64("__k").isin(marks)), same, how
    )
    return hot.unionByName(cold).drop("__k")


def text_mark(text_col: str) -> Column:
    """Tells rows that share an id, or have none, apart by their text."""
    return F.xxhash64(whole_text(text_col))


def without_rows(
    docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows of ``docs`` whose id and text are not among the doc_id and mark of ``dropped``."""
    listed = dropped.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (text_mark(text_col) == F.col("__mark"))
    return docs.join(listed, same, "left_anti")


def one_row_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one of the rows that repeat both id and text; a null text is empty.

    Only ids and hashes of texts are shuffled, unless there are such rows.
    """
    repeated = saved(
        docs.select(F.col(id_col).alias("__id"), text_mark(text_col).alias("__mark"))
        .groupBy("__id", "__mark").agg(F.count("*").alias("__n")).filter("__n > 1")
        .drop("__n"),
        "repeated-rows",
    )
    if repeated.isEmpty():
        return docs
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (text_mark(text_col) == F.col("__mark"))
    several = docs.join(repeated, same, "left_semi").withColumn("__text", whole_text(text_col))
    return docs.join(repeated, same, "left_anti").unionByName(
        several.dropDuplicates([id_col, "__text"]).drop("__text")
    )


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Prepare Python workers: documents are long, so batches are short, and the
    package is imported from where the driver has it, if it was not shipped."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, ROOT]))
