"""Landed Atom pages as raw papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pubweave.functions.columns import paper_id_from_link, trim_field
from pubweave.schemas import ATOM_ENTRY_SCHEMA, RAW_SCHEMA

ENTRY_OPTIONS = {"rowTag": "entry", "attributePrefix": "_"}


def read_atom(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw papers, one per ``<entry>``, of all Atom files under ``path``.

    Pages are read in parallel; entries on overlapping pages are not merged.
    """
    reader = spark.read.format("xml").options(**ENTRY_OPTIONS)
    return entries_to_raw(reader.schema(ATOM_ENTRY_SCHEMA).load(path))


def entries_to_raw(entries: DataFrame) -> DataFrame:
    """Project parsed entries onto the raw layout.

    Of a repeated child that should be single, the first one counts.
    """
    link = _first("id")
    names = F.transform("author", lambda author: trim_field(author["name"]))
    terms = F.transform("category", lambda category: category["_term"])
    return entries.select(
        paper_id_from_link(link).alias("id"),
        link.alias("link"),
        _first("title").alias("title"),
        _joined(names).alias("authors"),
        _first("summary").alias("abstract"),
        _joined(terms).alias("categories"),
        _first("published").alias("published_date"),
        _first("updated").alias("updated_date"),
    )


def empty_raw(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RAW_SCHEMA)


def _first(child: str) -> Column:
    return trim_field(F.get(child, F.lit(0)))


def _joined(items: Column) -> Column:
    # array_join skips nulls, so authors without name leave no trace.
    return F.coalesce(F.array_join(items, "; "), F.lit(""))
