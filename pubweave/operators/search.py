"""Selection of papers by corpus, text, category and year, and their order."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from pubweave.functions.columns import FIELD_SPACE, between_years, list_items
from pubweave.functions.text import WORD, escaped, string_array
from pubweave.functions.vocabulary import (
    CORPUS_CATEGORIES,
    CORPUS_TERMS,
    CORPUS_YEARS,
)

# Never part of a search text, so LIKE patterns have no escape sequences.
_NO_ESCAPE = "\u0001"

def in_years(df: DataFrame, column: str, first: int, last: int) -> Column:
    """Range predicate in UTC on a date column of text or of any date type."""
    return between_years(F.col(column), first, last, df.schema[column].dataType)


def select_corpus(
    df: DataFrame,
    categories: Iterable[str] = CORPUS_CATEGORIES,
    terms: Iterable[str] = CORPUS_TERMS,
    years: tuple[int, int] = CORPUS_YEARS,
) -> DataFrame:
    """Papers of some category that mention any term and were published in
    the years, inclusive; years beyond 1 and 9998 leave that side open.  Terms match
    literally, as whole words in any text field, ignoring case."""
    pattern = f"(?i)(?<![{WORD}])(?:{'|'.join(map(escaped, terms))})(?![{WORD}])"
    mentions = reduce(or_, (
        F.coalesce(F.col(field).rlike(pattern), F.lit(False))
        for field in ("title", "abstract", "authors")
    ))
    in_category = F.arrays_overlap(
        list_items(F.col("categories")), string_array(categories)
    )
    return df.filter(in_years(df, "published_date", *years) & in_category & mentions)


def newest_first(df: DataFrame, n: int | None, key: str = "id") -> DataFrame:
    """The ``n`` papers published last; all of them, unordered, if ``None``."""
    if n is None:
        return df
    count = as_integer(n)
    if count is None or count < 1:
        return df.limit(0)
    return first_rows(df, [F.desc_nulls_last("published_date"), F.asc(key)], count)


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order, lazily for any ``n``.

    Spark keeps a top-k per task up to spark.sql.execution.topKSortFallbackThreshold
    rows and sorts by ranges, spilling, beyond that.
    """
    return df.orderBy(*order).limit(n)


def search_papers(
    df: DataFrame, query: str | None = None, year: int | None = None
) -> DataFrame:
    """Papers whose title or abstract matches a regular expression, ignoring
    case, optionally of one publication year."""
    found = df
    if query is not None:
        found = found.filter(reduce(or_, (
            F.coalesce(F.lower(F.col(field)).rlike(query.lower()), F.lit(False))
            for field in ("title", "abstract")
        )))
    if year is not None:
        found = found.filter(in_years(df, "published_date", int(year), int(year)))
    return found


def filter_publications(
    df: DataFrame,
    year: Any = None,
    category: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """Conjunction of optional filters; unusable values mean no filter.

    ``category`` and ``text`` are case-insensitive LIKE substrings, so ``%`` and
    ``_`` in them are wildcards.
    """
    conditions = []
    whole_year = as_integer(year)
    if whole_year is not None:
        conditions.append(in_years(df, "published_date", whole_year, whole_year))
    if pattern := _substring(category):
        conditions.append(_contains("categories", pattern))
    if pattern := _substring(text):
        conditions.append(_contains("title", pattern) | _contains("abstract", pattern))
    return df.filter(reduce(and_, conditions)) if conditions else df


def latest_publications(df: DataFrame, limit: Any = None) -> DataFrame:
    """Order by update, then publication, newest first; nulls and ties last.

    A positive ``limit`` keeps the first rows; anything else keeps all.
    """
    order = [
        F.desc_nulls_last("updated_date"),
        F.desc_nulls_last("published_date"),
        F.asc("paper_id"),
    ]
    count = as_integer(limit)
    if count is None or count < 1:
        return df.orderBy(*order)
    return first_rows(df, order, count)


def as_integer(value: Any) -> int | None:
    """Whole part of a number or numeric text, else ``None``."""
    try:
        return int(float(value))
    except (TypeError, ValueError, OverflowError):
        return None


def _substring(value: str | None) -> str | None:
    trimmed = (value or "").strip(FIELD_SPACE).lower()
    return f"%{trimmed}%" if trimmed else None


def _contains(column: str, pattern: str) -> Column:
    return F.like(F.lower(F.col(column)), F.lit(pattern), F.lit(_NO_ESCAPE))
