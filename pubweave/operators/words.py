"""Most frequent words of abstracts, overall and per tag.

Words are exploded inside the scan stage and counted with map-side partial
aggregation, so a frequent word or a dominant tag costs one row per task in the
shuffle, not one row per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from pubweave.functions.text import countable_words, sql_text
from pubweave.functions.vocabulary import (
    ABSTRACT_STOPWORDS,
    BY_TAG_STOPWORDS,
    FALLBACK_TAG,
    OVERALL_STOPWORDS,
    SNOWBALL_STOPWORDS,
)
from pubweave.operators.search import first_rows
from pubweave.schemas import require_columns

#: Stop lists of so many bytes are literals, and of so many are broadcast; a word counts
#: with what a row takes besides it.
LITERAL_BYTES = 64 * 1024
BROADCAST_BYTES = 8 * 1024 * 1024
ROW_BYTES = 64


def paper_words(df: DataFrame, *keep: str) -> DataFrame:
    """One row (*keep, word) per countable word occurrence."""
    return df.filter(F.col("abstract").isNotNull()).select(
        *keep, F.explode(countable_words(F.col("abstract"))).alias("word")
    )


def drop_stopwords(rows: DataFrame, *lists: Iterable[str]) -> DataFrame:
    """Rows whose word is in none of the lists.

    Vocabulary of a few hundred words travels as literals and is looked up inside
    generated code, which beats a join.  Lists of more than ``LITERAL_BYTES`` are a table
    and an anti-join, broadcast up to ``BROADCAST_BYTES``.
    """
    stop = sorted({word for words_ in lists for word in words_})
    size = sum(len(word.encode()) + ROW_BYTES for word in stop)
    if not stop:
        return rows
    if size <= LITERAL_BYTES:
        return rows.filter(f"word NOT IN ({', '.join(map(sql_text, stop))})")
    table = rows.sparkSession.createDataFrame([(word,) for word in stop], "word string")
    if size <= BROADCAST_BYTES:
        table = F.broadcast(table)
    return rows.join(table, "word", "left_anti").select(*rows.columns)


def most_frequent(counts: DataFrame, n: int, key: str = "word") -> DataFrame:
    """First ``n`` rows by descending count, ties by key in byte order."""
    return first_rows(counts, [F.desc("n"), F.asc(key)], n)


def get_top_words(
    df: DataFrame, n: int = 30, stopwords: Iterable[str] = OVERALL_STOPWORDS
) -> DataFrame:
    """The ``n`` most frequent words (word, n) of all abstracts."""
    require_columns(df, ["abstract"])
    return most_frequent(_counts_without(paper_words(df), SNOWBALL_STOPWORDS, stopwords), n)


def get_top_words_by_tag(
    df: DataFrame, n: int = 5, stopwords: Iterable[str] = BY_TAG_STOPWORDS
) -> DataFrame:
    """The ``n`` most frequent words (tag, word, n) of every topic tag."""
    require_columns(df, ["abstract", "tag"])
    tagged = df.filter(_has_topic())
    counts = _counts_without(paper_words(tagged, "tag"), SNOWBALL_STOPWORDS, stopwords)
    return _first_per_tag(counts, n).drop("rank")


def count_words_by_tag(df: DataFrame) -> DataFrame:
    """Counts (tag, word, n) with only the stop words both reports share removed.

    One pass over the text that both ``*_from_counts`` reports can start from.
    The null tag is kept as a group of its own.
    """
    require_columns(df, ["abstract", "tag"])
    return _counts_without(paper_words(df, "tag"), SNOWBALL_STOPWORDS, ABSTRACT_STOPWORDS)


def top_words_from_counts(
    counts: DataFrame, n: int = 30, stopwords: Iterable[str] = OVERALL_STOPWORDS
) -> DataFrame:
    """``get_top_words`` on the result of ``count_words_by_tag``."""
    totals = drop_stopwords(counts, stopwords).groupBy("word").agg(F.sum("n").alias("n"))
    return most_frequent(totals, n)


def top_words_by_tag_from_counts(
    counts: DataFrame, n: int = 5, stopwords: Iterable[str] = BY_TAG_STOPWORDS
) -> DataFrame:
    """``get_top_words_by_tag`` on the result of ``count_words_by_tag``.

    Adds ``rank``, the position of the word within its tag.
    """
    return _first_per_tag(drop_stopwords(counts.filter(_has_topic()), stopwords), n)


def _has_topic():
    return F.col("tag").isNotNull() & (F.col("tag") != FALLBACK_TAG)


def _count(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _counts_without(rows: DataFrame, *lists: Iterable[str]) -> DataFrame:
    """Counts of ``rows`` by all their columns, without stop words.

    Built-in lists keep words from being counted at all; a caller's, which may need a
    join, is applied to the distinct words.
    """
    built_in, given = lists[0], lists[1:]
    return drop_stopwords(_count(drop_stopwords(rows, built_in), *rows.columns), *given)


def _first_per_tag(counts: DataFrame, n: int) -> DataFrame:
    # The filter on row_number lets Spark cut every task's rows to n per tag
    # before the shuffle by tag.
    order = Window.partitionBy("tag").orderBy(F.desc("n"), F.asc("word"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= n
    )
