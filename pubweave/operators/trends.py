"""Counts of papers by date, author and tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pubweave.functions.columns import (
    author_count,
    author_names,
    day_bucket,
    month_bucket,
    utc_moment,
    weekday_index,
    weekday_label,
    weekday_label_ru,
)
from pubweave.operators.words import most_frequent


def _count_by(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _published(pubs: DataFrame) -> Column:
    """Publication moment in UTC."""
    column = F.col("published_date")
    kind = pubs.schema["published_date"].dataType
    return utc_moment(column, kind) if isinstance(kind, T.TimestampType) else column


def papers_by_day(pubs: DataFrame) -> DataFrame:
    """(day, n) in date order; papers without date are the last row."""
    days = _count_by(pubs, day_bucket(_published(pubs)).alias("day"))
    return days.orderBy(F.asc_nulls_last("day"))


def papers_by_month(pubs: DataFrame) -> DataFrame:
    """(month, n) in date order; papers without date are the last row."""
    months = _count_by(pubs, month_bucket(_published(pubs)).alias("month"))
    return months.orderBy(F.asc_nulls_last("month"))


def papers_by_weekday(pubs: DataFrame) -> DataFrame:
    """(weekday_idx, weekday, weekday_ru, n), Monday first, absent days left out."""
    dated = pubs.filter(F.col("published_date").isNotNull())
    counts = _count_by(dated, weekday_index(_published(pubs)).alias("weekday_idx"))
    return _weekday_rows(counts)


def months_from_days(days: DataFrame) -> DataFrame:
    """``papers_by_month`` from the result of ``papers_by_day``."""
    months = days.groupBy(month_bucket(F.col("day")).alias("month")).agg(
        F.sum("n").alias("n")
    )
    return months.orderBy(F.asc_nulls_last("month"))


def weekdays_from_days(days: DataFrame) -> DataFrame:
    """``papers_by_weekday`` from the result of ``papers_by_day``."""
    dated = days.filter(F.col("day").isNotNull())
    return _weekday_rows(
        dated.groupBy(weekday_index(F.col("day")).alias("weekday_idx")).agg(
            F.sum("n").alias("n")
        )
    )


def _weekday_rows(counts: DataFrame) -> DataFrame:
    index = F.col("weekday_idx")
    return counts.select(
        index,
        weekday_label(index).alias("weekday"),
        weekday_label_ru(index).alias("weekday_ru"),
        "n",
    ).orderBy("weekday_idx")


def author_rows(pubs: DataFrame) -> DataFrame:
    """One row (paper_id, authors) per listed author; blank names stay."""
    return pubs.filter(F.col("authors").isNotNull()).select(
        "paper_id", F.explode(author_names(F.col("authors"))).alias("authors")
    )


def top_authors(pubs: DataFrame, n: int = 10) -> DataFrame:
    """(authors, n) of the authors listed most often."""
    return most_frequent(_count_by(author_rows(pubs), "authors"), n, "authors")


def author_counts(pubs: DataFrame) -> DataFrame:
    """(paper_id, n_authors) of papers with an author field."""
    return pubs.filter(F.col("authors").isNotNull()).select(
        "paper_id", author_count(F.col("authors")).alias("n_authors")
    )


def authors_per_paper_histogram(pubs: DataFrame) -> DataFrame:
    """(n_authors, n): how many papers have how many authors."""
    return authors_per_paper_from_counts(author_counts(pubs))


def authors_per_paper_from_counts(counts: DataFrame) -> DataFrame:
    """``authors_per_paper_histogram`` from the result of ``author_counts``."""
    return _count_by(counts, "n_authors").orderBy("n_authors")


def tag_counts(pubs: DataFrame) -> DataFrame:
    """(tag, n), most frequent first; untagged papers are left out."""
    tagged = pubs.filter(F.col("tag").isNotNull())
    return _count_by(tagged, "tag").orderBy(F.desc("n"), F.asc("tag"))


def tag_counts_from_share(shares: DataFrame) -> DataFrame:
    """``tag_counts`` from the result of ``tag_share``."""
    tagged = shares.filter(F.col("tag").isNotNull()).select("tag", "n")
    return tagged.orderBy(F.desc("n"), F.asc("tag"))


def tag_share(papers: DataFrame) -> DataFrame:
    """(tag, n, percentage of all papers, rounded half to even to one digit)."""
    return _shares(_count_by(papers, "tag"))


def _shares(counts: DataFrame) -> DataFrame:
    # The window sees one row per distinct tag, not one per paper.
    total = F.sum("n").over(Window.partitionBy())
    share = F.bround(F.col("n") / total * 100, 1)
    return counts.select("tag", "n", share.alias("percentage")).orderBy(
        F.desc("n"), F.asc_nulls_last("tag")
    )


def paper_counts(pubs: DataFrame) -> DataFrame:
    """(kind, day, tag, n_authors, n): papers per day, per tag and per number of authors.

    One scan counts all three; ``kind`` names the column that a row is about, and the
    others are null there.
    """
    narrow = pubs.select(
        day_bucket(_published(pubs)).alias("day"), "tag",
        F.when(F.col("authors").isNotNull(), author_count(F.col("authors"))).alias("n_authors"),
    )
    columns = [F.col(name) for name in narrow.columns]
    counts = narrow.groupingSets([[c] for c in columns], *columns).agg(
        F.grouping_id().alias("absent"), F.count(F.lit(1)).alias("n")
    )
    # A bit is set for every column that a row is not grouped by.
    kind = F.when(F.col("absent") == 0b011, "day").when(F.col("absent") == 0b101, "tag")
    return counts.select(kind.otherwise("n_authors").alias("kind"), *columns, "n")


def _counted(counts: DataFrame, kind: str) -> DataFrame:
    return counts.filter(F.col("kind") == kind).select(kind, "n")


def days_from_counts(counts: DataFrame) -> DataFrame:
    """``papers_by_day`` from the result of ``paper_counts``."""
    return _counted(counts, "day").orderBy(F.asc_nulls_last("day"))


def share_from_counts(counts: DataFrame) -> DataFrame:
    """``tag_share`` from the result of ``paper_counts``."""
    return _shares(_counted(counts, "tag"))


def authors_per_paper_from_paper_counts(counts: DataFrame) -> DataFrame:
    """``authors_per_paper_histogram`` from the result of ``paper_counts``."""
    listed = _counted(counts, "n_authors").filter(F.col("n_authors").isNotNull())
    return listed.orderBy("n_authors")


def data_flag(pubs: DataFrame) -> DataFrame:
    """One row (has_data): whether there is any paper.

    Reads one row of a plain table; an ordered input has to be ordered first.
    """
    return pubs.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_data"))


def has_data(pubs: DataFrame) -> bool:
    return not pubs.isEmpty()
