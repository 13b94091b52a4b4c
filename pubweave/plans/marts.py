"""Report tables over the stored publications."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from pubweave.operators.trends import (
    author_counts,
    authors_per_paper_from_paper_counts,
    data_flag,
    days_from_counts,
    months_from_days,
    paper_counts,
    share_from_counts,
    tag_counts_from_share,
    top_authors,
    weekdays_from_days,
)
from pubweave.operators.words import (
    count_words_by_tag,
    top_words_by_tag_from_counts,
    top_words_from_counts,
)
from pubweave.sources.files import overwrite_parquet

WORD_COUNTS = "word_counts"
PAPER_COUNTS = "paper_counts"

#: Tables that others start from: one scan of the texts, one of dates, tags and authors.
BASES = {WORD_COUNTS: count_words_by_tag, PAPER_COUNTS: paper_counts}

#: Report tables that start from the publications themselves.
_FROM_PUBLICATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "has_data": data_flag,
    "top_authors": top_authors,
    "author_counts": author_counts,
}

#: The others, and the base table each one starts from.
_FROM_BASES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "pubs_by_day": (PAPER_COUNTS, days_from_counts),
    "pubs_by_month": (PAPER_COUNTS, lambda counts: months_from_days(days_from_counts(counts))),
    "pubs_by_weekday": (PAPER_COUNTS, lambda counts: weekdays_from_days(days_from_counts(counts))),
    "authors_per_paper": (PAPER_COUNTS, authors_per_paper_from_paper_counts),
    "tag_counts": (PAPER_COUNTS, lambda counts: tag_counts_from_share(share_from_counts(counts))),
    "tag_share": (PAPER_COUNTS, share_from_counts),
    "top_words": (WORD_COUNTS, top_words_from_counts),
    "topic_words": (
        WORD_COUNTS, lambda counts: by_tag_order(top_words_by_tag_from_counts(counts))
    ),
}

MARTS = [*_FROM_PUBLICATIONS, *_FROM_BASES]


def build_marts(
    pubs: DataFrame, stored: Mapping[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """All report tables, lazily.

    Every table reads only the columns it needs, so the publications are not
    cached.  Those in ``BASES`` are the start of others; pass stored ones in
    ``stored`` to have texts, dates, tags and author lists read for them once.
    """
    bases = {name: make(pubs) for name, make in BASES.items()} | dict(stored or {})
    return {name: make(pubs) for name, make in _FROM_PUBLICATIONS.items()} | {
        name: make(bases[base]) for name, (base, make) in _FROM_BASES.items()
    }


def by_tag_order(topic_words: DataFrame) -> DataFrame:
    """Rows in the order a chart with one panel per tag shows them."""
    return topic_words.orderBy("tag", "rank")


def by_count_order(table: DataFrame) -> DataFrame:
    """Rows in the order a bar chart shows them, smallest count first; ties by the
    other columns."""
    return table.orderBy("n", *[c for c in table.columns if c != "n"])


def write_marts(
    pubs: DataFrame, directory: str, names: Iterable[str] | None = None
) -> dict[str, str]:
    """Write the report tables ``names``, by default all, and the base tables they start
    from, as Parquet; returns their paths.

    ``pubs`` needs no order: give it what ``read_publications`` returns.
    """
    spark: SparkSession = pubs.sparkSession
    chosen = MARTS if names is None else list(names)
    paths: dict[str, str] = {}

    def write(name: str, table: DataFrame) -> None:
        paths[name] = f"{directory}/{name}"
        overwrite_parquet(table, paths[name])

    needed = {_FROM_BASES[name][0] for name in chosen if name in _FROM_BASES}
    for base in sorted(needed):
        write(base, BASES[base](pubs))
    stored = {base: spark.read.parquet(paths[base]) for base in needed}
    tables = build_marts(pubs, stored)
    for name in chosen:
        write(name, tables[name])
    return paths
