"""Queries over the sample tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pubweave.functions.columns import (
    category_names,
    normalize_list,
    paper_id_from_link,
    parse_time,
)
from pubweave.functions.text import clean_text
from pubweave.operators import search, trends, upsert, words
from pubweave.operators.classify import (
    classify_data,
    keyword_scores,
    keywords_present,
)
from pubweave.plans.marts import by_tag_order
from pubweave.plans.store_queries import store_queries
from pubweave.schemas import ATOM_ENTRY_SCHEMA, PUBLICATION_COLUMNS, RAW_SCHEMA
from pubweave.sources import sample_tables as sample
from pubweave.sources.atom import ENTRY_OPTIONS, entries_to_raw

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _REGISTRY[function.__name__.removesuffix("_")] = function
    return function


def all_queries() -> dict[str, Query]:
    return _REGISTRY | store_queries()


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the staged layout, tagged with their language."""
    raw = sample.raw_papers(spark, sf_dir)
    return upsert.stage_publications(raw.withColumn("tag", F.col("lang")))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store_and_batch(spark, sf_dir)[0]


def _store_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A publications table and a staged batch to merge into it."""
    staged = _staged(spark, sf_dir)
    return (
        sample.stored_publications(staged, sample.web_pages(spark, sf_dir)),
        sample.incoming_papers(staged, sample.conversation_turns(spark, sf_dir)),
    )


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_data(sample.raw_papers(spark, sf_dir))


# --- collection -----------------------------------------------------------


@_query
def atom_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers written as Atom entries, parsed and projected onto the raw layout."""
    raw = sample.raw_papers(spark, sf_dir)
    entry = F.from_xml(sample.atom_entry(), ATOM_ENTRY_SCHEMA.simpleString(), ENTRY_OPTIONS)
    return entries_to_raw(raw.select(entry.alias("entry")).select("entry.*"))


@_query
def pages_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources in one relation, nothing merged."""
    turns = sample.conversation_turns(spark, sf_dir).drop("turn")
    pages = sample.web_pages(spark, sf_dir).withColumnRenamed("paper_id", "id")
    papers = sample.raw_papers(spark, sf_dir).select("id", "title", "abstract")
    return sample.union_all(papers, pages, turns)


@_query
def corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = sample.raw_papers(spark, sf_dir)
    return search.select_corpus(papers).select(*RAW_SCHEMA.names)


@_query
def newest_first_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.newest_first(sample.event_log(spark, sf_dir), 100, "paper_id")


# --- normalisation --------------------------------------------------------


@_query
def paper_id_from_link_(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = sample.raw_papers(spark, sf_dir)
    return papers.select("id", paper_id_from_link(F.col("link")).alias("paper_id"))


@_query
def authors_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = sample.raw_papers(spark, sf_dir)
    return papers.select("id", normalize_list(F.col("authors")).alias("authors"))


@_query
def categories_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = sample.raw_papers(spark, sf_dir)
    return papers.select("id", category_names(F.col("categories")).alias("categories"))


@_query
def timestamps_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = sample.raw_papers(spark, sf_dir)
    return papers.select(
        "id",
        parse_time(F.col("published_date"), strict=True).alias("published_date"),
        parse_time(F.col("updated_date")).alias("updated_date"),
    )


@_query
def staged_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir)


# --- search ---------------------------------------------------------------


@_query
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = sample.raw_papers(spark, sf_dir)
    return search.search_papers(papers, "MAL.ARE|phish(ing|er)").select("id", "title")


@_query
def search_regex_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = sample.raw_papers(spark, sf_dir)
    found = search.search_papers(papers, "attack", 2024)
    return found.select("id", "title", "published_date")


def _load(spark: SparkSession, sf_dir: str, limit=None, **filters) -> DataFrame:
    stored = _stored(spark, sf_dir).select(*PUBLICATION_COLUMNS).drop("ingested_at")
    return search.latest_publications(search.filter_publications(stored, **filters), limit)


@_query
def load_publications_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir)


@_query
def load_all_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(
        spark, sf_dir, year=2023, category=" Cryptography and SECURITY ", text="Attack"
    )


@_query
def load_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir, year="2022").select("paper_id", "published_date")


@_query
def load_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir, limit=50)


@_query
def load_like_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir, text="mal_are%src").select("paper_id", "title")


@_query
def load_category_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code is no label: only unknown codes, stored as they are, match."""
    return _load(spark, sf_dir, category="zz.zz").select("paper_id", "categories")


# --- trends ---------------------------------------------------------------


@_query
def papers_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.papers_by_day(_stored(spark, sf_dir))


@_query
def papers_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.papers_by_month(_stored(spark, sf_dir))


@_query
def events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.papers_by_day(sample.event_log(spark, sf_dir))


@_query
def papers_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.papers_by_weekday(sample.event_log(spark, sf_dir))


@_query
def author_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.author_rows(_staged(spark, sf_dir))


@_query
def top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.top_authors(_staged(spark, sf_dir))


@_query
def top_event_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.top_authors(sample.event_log(spark, sf_dir))


@_query
def author_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.author_counts(_staged(spark, sf_dir))


@_query
def authors_per_paper_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.authors_per_paper_histogram(_staged(spark, sf_dir))


@_query
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.tag_counts(_classified(spark, sf_dir))


@_query
def tag_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.tag_share(_classified(spark, sf_dir))


@_query
def has_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.data_flag(_stored(spark, sf_dir))


# --- topics ---------------------------------------------------------------


@_query
def classify_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("id", "tag")


@_query
def keyword_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords_present(sample.raw_papers(spark, sf_dir))


@_query
def keyword_scores_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_scores(sample.raw_papers(spark, sf_dir))


# --- words ----------------------------------------------------------------


@_query
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.get_top_words(sample.raw_papers(spark, sf_dir))


@_query
def top_words_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.get_top_words(sample.web_pages(spark, sf_dir), 100)


@_query
def word_counts_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every countable word of every tag, not only the most frequent ones."""
    papers = sample.raw_papers(spark, sf_dir).withColumn("tag", F.col("lang"))
    return words.count_words_by_tag(papers)


@_query
def top_words_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.get_top_words_by_tag(_classified(spark, sf_dir))


@_query
def topic_words_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = words.count_words_by_tag(_classified(spark, sf_dir))
    return by_tag_order(words.top_words_by_tag_from_counts(counts, 10))


@_query
def clean_text_(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = sample.raw_papers(spark, sf_dir)
    return papers.select("id", clean_text(F.col("abstract")).alias("cleaned"))


# --- store ----------------------------------------------------------------


@_query
def newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.newest_per_key(_store_and_batch(spark, sf_dir)[1])


@_query
def new_papers_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = _store_and_batch(spark, sf_dir)
    found = upsert.new_papers_only(batch, stored)
    return found.select("paper_id", "link", "updated_date")


@_query
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.merge_publications(*_store_and_batch(spark, sf_dir)).drop("ingested_at")


@_query
def upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the inserted and updated rows, as the store writes them."""
    stored, batch = _store_and_batch(spark, sf_dir)
    changes = upsert.decide_changes(stored, upsert.newest_per_key(batch))
    return changes.drop("ingested_at")


@_query
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = _store_and_batch(spark, sf_dir)
    return upsert.count_actions(batch, stored)
