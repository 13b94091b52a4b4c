"""Analytics over collections of publications, on Spark."""

from pubweave.operators.classify import (
    classify_data,
    keyword_scores,
    keywords_present,
)
from pubweave.operators.search import newest_first, search_papers, select_corpus
from pubweave.operators.upsert import merge_publications, stage_publications
from pubweave.operators.words import get_top_words, get_top_words_by_tag
from pubweave.plans.etl import get_papers, run_etl, run_report
from pubweave.plans.marts import build_marts, write_marts
from pubweave.sources.atom import read_atom
from pubweave.sources.publications import (
    load_publications,
    read_publications,
    save_publications,
)
from pubweave.sources.raw import load_raw_data, save_raw_data

__all__ = [
    "build_marts",
    "classify_data",
    "get_papers",
    "get_top_words",
    "get_top_words_by_tag",
    "keyword_scores",
    "keywords_present",
    "load_publications",
    "load_raw_data",
    "merge_publications",
    "newest_first",
    "read_atom",
    "read_publications",
    "run_etl",
    "run_report",
    "save_publications",
    "save_raw_data",
    "search_papers",
    "select_corpus",
    "stage_publications",
    "write_marts",
]
