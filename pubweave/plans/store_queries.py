"""Queries that run the stages through files: landed pages, raw snapshot, store, marts.

Everything is written to new folders below the session's shared scratch folder.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pubweave.operators.classify import classify_data
from pubweave.operators.upsert import new_papers_only, stage_publications
from pubweave.plans.etl import run_etl, run_report
from pubweave.plans.marts import MARTS, by_count_order, write_marts
from pubweave.schemas import RAW_SCHEMA
from pubweave.sources import files, sample_tables as sample
from pubweave.sources.atom import read_atom
from pubweave.sources.publications import (
    load_publications,
    read_publications,
    save_publications,
)
from pubweave.sources.raw import load_raw_data, save_raw_data

Query = Callable[[SparkSession, str], DataFrame]

def _folder(spark: SparkSession) -> str:
    return f"{files.shared_scratch(spark)}/queries/{uuid.uuid4().hex}"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.raw_papers(spark, sf_dir).select(*RAW_SCHEMA.names)


def _two_saves(spark: SparkSession, sf_dir: str) -> tuple[str, list[dict]]:
    """A store after a first batch of papers and a second one that repeats, updates
    and adds some; what either save reported."""
    store = _folder(spark)
    papers = sample.raw_papers(spark, sf_dir).withColumn("tag", F.col("lang"))
    turns = sample.conversation_turns(spark, sf_dir)
    first = save_publications(papers, store)
    second = save_publications(sample.second_batch(papers, turns), store)
    return store, [first, second]


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two saves leave, as it is loaded."""
    store, _ = _two_saves(spark, sf_dir)
    return load_publications(spark, store).drop("ingested_at")


def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the two saves reported."""
    _, reports = _two_saves(spark, sf_dir)
    return spark.createDataFrame(
        [(n, r["inserted"], r["updated"], r["skipped"]) for n, r in enumerate(reports, 1)],
        "save int, inserted long, updated long, skipped long",
    )


def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    save_raw_data(_raw(spark, sf_dir), "papers", folder)
    return load_raw_data(spark, "papers", folder)


def _landing(spark: SparkSession, sf_dir: str) -> str:
    """A folder of Atom pages with every paper as an entry, about 100 to a page."""
    folder = _folder(spark)
    raw = _raw(spark, sf_dir)
    pages = raw.count() // 100 + 1
    page = F.pmod(F.hash("id"), F.lit(pages))
    entries = raw.select(page.alias("page"), sample.atom_entry().alias("entry"))
    feed = F.concat(
        F.lit("<feed>\n"), F.array_join(F.collect_list("entry"), "\n"), F.lit("\n</feed>")
    )
    entries.groupBy("page").agg(feed.alias("value")).write.partitionBy("page").text(folder)
    return folder


def atom_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_atom(spark, _landing(spark, sf_dir))


def etl_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages through the whole run, loaded from the store."""
    folder = _folder(spark)
    run_etl(spark, _landing(spark, sf_dir), f"{folder}/store", f"{folder}/raw")
    return load_publications(spark, f"{folder}/store").select(
        "paper_id", "title", "authors", "categories", "published_date", "updated_date", "tag"
    )


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classified papers after a save."""
    store = _folder(spark)
    save_publications(classify_data(sample.raw_papers(spark, sf_dir)), store)
    return read_publications(spark, store)


def _mart(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = write_marts(_stored(spark, sf_dir), _folder(spark), [name])
        return spark.read.parquet(paths[name])

    return query


def load_store_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One year of the store: its months only are read."""
    store, _ = _two_saves(spark, sf_dir)
    return load_publications(spark, store, year=2022).drop("ingested_at")


def load_absent_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers of a batch that an absent store does not hold, by number: all of them.

    Its typed empty relation takes part in the plan like any store.
    """
    known = read_publications(spark, f"{_folder(spark)}/none")
    staged = stage_publications(sample.raw_papers(spark, sf_dir).withColumn("tag", F.col("lang")))
    return new_papers_only(staged, known).select("paper_id", "title", "tag")


def raw_absent_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw papers after those of a snapshot that is not there: a typed relation without rows."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)
        absent = load_raw_data(spark, "none", _folder(spark))
    return absent.unionByName(_raw(spark, sf_dir))


def etl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every stage of a run reports."""
    folder = _folder(spark)
    stats = run_etl(spark, _landing(spark, sf_dir), f"{folder}/store", f"{folder}/raw")
    names = ["fetched", "loaded", "classified", "inserted", "updated", "skipped"]
    return spark.createDataFrame(
        [tuple(stats[name] for name in names)], ", ".join(f"{name} long" for name in names)
    )


def _report(name: str, order: Callable[[DataFrame], DataFrame] | None = None) -> Query:
    """A table of the report that collects papers itself, there being no snapshot yet."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _folder(spark)
        paths = run_report(
            spark, _landing(spark, sf_dir), f"{folder}/marts", f"{folder}/store", f"{folder}/raw"
        )
        table = spark.read.parquet(paths[name])
        return order(table) if order else table

    return query


def store_queries() -> dict[str, Query]:
    found = {
        f.__name__: f
        for f in (
            store_round_trip, store_counts, raw_round_trip, atom_files, etl_papers,
            load_store_year, load_absent_store, raw_absent_snapshot, etl_counts,
        )
    }
    found |= {f"mart_{name}": _mart(name) for name in MARTS}
    return found | {
        "report_months": _report("pubs_by_month"),
        # As the bar chart shows them.
        "report_authors": _report("top_authors", by_count_order),
    }
