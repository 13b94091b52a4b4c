"""Landed Atom pages -> raw snapshot -> topic tags -> stored publications.

Run as a job with ``spark-submit pubweave/plans/etl.py --landing ... --store ...``;
a failed stage ends it with a non-zero exit code.
"""

from __future__ import annotations

import argparse
import logging
import sys
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from pubweave.operators.classify import classify_data
from pubweave.operators.search import newest_first, select_corpus
from pubweave.plans.marts import write_marts
from pubweave.sources import files
from pubweave.sources.atom import read_atom
from pubweave.sources.publications import read_publications, save_publications
from pubweave.sources.raw import DEFAULT_DIR, DEFAULT_NAME, load_raw_data, save_raw_data

log = logging.getLogger(__name__)


def get_papers(
    spark: SparkSession,
    landing: str | list[str],
    query: Column | str | None = None,
    max_results: int | None = None,
) -> DataFrame:
    """Landed papers of the default corpus, or those that satisfy the condition
    ``query``; of these the ``max_results`` newest, or all if it is ``None``."""
    papers = read_atom(spark, landing)
    chosen = select_corpus(papers) if query is None else papers.filter(query)
    return newest_first(chosen, max_results)


def run_etl(
    spark: SparkSession,
    landing: str | list[str],
    store: str | None = None,
    raw_dir: str = DEFAULT_DIR,
    raw_name: str = DEFAULT_NAME,
    query: Column | str | None = None,
    max_results: int | None = None,
) -> dict[str, Any]:
    """Collect, snapshot, classify and store; returns counts per stage: ``fetched``,
    ``loaded``, ``classified``, then what the store did.

    The snapshot is the only full write between scan and store, and the later
    stages read it back, so the pages are parsed once.  No count reads a text.
    """
    log.info("Collecting papers: query=%s, max_results=%s", query, max_results)
    snapshot = save_raw_data(
        get_papers(spark, landing, query, max_results), raw_name, raw_dir
    )
    log.info("Fetched %d papers, saved to %s", snapshot["rows"], snapshot["path"])
    return {"fetched": snapshot["rows"], "raw": snapshot} | store_snapshot(
        spark, store, raw_dir, raw_name
    )


def store_snapshot(
    spark: SparkSession,
    store: str | None = None,
    raw_dir: str = DEFAULT_DIR,
    raw_name: str = DEFAULT_NAME,
) -> dict[str, Any]:
    """Classify the papers of a raw snapshot and store them; returns counts."""
    raw = load_raw_data(spark, raw_name, raw_dir)
    loaded = raw.select().count()
    log.info("Loaded %d papers from the snapshot", loaded)
    stats = save_publications(classify_data(raw), store)
    # Every paper that reaches the store has been classified.
    classified = stats["inserted"] + stats["updated"] + stats["skipped"]
    log.info("Classified %d papers", classified)
    log.info(
        "Stored publications: inserted=%d, updated=%d, skipped=%d",
        stats["inserted"], stats["updated"], stats["skipped"],
    )
    return {"loaded": loaded, "classified": classified, **stats}


def run_report(
    spark: SparkSession,
    landing: str | list[str],
    marts: str,
    store: str | None = None,
    raw_dir: str = DEFAULT_DIR,
    raw_name: str = DEFAULT_NAME,
    max_results: int | None = None,
) -> dict[str, str]:
    """Bring the store up to the raw snapshot and write the report tables; returns
    their paths.  Papers are collected only if there is no snapshot yet."""
    if not files.exists(spark, f"{raw_dir}/{raw_name}"):
        papers = get_papers(spark, landing, max_results=max_results)
        save_raw_data(papers, raw_name, raw_dir)
    store_snapshot(spark, store, raw_dir, raw_name)
    return write_marts(read_publications(spark, store), marts)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Collect, classify and store papers")
    parser.add_argument("--landing", required=True, help="folder of Atom files")
    parser.add_argument("--store", help="folder of the publications table")
    parser.add_argument("--raw-dir", default=DEFAULT_DIR)
    parser.add_argument("--max-results", type=int, help="newest papers only (default: all)")
    parser.add_argument("--query", help="SQL condition replacing the default corpus")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="[%(asctime)s] %(message)s")
    spark = SparkSession.builder.appName("pubweave-etl").getOrCreate()
    try:
        run_etl(
            spark, args.landing, args.store, args.raw_dir,
            query=args.query or None, max_results=args.max_results,
        )
    except Exception:
        log.exception("Run failed")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
