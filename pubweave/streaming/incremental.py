"""The collection run over files landed since the last time.

Structured Streaming remembers which files were processed, so a scheduled run
reads only new pages.  A batch that is repeated after a failure does no harm:
papers that are stored with the same update date are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pubweave.operators.classify import classify_data
from pubweave.operators.search import select_corpus
from pubweave.schemas import ATOM_ENTRY_SCHEMA
from pubweave.sources.atom import ENTRY_OPTIONS, entries_to_raw
from pubweave.sources.publications import save_publications


def stream_atom(
    spark: SparkSession, landing: str, files_per_batch: int | None = None
) -> DataFrame:
    """Raw papers of Atom files as they land."""
    options = dict(ENTRY_OPTIONS)
    if files_per_batch:
        options["maxFilesPerTrigger"] = str(files_per_batch)
    reader = spark.readStream.format("xml").options(**options)
    return entries_to_raw(reader.schema(ATOM_ENTRY_SCHEMA).load(landing))


def run_incremental_etl(
    spark: SparkSession,
    landing: str,
    store: str,
    progress: str,
    query: Column | str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Classify and store all papers landed since ``progress`` was last written,
    then stop."""
    papers = stream_atom(spark, landing, files_per_batch)
    chosen = select_corpus(papers) if query is None else papers.filter(query)

    def save(batch: DataFrame, _: int) -> None:
        save_publications(batch, store)

    return (
        classify_data(chosen)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
