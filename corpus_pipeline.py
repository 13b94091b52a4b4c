"""From raw documents to token ids of clean training data, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pubweave.llm.common import delete_tables, read_table, saved, tables_written
from pubweave.llm.decontaminate import drop_contaminated
from pubweave.llm.exact_dedup import drop_exact_copies
from pubweave.llm.minhash import drop_near_copies
from pubweave.llm.pieces import encode_pieces
from pubweave.llm.queries import piece_digests, tokenizer_path
from pubweave.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the largest id, of each text."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return drop_near_copies(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all documents left, and digests of them and of what they decode to."""
    encoded = encode_pieces(docs, tokenizer_path(spark, "piece_bpe_32k.model"))
    return piece_digests(encoded, "ids")


STAGES = [
    ("toxicity", toxicity),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("contamination", contamination),
    ("tokens", tokens),
]

#: Several stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again, and then
    its intermediate tables are deleted."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        first = tables_written()
        kept = stage(spark, docs, sf_dir)
        last = tables_written()
        docs = saved(kept, f"pipeline-{name}")
        delete_tables(spark, first, last)
    return docs
