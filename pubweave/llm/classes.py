"""Classes of documents with equal sets, for the near-duplicate operators.

A class has a number of its own, so that rows which share a document id are never
taken for each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pubweave.llm.common import saved

#: Lists of classes up to this size are broadcast, by what a row of one takes in memory.
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 64


def document_classes(profile: DataFrame) -> DataFrame:
    """cls, digest, n (rows), and doc_id and mark of the row with the least id of each digest.

    ``profile`` has doc_id, mark of the text, and digest of the set; ids are not null.
    """
    grouped = profile.groupBy("digest").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "mark")).alias("pick")
    )
    return saved(
        grouped.select(
            F.monotonically_increasing_id().alias("cls"), "digest", "n",
            "pick.doc_id", "pick.mark",
        ),
        "classes",
    )


def _picked(classes: DataFrame) -> DataFrame:
    return classes.select(
        "cls", F.col("doc_id").alias("__i"), F.col("mark").alias("__m"),
        F.col("digest").alias("__d"),
    )


def representatives(profile: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """cls and ``columns`` of one row of every class."""
    same = (
        (F.col("__i") == F.col("doc_id")) & (F.col("__m") == F.col("mark"))
        & (F.col("__d") == F.col("digest"))
    )
    found = profile.join(_picked(classes), same).select("cls", *columns)
    return saved(found.dropDuplicates(["cls"]), "representatives")


def class_texts(rows: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and text of the classes in column ``cls`` of ``wanted``; ``rows`` has doc_id,
    mark and text."""
    listed = _picked(classes).drop("__d").join(wanted.select("cls").distinct(), "cls")
    listed = saved(listed, "wanted-texts")
    if listed.count() * ROW_BYTES <= BROADCAST_BYTES:
        # A short list visits the texts; beyond that, texts are shuffled.
        listed = F.broadcast(listed)
    same = (F.col("__i") == F.col("doc_id")) & (F.col("__m") == F.col("mark"))
    return saved(rows.join(listed, same).select("cls", "text").dropDuplicates(["cls"]), "texts")


def same_document(profile: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of the classes in which rows with one id stand."""
    repeated = profile.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    held = profile.join(
        repeated.select(F.col("doc_id").alias("__i")), F.col("__i") == F.col("doc_id")
    )
    known = held.select("doc_id", F.col("digest").alias("__d")).distinct().join(
        classes.select("digest", "cls"), F.col("__d") == F.col("digest")
    ).select("doc_id", "cls")
    first = known.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("last"))
    first = first.filter("a < last").select(F.col("doc_id").alias("__i"), "a")
    return known.join(first, F.col("__i") == F.col("doc_id")).select(
        "a", F.col("cls").alias("b")
    ).filter("a <> b")


def class_components(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """digest, n and component_id, the least document id of the class's component.

    ``labels`` has id (a class) and component of the classes with links.
    """
    known = classes.join(labels, classes["cls"] == labels["id"], "left").select(
        "digest", "n", "doc_id", F.coalesce("component", "cls").alias("component")
    )
    known = saved(known, "class-components")
    least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return saved(
        known.join(least, "component").select("digest", "n", "component_id"), "verdicts"
    )
