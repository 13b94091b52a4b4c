"""Staging of classified papers and their merge into stored publications.

The newer record wins: a staged paper replaces a stored one if either lacks an
update date or the staged date is strictly later; a paper not stored yet is
inserted; everything else is skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pubweave.functions.columns import (
    category_names,
    normalize_list,
    parse_time,
    utc_moment,
    utc_now,
)
from pubweave.schemas import (
    PUBLICATIONS_SCHEMA,
    RAW_SCHEMA,
    STAGED_SCHEMA,
    require_columns,
)

INSERT, UPDATE, KEEP = "insert", "update", "keep"

#: What a merge needs to know about a stored paper to decide and to carry over.
DECISION_COLUMNS = ["paper_id", "updated_date", "tag", "umap_x", "umap_y"]

_CARRIED = ("umap_x", "umap_y")


def stage_publications(papers: DataFrame, strict: bool = True) -> DataFrame:
    """Classified papers in the staged layout; other columns are dropped.

    ``strict`` fails the job on a date text in no accepted format; otherwise
    such a date becomes null.
    """
    require_columns(papers, [*RAW_SCHEMA.names, "tag"])

    def moment(name: str) -> Column:
        column, kind = F.col(name), papers.schema[name].dataType
        if isinstance(kind, T.StringType):
            return parse_time(column, strict).alias(name)
        return utc_moment(column, kind).alias(name)

    return papers.select(
        F.col("id").cast("string").alias("paper_id"),
        F.col("link").cast("string").alias("link"),
        F.col("title").cast("string").alias("title"),
        normalize_list(F.col("authors")).alias("authors"),
        F.col("abstract").cast("string").alias("abstract"),
        category_names(F.col("categories")).alias("categories"),
        moment("published_date"),
        moment("updated_date"),
        F.col("tag").cast("string").alias("tag"),
    )


def newest_per_key(staged: DataFrame) -> DataFrame:
    """One row per paper_id, the last updated one, plus its number of ``copies``.

    The maximum over whole rows, update date first, is deterministic and is
    combined before the shuffle, so any number of copies of one paper leaves
    each task as a single row.
    """
    rest = [
        "updated_date",
        *(n for n in STAGED_SCHEMA.names if n not in ("paper_id", "updated_date")),
    ]
    newest = staged.groupBy("paper_id").agg(
        F.max(F.struct(*rest)).alias("newest"), F.count(F.lit(1)).alias("copies")
    )
    return newest.select("paper_id", "newest.*", "copies").select(
        *STAGED_SCHEMA.names, "copies"
    )


def valid_keys(staged: DataFrame) -> DataFrame:
    return staged.filter(F.col("paper_id").isNotNull() & (F.col("paper_id") != ""))


def new_papers_only(staged: DataFrame, stored: DataFrame) -> DataFrame:
    """Staged papers whose key is not stored."""
    return valid_keys(staged).join(stored.select("paper_id"), "paper_id", "left_anti")


def merge_publications(
    stored: DataFrame, staged: DataFrame, now: Column | None = None
) -> DataFrame:
    """The publications after merging ``staged``, plus the ``action`` per row.

    One shuffle of either side by paper_id.
    """
    p, s = stored.alias("p"), valid_keys(newest_per_key(staged)).alias("s")
    joined = p.join(s, F.col("p.paper_id") == F.col("s.paper_id"), "full_outer")
    resolved = joined.withColumn("action", _action())
    kept = F.col("action") == KEEP
    merged = [
        F.when(kept, F.col(f"p.{name}")).otherwise(_merged(name, now)).alias(name)
        for name in PUBLICATIONS_SCHEMA.names
    ]
    return resolved.select(*merged, "action")


def decide_changes(
    stored: DataFrame,
    batch: DataFrame,
    now: Column | None = None,
    carried: Sequence[str] = (),
    counted: bool = False,
) -> DataFrame:
    """New and updated publications of a deduplicated ``batch``, with ``action``.

    Reads only ``DECISION_COLUMNS`` of the stored side, and ``carried``, further
    columns of it to hand on.  A batch fresh from ``newest_per_key`` is not shuffled
    again.  ``counted`` adds the ``copies`` each row stands for, and the rest of the
    batch as rows that have nothing but those and the action.
    """
    p = stored.select(*DECISION_COLUMNS, *carried).alias("p")
    s = (batch if counted else valid_keys(batch)).alias("s")
    joined = s.join(p, F.col("p.paper_id") == F.col("s.paper_id"), "left_outer")
    usable = F.col("s.paper_id") != ""
    decided = joined.withColumn("action", F.when(usable, _action()).otherwise(KEEP))
    changes = F.col("action") != KEEP
    merged = {name: _merged(name, now) for name in PUBLICATIONS_SCHEMA.names}
    merged |= {name: F.col(name) for name in carried}
    if counted:
        columns = [F.when(changes, value).alias(name) for name, value in merged.items()]
        return decided.select(*columns, "action", "copies")
    columns = [value.alias(name) for name, value in merged.items()]
    changed = decided.filter(changes).select(*columns, "action")
    return changed.select(*PUBLICATIONS_SCHEMA.names, "action", *carried)


def count_actions(staged: DataFrame, stored: DataFrame) -> DataFrame:
    """One row (inserted, updated, skipped) for merging ``staged``.

    Only keys and update dates are shuffled.
    """
    batch = staged.groupBy("paper_id").agg(
        F.max("updated_date").alias("updated_date"), F.count(F.lit(1)).alias("copies")
    )
    p = stored.select("paper_id", "updated_date").alias("p")
    s = batch.alias("s")
    usable = F.col("s.paper_id") != ""
    decided = s.join(p, F.col("p.paper_id") == F.col("s.paper_id"), "left_outer")
    action = F.when(usable, _action())
    inserted, updated = F.count_if(action == INSERT), F.count_if(action == UPDATE)
    total = F.coalesce(F.sum("copies"), F.lit(0))
    return decided.agg(
        inserted.alias("inserted"),
        updated.alias("updated"),
        (total - inserted - updated).alias("skipped"),
    )


def _action() -> Column:
    """Action for a joined pair of stored ``p`` and staged ``s``."""
    fresh = (
        F.col("p.updated_date").isNull()
        | F.col("s.updated_date").isNull()
        | (F.col("s.updated_date") > F.col("p.updated_date"))
    )
    return (
        F.when(F.col("s.paper_id").isNull(), KEEP)
        .when(F.col("p.paper_id").isNull(), INSERT)
        .when(fresh, UPDATE)
        .otherwise(KEEP)
    )


def _merged(name: str, now: Column | None) -> Column:
    """Value of a column in an inserted or updated publication."""
    if name == "ingested_at":
        return utc_now() if now is None else now
    if name in _CARRIED:
        return F.col(f"p.{name}")
    if name == "tag":
        given = F.nullif(F.trim(F.col("s.tag")), F.lit(""))
        updated = F.coalesce(given, F.col("p.tag"))
        return F.when(F.col("action") == INSERT, F.col("s.tag")).otherwise(updated)
    return F.col(f"s.{name}")
