"""Relations that move through the library, as explicit Spark schemas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


#: One ``<entry>`` of a landed Atom page, as the XML reader delivers it.  Every
#: child may be repeated.
ATOM_ENTRY_SCHEMA = T.StructType([
    *(
        T.StructField(name, T.ArrayType(T.StringType()))
        for name in ("id", "title", "summary", "published", "updated")
    ),
    T.StructField("author", T.ArrayType(T.StructType(_strings("name")))),
    T.StructField("category", T.ArrayType(T.StructType(_strings("_term")))),
])

#: Collected papers: text only, list columns joined with "; ".
RAW_SCHEMA = T.StructType(_strings(
    "id", "link", "title", "authors", "abstract", "categories",
    "published_date", "updated_date",
))

#: Papers ready to be stored: list columns joined with ", ", dates typed.
STAGED_SCHEMA = T.StructType([
    *_strings("paper_id", "link", "title", "authors", "abstract", "categories"),
    T.StructField("published_date", T.TimestampNTZType()),
    T.StructField("updated_date", T.TimestampNTZType()),
    T.StructField("tag", T.StringType()),
])

#: Publications as stored.
PUBLICATIONS_SCHEMA = T.StructType([
    *_strings("paper_id", "link", "title", "authors", "abstract", "categories"),
    T.StructField("published_date", T.TimestampNTZType()),
    T.StructField("updated_date", T.TimestampNTZType()),
    T.StructField("ingested_at", T.TimestampNTZType()),
    T.StructField("tag", T.StringType()),
    T.StructField("umap_x", T.DoubleType()),
    T.StructField("umap_y", T.DoubleType()),
])

#: Columns a reader of the publications table gets, in order.
PUBLICATION_COLUMNS = [
    name for name in PUBLICATIONS_SCHEMA.names if not name.startswith("umap")
]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise before planning if ``df`` lacks one of ``names``."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}")
