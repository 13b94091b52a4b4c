"""Column expressions for identifiers, lists and dates.

All of them are built-in expressions and independent of the session time zone.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F, types as T

from pubweave.functions.text import string_array, string_map
from pubweave.functions.vocabulary import CATEGORY_LABELS, WEEKDAY_LABELS_RU

# Space, tab and line ends: what trimming means for fields and list items.
FIELD_SPACE = " \t\r\n"
# Every Unicode white space character: what trimming means for author names.
UNICODE_SPACE = "".join(map(chr, [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))

# Accepted text timestamps: "2025-12-01T10:00:00Z" or "2025-12-01 10:00:00",
# both with optional fractional seconds, both meaning UTC.
TIMESTAMP_TEXT = (
    r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?Z| \d{2}:\d{2}:\d{2}(\.\d+)?)$"
)


def trim_field(text: Column) -> Column:
    """Trim both ends; inner line breaks stay."""
    return F.btrim(text, F.lit(FIELD_SPACE))


def paper_id_from_link(link: Column) -> Column:
    """``http://host/abs/2512.00001v2`` -> ``2512.00001``."""
    return F.regexp_replace(F.regexp_replace(link, "^.*/abs/", ""), "v[0-9]+$", "")


def list_items(text: Column) -> Column:
    """Trimmed, non-blank items of a ``;``-separated list."""
    items = F.transform(F.split(text, ";"), trim_field)
    return F.filter(items, lambda item: item != "")


def normalize_list(text: Column) -> Column:
    """``"A; B;; C "`` -> ``"A, B, C"``; null and blank -> ``""``."""
    return F.coalesce(F.array_join(list_items(text), ", "), F.lit(""))


def category_names(
    codes: Column, labels: Mapping[str, str] = CATEGORY_LABELS
) -> Column:
    """Replace known category codes by their labels, keep unknown ones."""
    lookup = string_map(labels)
    names = F.transform(
        list_items(codes),
        lambda code: F.coalesce(F.try_element_at(lookup, code), code),
    )
    return F.coalesce(F.array_join(names, ", "), F.lit(""))


def parse_time(text: Column, strict: bool = False) -> Column:
    """UTC text -> timestamp without zone.

    Text in neither accepted format gives null, or fails when ``strict``.
    """
    parsed = F.when(text.rlike(TIMESTAMP_TEXT), text.try_cast("timestamp_ntz"))
    if not strict:
        return parsed
    problem = F.concat(F.lit("Not a timestamp: "), text)
    return F.when(text.isNull() | parsed.isNotNull(), parsed).otherwise(
        F.raise_error(problem).cast("timestamp_ntz")
    )


def utc_moment(moment: Column, kind: T.DataType) -> Column:
    """A typed moment as UTC wall clock; only timestamps with a zone change."""
    if not isinstance(kind, T.TimestampType):
        return moment.cast("timestamp_ntz")
    seconds = (F.unix_micros(moment) / F.lit(1_000_000).cast("decimal(18,0)")).cast(
        "decimal(18,6)"
    )
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=seconds)


def utc_now() -> Column:
    """The query's start time as UTC wall clock."""
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast(
        "timestamp_ntz"
    )


def day_bucket(moment: Column) -> Column:
    return F.to_date(moment)


def month_bucket(moment: Column) -> Column:
    return F.trunc(F.to_date(moment), "month")


def weekday_index(moment: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(F.to_date(moment))


def weekday_label(index: Column) -> Column:
    return F.element_at(string_array(WEEKDAY_LABELS_RU), index + 1)


def weekday_label_ru(index: Column) -> Column:
    return F.element_at(string_array(WEEKDAY_LABELS_RU.values()), index + 1)


def author_names(authors: Column) -> Column:
    """Trimmed names of a ``,``-separated list; blank names stay."""
    return F.transform(
        F.split(authors, ","), lambda name: F.btrim(name, F.lit(UNICODE_SPACE))
    )


def author_count(authors: Column) -> Column:
    """Commas + 1."""
    return F.size(F.split(authors, ","))


def between_years(moment: Column, first: int, last: int, kind: T.DataType) -> Column:
    """Calendar years ``first``..``last`` in UTC as a range that reaches the scan.

    ISO text orders like the dates it spells, so text columns get a string
    range and typed columns a range of their type; all are pushed to Parquet.  A
    year before 1 or after 9998 cannot bound the range, so that side is open.
    """
    if last < first or first > 9999 or last < 0:
        return F.lit(False)

    def start_of(year: int) -> Column:
        if isinstance(kind, T.StringType):
            return F.lit(f"{year:04d}")
        if isinstance(kind, T.TimestampType):
            return F.lit(f"{year:04d}-01-01 00:00:00+00:00").cast("timestamp")
        return F.lit(f"{year:04d}-01-01 00:00:00").cast("timestamp_ntz")

    inside = moment.isNotNull()
    if first > 0:
        inside &= moment >= start_of(first)
    if last < 9999:
        inside &= moment < start_of(last + 1)
    return inside
