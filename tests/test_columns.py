from datetime import datetime

import pytest
from conftest import values
from pyspark.sql import functions as F

from pubweave.functions import columns as C


def apply(spark, function, *texts):
    rows = [(i, text) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, x string")
    return values(df.orderBy("i").select(function(F.col("x"))))


def test_paper_id_from_link(spark):
    assert apply(
        spark, C.paper_id_from_link,
        "http://example.org/abs/2512.00001v2", "http://example.org/abs/cs/0001001v10",
        "http://a/abs/b/abs/x", "plain", None,
    ) == ["2512.00001", "cs/0001001", "x", "plain", None]


def test_trim_field_keeps_inner_line_breaks(spark):
    assert apply(spark, C.trim_field, " \n a\nb\t\r\n") == ["a\nb"]


def test_normalize_list(spark):
    assert apply(spark, C.normalize_list, "A; B;; C ", None, " ", ";", "A") == [
        "A, B, C", "", "", "", "A",
    ]


def test_category_names(spark):
    assert apply(
        spark, C.category_names, "cs.CR; zz.ZZ", "CS.CR", None, "", "quant-ph;cs.CE"
    ) == [
        "Computer Science: Cryptography and Security, zz.ZZ",
        "CS.CR",
        "",
        "",
        "Quantum Physics, Computer Science: Computational Engineering, Finance, and Science",
    ]


def test_category_names_with_own_labels(spark):
    assert apply(spark, lambda c: C.category_names(c, {"a": "Alpha"}), "a; cs.CR") == [
        "Alpha, cs.CR"
    ]


def test_parse_time(spark):
    assert apply(
        spark, C.parse_time,
        "2025-12-01T10:00:00Z", "2025-12-01 10:00:00.5", "2025-12-01T10:00:00.25Z",
        "2025-12-01", "2025-13-01T10:00:00Z", "", None,
    ) == [
        datetime(2025, 12, 1, 10), datetime(2025, 12, 1, 10, 0, 0, 500000),
        datetime(2025, 12, 1, 10, 0, 0, 250000), None, None, None, None,
    ]


def test_parse_time_ignores_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # Not a local time in New York: clocks jump over it.
        assert apply(spark, C.parse_time, "2025-03-09T02:30:00Z") == [
            datetime(2025, 3, 9, 2, 30)
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_parse_time_strict_fails_on_other_text(spark):
    with pytest.raises(Exception, match="Not a timestamp: yesterday"):
        apply(spark, lambda c: C.parse_time(c, strict=True), "yesterday")
    assert apply(spark, lambda c: C.parse_time(c, strict=True), None) == [None]


def test_date_buckets(spark):
    df = spark.sql("select timestamp_ntz'2025-12-01 23:59:59' as t")
    row = df.select(
        C.day_bucket(F.col("t")), C.month_bucket(F.col("t")), C.weekday_index(F.col("t")),
        C.weekday_label(C.weekday_index(F.col("t"))),
        C.weekday_label_ru(C.weekday_index(F.col("t"))),
    ).first()
    assert [str(v) for v in row] == ["2025-12-01", "2025-12-01", "0", "Mon", "Пн"]


def test_author_count_and_names(spark):
    assert apply(spark, C.author_count, "", "A, B, C", "Smith, Jr.") == [1, 3, 2]
    assert apply(spark, C.author_names, "A,B,  C", "", "A,  B　,") == [
        ["A", "B", "C"], [""], ["A", "B", ""],
    ]


def test_utc_now_is_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        now = spark.range(1).select(C.utc_now().cast("string")).first()[0]
        gap = datetime.fromisoformat(now) - datetime.now(tz=None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert abs(gap.total_seconds()) < 600
