from datetime import datetime

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from pubweave.functions.columns import parse_time
from pubweave.operators.search import (
    as_integer,
    filter_publications,
    in_years,
    latest_publications,
    newest_first,
    search_papers,
    select_corpus,
)
from pubweave.operators.trends import papers_by_day
from pubweave.operators.upsert import stage_publications

DAY = datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame(
        [
            ("1", "Malware at work", None, "2024-02-01T00:00:00Z"),
            ("2", None, "About mal.are", "2023-12-31T23:59:59Z"),
            ("3", "Plain", "text", None),
            ("4", None, None, "2024-12-31 23:59:59"),
            ("5", "a_b 100%", "axb", "2025-01-01T00:00:00Z"),
        ],
        "id string, title string, abstract string, published_date string",
    )


@pytest.fixture(scope="module")
def pubs(spark):
    return spark.createDataFrame(
        [
            ("a", "T", "Abs", "Computer Science: Cryptography and Security", DAY, DAY),
            ("b", "a_b", "x", "zz.ZZ", datetime(2024, 12, 31, 23, 59, 59, 999999), None),
            ("c", "axb", None, "", datetime(2025, 1, 1), DAY),
            ("d", None, "A\\B", "Other", None, None),
            ("e", "T", "Abs", "Other", DAY, DAY),
        ],
        "paper_id string, title string, abstract string, categories string,"
        " published_date timestamp_ntz, updated_date timestamp_ntz",
    )


def ids(df, column=None):
    return sorted(values(df, column))


def test_search_is_a_case_insensitive_regex(papers):
    assert ids(search_papers(papers, "MAL.ARE")) == ["1", "2"]
    assert ids(search_papers(papers, "^plain$|100%")) == ["3", "5"]
    assert ids(search_papers(papers)) == ["1", "2", "3", "4", "5"]
    assert ids(search_papers(papers, "")) == ["1", "2", "3", "5"]


def test_search_year_on_text_and_typed_dates(papers, pubs):
    assert ids(search_papers(papers, year=2024)) == ["1", "4"]
    assert ids(search_papers(papers, "malware", 2024)) == ["1"]
    assert ids(search_papers(pubs, year=2024)) == ["a", "b", "e"]
    for impossible in (-1, 0, 12345):
        assert search_papers(pubs, year=impossible).count() == 0


def test_category_filter_matches_labels(pubs):
    assert ids(filter_publications(pubs, category=" CRYPTOGRAPHY ")) == ["a"]
    assert ids(filter_publications(pubs, category="cs.CR")) == []
    assert ids(filter_publications(pubs, category="ZZ.zz")) == ["b"]


def test_text_filter_is_a_like_substring(pubs):
    assert ids(filter_publications(pubs, text="a_b")) == ["b", "c", "d"]
    assert ids(filter_publications(pubs, text="t%")) == ["a", "e"]
    assert ids(filter_publications(pubs, text="a\\b")) == ["d"]


def test_unusable_filters_are_ignored(pubs):
    assert filter_publications(pubs, "year", "  ", "").count() == 5
    assert ids(filter_publications(pubs, year="2025")) == ["c"]
    assert ids(filter_publications(pubs, year=2025.9, text="axb")) == ["c"]


def test_publications_order_and_limit(pubs):
    assert values(latest_publications(pubs)) == ["c", "a", "e", "b", "d"]
    assert values(latest_publications(pubs, 2)) == ["c", "a"]
    for no_limit in (0, -1, None, "many"):
        assert latest_publications(pubs, no_limit).count() == 5


def test_newest_first(pubs):
    assert values(newest_first(pubs, 3, "paper_id")) == ["c", "b", "a"]
    assert newest_first(pubs, 0, "paper_id").count() == 0
    assert newest_first(pubs, "x", "paper_id").columns == pubs.columns
    assert newest_first(pubs, None, "paper_id").count() == 5


def test_large_limits_are_lazy(spark):
    # Many ties, nulls and copies; several tasks.
    rows = spark.range(0, 5000, 1, 7).selectExpr(
        "cast(id % 997 as string) as paper_id",
        "if(id % 3 = 0, null, timestamp_ntz'2024-01-01 00:00:00'"
        " + make_dt_interval(cast(id % 40 as int))) as updated_date",
        "timestamp_ntz'2023-01-01 00:00:00' as published_date",
    )
    expected = [tuple(r) for r in latest_publications(rows).collect()]
    threshold = "spark.sql.execution.topKSortFallbackThreshold"
    for setting in (2147483632, 10):
        spark.conf.set(threshold, setting)
        try:
            for limit in (11, 1000, 4999, 5000, 100_001):
                cut = latest_publications(rows, limit)
                assert [tuple(r) for r in cut.collect()] == expected[:limit]
        finally:
            spark.conf.unset(threshold)
    spark.sparkContext.setJobGroup("lazy", "no job may start")
    latest_publications(rows, 100_001)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert newest_first(rows, 2500, "paper_id").count() == 2500


def test_open_years(spark):
    df = spark.createDataFrame(
        [("a", "2019-05-05T00:00:00Z"), ("b", "2020-01-01T00:00:00Z"),
         ("c", "9999-12-31T23:59:59Z"), ("d", None)],
        "id string, published_date string",
    ).withColumn("typed", F.to_timestamp("published_date").cast("timestamp_ntz"))
    found = {
        (column, years): ids(df.filter(in_years(df, column, *years)))
        for column in ("published_date", "typed")
        for years in ((2020, 9999), (0, 2019), (9999, 9999), (-5, 20000), (2021, 2020),
                      (10000, 10001))
    }
    for column in ("published_date", "typed"):
        assert [found[column, y] for y in (
            (2020, 9999), (0, 2019), (9999, 9999), (-5, 20000), (2021, 2020), (10000, 10001),
        )] == [["b", "c"], ["a"], ["c"], ["a", "b", "c"], [], []]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo", "UTC"])
def test_years_and_buckets_are_utc(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        text = spark.createDataFrame(
            [("a", "2023-12-31T23:30:00Z"), ("b", "2024-01-01T02:00:00Z"),
             ("c", "2024-11-03T05:30:00Z"), ("d", "2024-11-03T06:30:00.25Z")],
            "paper_id string, published_date string",
        )
        forms = [
            text,
            text.withColumn("published_date", F.col("published_date").cast("timestamp")),
            text.withColumn("published_date", parse_time(F.col("published_date"))),
        ]
        for df in forms:
            assert ids(search_papers(df, year=2024), "paper_id") == ["b", "c", "d"]
        for df in forms[1:]:
            days = [(str(r.day), r.n) for r in papers_by_day(df).collect()]
            assert days == [("2023-12-31", 1), ("2024-01-01", 1), ("2024-11-03", 2)]
        staged = [
            [str(r.published_date) for r in stage_publications(
                df.selectExpr("paper_id as id", "'' as link", "'' as title", "'' as authors",
                              "'' as abstract", "'' as categories", "published_date",
                              "published_date as updated_date", "'' as tag")
            ).orderBy("paper_id").collect()]
            for df in forms
        ]
        assert staged[0] == staged[1] == staged[2]
        assert staged[0][3] == "2024-11-03 06:30:00.250000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_corpus_terms_are_literal(spark):
    df = spark.createDataFrame(
        [("a", "word c here"), ("b", "in C++ code"), ("c", "a.b"), ("d", "axb")],
        "id string, title string",
    ).selectExpr("id", "title", "'' as abstract", "'' as authors", "'x' as categories",
                 "'2021-01-01T00:00:00Z' as published_date")
    assert ids(select_corpus(df, ["x"], ["c++", "a.b"], (2020, 9999))) == ["b", "c"]


def test_as_integer():
    assert [as_integer(v) for v in (3, "3", 3.9, "x", None, float("nan"), float("inf"))] == [
        3, 3, 3, None, None, None, None,
    ]


def test_select_corpus(spark):
    rows = [
        ("in", "An ATTACK.", "x", "y", "zz.ZZ; cs.CR", "2020-01-01T00:00:00Z"),
        ("last minute", None, "threat", None, "cs.NI", "2025-12-31T23:59:59Z"),
        ("late", "attack", "x", "y", "cs.CR", "2026-01-01T00:00:00Z"),
        ("early", "attack", "x", "y", "cs.CR", "2019-12-31T23:59:59Z"),
        ("part of a word", "attackers", "x", "y", "cs.CR", "2021-01-01T00:00:00Z"),
        ("other field", "attack", "x", "y", "cs.AI", "2021-01-01T00:00:00Z"),
        ("no field", "attack", "x", "y", None, "2021-01-01T00:00:00Z"),
        ("author", "t", "x", "Trojan; B", "cs.LG", "2021-01-01 00:00:00"),
    ]
    df = spark.createDataFrame(
        rows,
        "id string, title string, abstract string, authors string,"
        " categories string, published_date string",
    )
    assert ids(select_corpus(df)) == ["author", "in", "last minute"]


def test_year_filter_reaches_the_scan(spark, papers, pubs, tmp_path):
    for name, df in (("text", papers), ("typed", pubs)):
        df.write.parquet(str(tmp_path / name))
        plan = plan_of(search_papers(spark.read.parquet(str(tmp_path / name)), year=2024))
        pushed = plan[plan.index("PushedFilters") :]
        assert "GreaterThanOrEqual(published_date" in pushed
        assert "LessThan(" in pushed


def test_limit_is_a_top_k(pubs):
    assert "TakeOrderedAndProject" in plan_of(latest_publications(pubs, 2))
