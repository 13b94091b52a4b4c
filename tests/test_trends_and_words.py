from datetime import datetime

import pytest
from conftest import plan_of

from pubweave.operators import trends, words
from pubweave.plans.marts import by_count_order, build_marts, write_marts

SCHEMA = (
    "paper_id string, authors string, abstract string,"
    " published_date timestamp_ntz, tag string"
)
MONDAY, TUESDAY = datetime(2025, 12, 1, 23, 59), datetime(2025, 12, 2, 0, 1)


@pytest.fixture(scope="module")
def pubs(spark):
    return spark.createDataFrame(
        [
            ("1", "A, B", "Graph graph the model graph", MONDAY, "x"),
            ("2", "A,A", "beta alpha tasks accuracy", TUESDAY, "x"),
            ("3", "", "alpha beta", None, "other"),
            ("4", None, "gamma gamma", MONDAY, None),
            ("5", "B", None, datetime(2026, 1, 5), "y"),
            ("6", "C", "gamma <b>delta</b>", MONDAY, "y"),
        ],
        SCHEMA,
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def text_rows(df):
    return [tuple(map(str, r)) for r in df.collect()]


def test_by_day_and_month(pubs):
    assert text_rows(trends.papers_by_day(pubs)) == [
        ("2025-12-01", "3"), ("2025-12-02", "1"), ("2026-01-05", "1"), ("None", "1"),
    ]
    assert text_rows(trends.papers_by_month(pubs)) == [
        ("2025-12-01", "4"), ("2026-01-01", "1"), ("None", "1"),
    ]


def test_by_weekday(pubs):
    assert rows(trends.papers_by_weekday(pubs)) == [
        (0, "Mon", "Пн", 4), (1, "Tue", "Вт", 1),
    ]


def test_authors(pubs):
    assert rows(trends.top_authors(pubs)) == [("A", 3), ("B", 2), ("", 1), ("C", 1)]
    assert rows(trends.top_authors(pubs, 1)) == [("A", 3)]
    assert rows(trends.authors_per_paper_histogram(pubs)) == [(1, 3), (2, 2)]
    assert ("4",) not in rows(trends.author_counts(pubs).select("paper_id"))


def test_tags(pubs):
    assert rows(trends.tag_counts(pubs)) == [("x", 2), ("y", 2), ("other", 1)]


def test_tag_share_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a",)] + [("b",)] * 15, "tag string")
    assert rows(trends.tag_share(df)) == [("b", 15, 93.8), ("a", 1, 6.2)]


def test_has_data(pubs):
    assert trends.has_data(pubs) and not trends.has_data(pubs.limit(0))
    assert rows(trends.data_flag(pubs)) == [(True,)]
    assert rows(trends.data_flag(pubs.filter("false"))) == [(False,)]


def test_top_words_order_and_stop_lists(pubs):
    assert rows(words.get_top_words(pubs)) == [
        ("gamma", 3), ("graph", 3), ("alpha", 2), ("beta", 2), ("accuracy", 1), ("delta", 1),
    ]
    assert rows(words.get_top_words(pubs, 1)) == [("gamma", 3)]
    assert ("tasks", 1) in rows(words.get_top_words(pubs, stopwords=[]))


def test_top_words_by_tag(pubs):
    found = rows(words.get_top_words_by_tag(pubs, 2).orderBy("tag", "n", "word"))
    assert found == [
        ("x", "alpha", 1), ("x", "graph", 3), ("y", "delta", 1), ("y", "gamma", 1),
    ]


def test_reports_from_shared_counts_are_the_same(pubs):
    counts = words.count_words_by_tag(pubs)
    assert rows(words.top_words_from_counts(counts)) == rows(words.get_top_words(pubs))
    assert set(rows(words.top_words_by_tag_from_counts(counts).drop("rank"))) == set(
        rows(words.get_top_words_by_tag(pubs))
    )


def test_missing_columns_are_named(pubs):
    with pytest.raises(ValueError, match="abstract"):
        words.get_top_words(pubs.drop("abstract"))
    with pytest.raises(ValueError, match="tag"):
        words.get_top_words_by_tag(pubs.drop("tag"))


def test_word_plans(pubs):
    by_tag = plan_of(words.get_top_words_by_tag(pubs))
    assert by_tag.count("WindowGroupLimit") == 2 and "partial_count" in by_tag
    overall = plan_of(words.get_top_words(pubs))
    assert overall.count("Exchange") == 1 and "TakeOrderedAndProject" in overall
    assert "Python" not in by_tag + overall


@pytest.mark.parametrize("broadcast_bytes", [8 << 20, 0])
def test_long_stop_lists_are_joined(pubs, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(words, "BROADCAST_BYTES", broadcast_bytes)
    long_list = [f"word{i}" for i in range(100_000)] + ["gamma"]
    found = words.get_top_words(pubs, stopwords=long_list)
    plan = plan_of(found)
    assert "LeftAnti" in plan and "word777" not in plan
    assert ("BroadcastHashJoin" in plan) == (broadcast_bytes > 0)
    assert rows(found) == rows(words.get_top_words(pubs, stopwords=["gamma"]))
    by_tag = words.get_top_words_by_tag(pubs, stopwords=long_list)
    assert rows(by_tag.orderBy("tag", "word")) == rows(
        words.get_top_words_by_tag(pubs, stopwords=["gamma"]).orderBy("tag", "word")
    )


def test_marts(spark, pubs, tmp_path):
    paths = write_marts(pubs, str(tmp_path))
    lazy = build_marts(pubs)
    assert set(paths) == {*lazy, "word_counts", "paper_counts"}
    for name, table in lazy.items():
        assert sorted(map(str, rows(spark.read.parquet(paths[name])))) == sorted(
            map(str, rows(table))
        )


def test_marts_alone(spark, pubs, tmp_path):
    assert set(write_marts(pubs, str(tmp_path), ["tag_share"])) == {"tag_share", "paper_counts"}
    assert set(write_marts(pubs, str(tmp_path), ["has_data"])) == {"has_data"}


def test_paper_counts_in_one_scan(pubs):
    counts = trends.paper_counts(pubs)
    assert plan_of(counts).count("Scan") == 1 and plan_of(counts).count("Exchange") == 1
    assert text_rows(trends.days_from_counts(counts)) == text_rows(trends.papers_by_day(pubs))
    assert rows(trends.share_from_counts(counts)) == rows(trends.tag_share(pubs))
    assert rows(trends.authors_per_paper_from_paper_counts(counts)) == rows(
        trends.authors_per_paper_histogram(pubs)
    )


def test_chart_orders(pubs):
    marts = build_marts(pubs)
    assert [r.n for r in by_count_order(marts["top_authors"]).collect()] == [1, 1, 2, 3]
    assert [(r.tag, r.rank) for r in marts["topic_words"].collect()][:2] == [("x", 1), ("x", 2)]
