import random
from datetime import datetime

import pytest
from conftest import values
from pyspark.sql import functions as F

from pubweave.operators.upsert import (
    count_actions,
    merge_publications,
    new_papers_only,
    newest_per_key,
    stage_publications,
)
from pubweave.plans.marts import build_marts
from pubweave.schemas import PUBLICATION_COLUMNS, PUBLICATIONS_SCHEMA
from pubweave.sources import files, publications as store_module
from pubweave.sources.publications import (
    init_store,
    load_publications,
    read_publications,
    save_publications,
    store_path,
)

CLASSIFIED = (
    "id string, link string, title string, authors string, abstract string,"
    " categories string, published_date string, updated_date string, tag string"
)


def paper(
    key, updated="2024-01-02T00:00:00Z", tag="t", title="title", published="2024-01-01T00:00:00Z"
):
    return (key, "link", title, "A; B", "abstract", "cs.CR", published, updated, tag)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), CLASSIFIED)


def counts(stats):
    return stats["inserted"], stats["updated"], stats["skipped"]


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def stored(spark, path):
    return {r.paper_id: r for r in load_publications(spark, path).collect()}


def test_missing_store_is_empty_and_typed(spark, path):
    empty = load_publications(spark, path)
    assert empty.count() == 0 and empty.columns == PUBLICATION_COLUMNS
    assert read_publications(spark, path).schema == PUBLICATIONS_SCHEMA


def test_init_is_idempotent(spark, path):
    assert init_store(spark, path) == init_store(spark, path)
    assert load_publications(spark, path).count() == 0


def test_insert_then_read(spark, path):
    stats = save_publications(batch(spark, paper("a", tag=" q "), paper("b", None)), path)
    assert counts(stats) == (2, 0, 0) and stats["path"] == path
    rows = stored(spark, path)
    assert rows["a"].tag == " q "
    assert rows["a"].authors == "A, B"
    assert rows["a"].categories == "Computer Science: Cryptography and Security"
    assert rows["a"].updated_date == datetime(2024, 1, 2)
    assert rows["a"].ingested_at is not None
    assert values(load_publications(spark, path)) == ["a", "b"]


def test_update_rules(spark, path):
    old = [paper(k, tag="old") for k in "abcdef"] + [paper("g", None, "old")]
    save_publications(batch(spark, *old), path)
    before = stored(spark, path)
    new = [
        paper("a", "2024-01-02T00:00:00Z", "new", "T"),  # same date: skipped
        paper("b", "2024-01-01T00:00:00Z", "new", "T"),  # older: skipped
        paper("c", "2024-01-03T00:00:00Z", "  ", "T"),  # newer, blank tag: old tag
        paper("d", "2024-01-03T00:00:00Z", " X ", "T"),  # newer: trimmed tag
        paper("e", None, None, "T"),  # no date: updated
        paper("g", "2020-01-01T00:00:00Z", "new", "T"),  # stored without date: updated
        paper("h", None, None, "T"),  # new
        paper(None), paper(""), paper("  "),
    ]
    assert counts(save_publications(batch(spark, *new), path)) == (2, 4, 4)
    after = stored(spark, path)
    assert {k: after[k].tag for k in after} == {
        "a": "old", "b": "old", "c": "old", "d": "X", "e": "old", "f": "old",
        "g": "new", "h": None, "  ": "t",
    }
    assert {k for k in after if after[k].title == "T"} == set("cdegh")
    assert after["e"].updated_date is None
    assert after["a"] == before["a"] and after["c"].ingested_at >= before["c"].ingested_at


def test_update_keeps_embedding_columns(spark, path):
    existing = batch(spark, paper("a"))
    staged = stage_publications(existing)
    before = staged.select(
        "*", F.lit(None).cast("timestamp_ntz").alias("ingested_at"),
        F.lit(1.5).alias("umap_x"), F.lit(2.5).alias("umap_y"),
    )
    newer = stage_publications(batch(spark, paper("a", "2025-01-01T00:00:00Z")))
    row = merge_publications(before, newer).first()
    assert (row.umap_x, row.umap_y, row.action) == (1.5, 2.5, "update")


def test_copies_in_a_batch_count_as_skipped(spark, path):
    rows = [paper("a", f"2024-01-{d:02d}T00:00:00Z", title=str(d)) for d in range(1, 30)]
    assert counts(save_publications(batch(spark, *rows, paper("a", None)), path)) == (1, 0, 29)
    assert stored(spark, path)["a"].title == "29"


def test_saving_again_changes_nothing(spark, path):
    papers = batch(spark, *[paper(str(i)) for i in range(50)])
    assert counts(save_publications(papers, path)) == (50, 0, 0)
    before = file_names(spark, path)
    assert counts(save_publications(papers, path)) == (0, 0, 50)
    assert file_names(spark, path) == before


def test_empty_batch_leaves_no_trace(spark, path):
    assert counts(save_publications(batch(spark), path)) == (0, 0, 0)
    assert not files.exists(spark, path)


def test_missing_columns_are_named(spark, path):
    with pytest.raises(ValueError, match="link, tag"):
        save_publications(batch(spark).drop("link", "tag"), path)


def test_bad_dates_fail_unless_allowed(spark, path):
    papers = batch(spark, paper("a", "soon"))
    with pytest.raises(Exception, match="Not a timestamp"):
        save_publications(papers, path)
    assert counts(save_publications(papers, path, strict=False)) == (1, 0, 0)


def month_paper(key, month, updated="2024-01-02T00:00:00Z"):
    date = f"2023-{month:02d}-15T00:00:00Z" if month else None
    return paper(key, updated, published=date)


def file_names(spark, path):
    """Data files by month."""
    return {
        month: {n for n in files.list_names(spark, f"{path}/{month}") if n.endswith(".parquet")}
        for month in files.list_names(spark, path) if month.startswith("month=")
    }


def test_updates_rewrite_their_month_only(spark, path):
    first = [month_paper(f"{m}-{i}", m) for m in (0, 1, 2, 3) for i in range(5)]
    save_publications(batch(spark, *first), path)
    before = file_names(spark, path)
    assert set(before) == {"month=none", "month=2023-01", "month=2023-02", "month=2023-03"}
    save_publications(batch(spark, month_paper("new", 2)), path)
    grown = file_names(spark, path)
    assert grown["month=2023-02"] > before["month=2023-02"]
    assert {m for m in grown if grown[m] != before[m]} == {"month=2023-02"}
    save_publications(batch(spark, month_paper("2-0", 2, "2025-01-01T00:00:00Z")), path)
    after = file_names(spark, path)
    assert not after["month=2023-02"] & grown["month=2023-02"]
    assert {m for m in after if after[m] != grown[m]} == {"month=2023-02"}
    assert load_publications(spark, path).count() == 21


def test_a_paper_may_change_its_month(spark, path):
    save_publications(batch(spark, month_paper("a", 1), month_paper("b", 1)), path)
    later = "2025-01-01T00:00:00Z"
    stats = save_publications(batch(spark, month_paper("a", 5, later), month_paper("c", 0)), path)
    assert counts(stats) == (1, 1, 0)
    assert {k: str(r.published_date)[:7] for k, r in stored(spark, path).items()} == {
        "a": "2023-05", "b": "2023-01", "c": "None",
    }
    save_publications(batch(spark, month_paper("b", 0, later)), path)
    assert set(file_names(spark, path)) == {"month=2023-05", "month=none"}
    assert load_publications(spark, path, year=2023).count() == 1


def test_a_year_reads_its_months(spark, path):
    from conftest import plan_of

    rows = [month_paper("a", 1), paper("b", published="2022-05-05T00:00:00Z"), month_paper("c", 0)]
    save_publications(batch(spark, *rows), path)
    of_year = load_publications(spark, path, year=2022)
    assert values(of_year) == ["b"]
    scans = [line for line in plan_of(of_year).splitlines() if "PartitionFilters: [" in line]
    for scan in scans:
        pruned = scan.split("PartitionFilters: [")[1].split("]")[0]
        assert "2022-01" in pruned and "2022-12" in pruned
    assert scans
    assert load_publications(spark, path, year=1999).count() == 0


def test_layout_does_not_depend_on_the_batches(spark, tmp_path):
    papers = [month_paper(str(i), i % 5) for i in range(40)]
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    save_publications(batch(spark, *papers), one)
    for i in range(0, 40, 10):
        save_publications(batch(spark, *papers[i : i + 10]), many)
    assert set(file_names(spark, one)) == set(file_names(spark, many))
    strip = [c for c in PUBLICATIONS_SCHEMA.names if c != "ingested_at"]
    assert sorted(map(str, read_publications(spark, one).select(*strip).collect())) == sorted(
        map(str, read_publications(spark, many).select(*strip).collect())
    )


def test_failing_write_changes_nothing(spark, path, monkeypatch):
    save_publications(batch(spark, paper("a")), path)
    before = file_names(spark, path)
    monkeypatch.setattr(store_module, "_overwrite_months", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        save_publications(batch(spark, paper("a", "2025-01-01T00:00:00Z")), path)
    monkeypatch.undo()
    assert file_names(spark, path) == before
    assert stored(spark, path)["a"].updated_date == datetime(2024, 1, 2)


def test_an_interrupted_save_is_repeated(spark, path, monkeypatch):
    """The months updated are in place, those that only gain papers are not."""
    save_publications(batch(spark, month_paper("a", 1)), path)
    again = batch(spark, month_paper("a", 1, "2025-01-01T00:00:00Z"), month_paper("b", 2))
    whole = store_module._overwrite_months

    def stops(*arguments):
        whole(*arguments)
        raise OSError("gone")

    monkeypatch.setattr(store_module, "_overwrite_months", stops)
    with pytest.raises(OSError):
        save_publications(again, path)
    monkeypatch.undo()
    assert counts(save_publications(again, path)) == (1, 0, 1)
    assert {k: r.updated_date.year for k, r in stored(spark, path).items()} == {
        "a": 2025, "b": 2024,
    }


@pytest.mark.parametrize("broadcast_bytes", [1_000_000, 0])
def test_store_agrees_with_the_one_shot_merge(spark, path, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(store_module, "BROADCAST_BYTES", broadcast_bytes)
    rng = random.Random(3)

    def random_batch(n):
        dates = [None, *(f"2024-01-{d:02d}T00:00:00Z" for d in range(1, 6))]
        return batch(spark, *[
            paper(rng.choice([None, "", *map(str, range(60))]), rng.choice(dates),
                  rng.choice([None, " ", " x ", "y"]), str(i))
            for i in range(n)
        ])

    columns = [c for c in PUBLICATIONS_SCHEMA.names if c != "ingested_at"]
    expected = read_publications(spark, path)
    for _ in range(3):
        papers = random_batch(80)
        staged = stage_publications(papers)
        merged = merge_publications(expected, staged)
        done = count_actions(staged, expected).first()
        stats = save_publications(papers, path)
        assert counts(stats) == tuple(done) and sum(counts(stats)) == 80
        actual = read_publications(spark, path)
        assert sorted(map(str, actual.select(*columns).collect())) == sorted(
            map(str, merged.select(*columns).collect())
        )
        expected = spark.createDataFrame(actual.collect(), PUBLICATIONS_SCHEMA)


def test_each_month_is_written_by_few_tasks(spark, path, monkeypatch):
    monkeypatch.setattr(store_module, "BROADCAST_BYTES", 0)
    keys = [str(i) for i in range(200)]
    save_publications(batch(spark, *[month_paper(k, int(k) % 4) for k in keys]), path)
    newer = [month_paper(k, int(k) % 4, "2025-01-01T00:00:00Z") for k in keys[:100]]
    assert counts(save_publications(batch(spark, *newer), path)) == (0, 100, 0)
    for names in file_names(spark, path).values():
        assert 0 < len(names) <= 2
    assert load_publications(spark, path).count() == 200


def test_reports_do_not_sort_the_store(spark, path):
    from conftest import plan_of

    save_publications(batch(spark, paper("a")), path)
    for mart in build_marts(read_publications(spark, path)).values():
        assert "updated_date" not in plan_of(mart)


def test_new_papers_only(spark):
    staged = stage_publications(batch(spark, paper("a"), paper("b"), paper("b"), paper(None)))
    known = staged.filter("paper_id = 'a'")
    assert values(new_papers_only(staged, known)) == ["b", "b"]


def test_copies_are_combined_before_the_shuffle(spark):
    from conftest import plan_of

    plan = plan_of(newest_per_key(stage_publications(batch(spark, paper("a")))))
    assert "partial_max" in plan and plan.count("Exchange") == 1


def test_store_path_order(spark, monkeypatch):
    monkeypatch.delenv(store_module.STORE_ENV, raising=False)
    assert store_path(spark) == store_module.DEFAULT_STORE
    spark.conf.set(store_module.STORE_CONF, "/conf")
    try:
        assert store_path(spark) == "/conf"
        monkeypatch.setenv(store_module.STORE_ENV, "/env")
        assert store_path(spark) == "/env"
        monkeypatch.setenv(store_module.STORE_ENV, "")
        assert store_path(spark) == "/conf"
        assert store_path(spark, "/argument") == "/argument"
    finally:
        spark.conf.unset(store_module.STORE_CONF)


def test_load_filters_and_limit(spark, path):
    rows = [paper("a", title="Malware"), paper("b", None, title="Other")]
    save_publications(batch(spark, *rows), path)
    assert values(load_publications(spark, path, text="MALWARE", year=2024)) == ["a"]
    assert values(load_publications(spark, path, category="cryptography", limit=1)) == ["a"]
    assert load_publications(spark, path, category="cs.CR").count() == 0


@pytest.fixture
def writes(monkeypatch):
    """Plans of the tables written."""
    from conftest import plan_of
    from pyspark.sql import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def recorded(self, *arguments, **options):
        plans.append(plan_of(self._df))
        return write(self, *arguments, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    return plans


@pytest.mark.parametrize("broadcast_bytes", [1_000_000, 4 * store_module.MARK_BYTES])
def test_a_save_writes_and_shuffles_whole_rows_twice(
    spark, path, monkeypatch, writes, broadcast_bytes
):
    """By key with the decision, by month into the table; stored rows by month only."""
    monkeypatch.setattr(store_module, "BROADCAST_BYTES", broadcast_bytes)
    keys = [str(i) for i in range(800)]
    save_publications(batch(spark, *[month_paper(k, int(k) % 4) for k in keys]), path)
    newer = [month_paper(k, int(k) % 4, "2025-01-01T00:00:00Z") for k in keys[:400]]
    assert counts(save_publications(batch(spark, *newer), path)) == (0, 400, 0)
    assert len(writes) == 4
    first, added, second, merged = writes
    for decided in (first, second):
        # The batch and, unless they are few, the stored keys.
        assert decided.count("Exchange hashpartitioning(paper_id") in (1, 2)
        assert "REBALANCE" not in decided
    assert added.count("REBALANCE") == merged.count("REBALANCE") == 1
    assert "Exchange hashpartitioning(paper_id" not in merged and "SortMergeJoin" not in merged


@pytest.mark.parametrize("marks", [8, 7, 0])
def test_replaced_rows_are_found_by_place(spark, path, monkeypatch, marks):
    """Two files in each of two months, with over 32,768 rows in one: its marks fill two
    bitmaps. With room for all eight marks or fewer the result is the same."""
    def papers(first, last, updated, title):
        return spark.range(first, last, 1, 1).selectExpr(
            "'p' || id as id", "'link' as link", f"'{title}' as title", "'A; B' as authors",
            "cast(id as string) as abstract", "'cs.CR' as categories",
            "if(id % 9 = 0, '2023-02', '2023-01') || '-15T00:00:00Z' as published_date",
            f"{updated} as updated_date", "'t' as tag",
        )

    monkeypatch.setattr(store_module, "BROADCAST_BYTES", marks * store_module.MARK_BYTES)
    old, new = "'2024-01-01T00:00:00Z'", "'2025-01-01T00:00:00Z'"
    assert counts(save_publications(papers(0, 40_000, old, "old"), path)) == (40_000, 0, 0)
    assert counts(save_publications(papers(40_000, 42_000, old, "old"), path)) == (2_000, 0, 0)
    assert {len(names) for names in file_names(spark, path).values()} == {2}
    again = papers(0, 44_000, f"if(id % 3 = 0, {new}, {old})", "new")
    assert counts(save_publications(again, path)) == (2_000, 14_000, 28_000)
    rows = read_publications(spark, path).selectExpr(
        "cast(abstract as long) as id", "paper_id", "title", "updated_date"
    )
    assert rows.count() == rows.select("paper_id").distinct().count() == 44_000
    expected = F.expr("if(id % 3 = 0 or id >= 42000, 'new', 'old')")
    wrong = (F.col("title") != expected) | (F.col("paper_id") != F.concat(F.lit("p"), "id"))
    assert rows.filter(wrong).count() == 0
    assert rows.filter("id % 3 = 0 and year(updated_date) <> 2025").count() == 0


def test_months_that_lose_all_rows_go(spark, path, monkeypatch):
    monkeypatch.setattr(store_module, "BROADCAST_BYTES", 4 * store_module.MARK_BYTES)
    keys = [str(i) for i in range(400)]
    save_publications(batch(spark, *[month_paper(k, int(k) % 2 + 1) for k in keys]), path)
    moved = [month_paper(k, 5, "2025-01-01T00:00:00Z") for k in keys if int(k) % 2 or k < "3"]
    save_publications(batch(spark, *moved), path)
    assert set(file_names(spark, path)) == {"month=2023-01", "month=2023-05"}
    assert load_publications(spark, path).count() == 400


def test_skipped_papers_are_counted_not_written(spark, path):
    rows = [paper("a"), paper("a"), paper("b"), paper(None), paper(None), paper("")]
    assert counts(save_publications(batch(spark, *rows), path)) == (2, 0, 4)
    assert counts(save_publications(batch(spark, *rows), path)) == (0, 0, 6)
    assert counts(save_publications(batch(spark, paper(None)), path)) == (0, 0, 1)
    assert set(stored(spark, path)) == {"a", "b"}
