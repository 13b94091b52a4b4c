import warnings

import pytest
from conftest import values
from pyspark.sql import functions as F

from pubweave.plans.etl import get_papers, main, run_etl, run_report
from pubweave.schemas import RAW_SCHEMA
from pubweave.sources.atom import read_atom
from pubweave.sources.publications import load_publications
from pubweave.sources.raw import load_raw_data, save_raw_data
from pubweave.streaming.incremental import run_incremental_etl

PAGE = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:x="http://example.org/schemas/atom">
  <title>Query results</title>
  <id>http://example.org/api/1</id>
  <updated>2025-12-03T00:00:00Z</updated>
{entries}
</feed>
"""

FULL = """  <entry>
    <id>http://example.org/abs/2512.00001v2</id>
    <updated>2025-12-02T10:00:00Z</updated>
    <published>2025-12-01T10:00:00Z</published>
    <title> Malware in
  two lines </title>
    <summary>
  We study an attack &amp; ransomware, 1 &lt; 2.
</summary>
    <author><name> Müller, A. </name><x:affiliation>Somewhere</x:affiliation></author>
    <author><name>B</name></author>
    <x:comment>3 pages</x:comment>
    <link href="http://example.org/abs/2512.00001v2" rel="alternate" type="text/html"/>
    <category term="cs.CR" scheme="http://example.org/schemas/atom"/>
    <category term="zz.ZZ" scheme="http://example.org/schemas/atom"/>
  </entry>"""

SPARSE = """  <entry>
    <id>http://example.org/abs/cs/0001001v10</id>
    <title>An old threat</title><title>Second title</title>
    <published>2024-01-01T00:00:00Z</published>
    <category term="cs.NI"/>
  </entry>"""


def entry(number, published, title="A botnet"):
    return f"""  <entry><id>http://example.org/abs/{number}v1</id><title>{title}</title>
    <summary>botnet</summary><author><name>Z</name></author>
    <published>{published}</published><updated>{published}</updated>
    <category term="cs.CR"/></entry>"""


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "page-1.xml").write_text(PAGE.format(entries=f"{FULL}\n{SPARSE}"))
    (folder / "page-2.xml").write_text(PAGE.format(entries=entry("7", "2025-06-01T00:00:00Z")))
    (folder / "page-3.xml").write_text(PAGE.format(entries=""))
    return folder


def test_atom_entries(spark, landing):
    papers = {r.id: r for r in read_atom(spark, str(landing)).collect()}
    assert set(papers) == {"2512.00001", "cs/0001001", "7"}
    full, sparse = papers["2512.00001"], papers["cs/0001001"]
    assert full.asDict() == {
        "id": "2512.00001",
        "link": "http://example.org/abs/2512.00001v2",
        "title": "Malware in\n  two lines",
        "authors": "Müller, A.; B",
        "abstract": "We study an attack & ransomware, 1 < 2.",
        "categories": "cs.CR; zz.ZZ",
        "published_date": "2025-12-01T10:00:00Z",
        "updated_date": "2025-12-02T10:00:00Z",
    }
    assert sparse.title == "An old threat"
    assert sparse.authors == "" and sparse.categories == "cs.NI"
    assert sparse.abstract is None and sparse.updated_date is None


def test_atom_layout(spark, landing):
    assert read_atom(spark, str(landing)).dtypes == [
        (name, "string") for name in RAW_SCHEMA.names
    ]


def test_get_papers(spark, landing):
    path = str(landing)
    assert values(get_papers(spark, path, max_results=2)) == ["2512.00001", "7"]
    assert get_papers(spark, path, max_results=0).columns == RAW_SCHEMA.names
    assert values(get_papers(spark, path, "title like '%threat'")) == ["cs/0001001"]


def test_raw_snapshot_round_trip(spark, landing, tmp_path):
    papers = read_atom(spark, str(landing))
    done = save_raw_data(papers, "s", str(tmp_path / "raw"))
    assert done["rows"] == 3 and done["size_bytes"] > 0
    assert sorted(load_raw_data(spark, "s", str(tmp_path / "raw")).collect()) == sorted(
        papers.collect()
    )
    # A snapshot may be replaced by something read from it.
    shorter = load_raw_data(spark, "s", str(tmp_path / "raw")).filter("id <> '7'")
    assert save_raw_data(shorter, "s", str(tmp_path / "raw"))["rows"] == 2
    assert load_raw_data(spark, "s", str(tmp_path / "raw")).count() == 2
    assert [p.name for p in (tmp_path / "raw").iterdir() if p.is_dir()] == ["s"]


def test_failed_snapshot_keeps_the_old_one(spark, landing, tmp_path):
    directory = str(tmp_path / "raw")
    save_raw_data(read_atom(spark, str(landing)), "s", directory)
    failing = load_raw_data(spark, "s", directory).withColumn("title", F.raise_error("no"))
    with pytest.raises(Exception, match="no"):
        save_raw_data(failing, "s", directory)
    assert load_raw_data(spark, "s", directory).count() == 3


def test_missing_snapshot_warns(spark, tmp_path):
    with pytest.warns(UserWarning, match="not found"):
        empty = load_raw_data(spark, "none", str(tmp_path))
    assert empty.schema == RAW_SCHEMA and empty.count() == 0


def test_only_data_frames_are_saved(tmp_path):
    with pytest.raises(TypeError):
        save_raw_data([1], "s", str(tmp_path))


def test_run_etl(spark, landing, tmp_path):
    store, raw = str(tmp_path / "store"), str(tmp_path / "raw")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        stats = run_etl(spark, str(landing), store, raw)
    assert (stats["raw"]["rows"], stats["inserted"], stats["updated"]) == (3, 3, 0)
    assert (stats["fetched"], stats["loaded"], stats["classified"]) == (3, 3, 3)
    tags = {r.paper_id: r.tag for r in load_publications(spark, store).collect()}
    assert tags == {"2512.00001": "Malware", "cs/0001001": "other", "7": "Malware"}
    # The paper without update date is always taken again.
    again = run_etl(spark, str(landing), store, raw)
    assert (again["inserted"], again["updated"], again["skipped"]) == (0, 1, 2)


def test_report_collects_only_without_a_snapshot(spark, landing, tmp_path):
    places = [str(tmp_path / name) for name in ("marts", "store", "raw")]
    for _ in range(2):
        paths = run_report(spark, str(landing), *places)
        days = spark.read.parquet(paths["pubs_by_day"])
        assert days.agg(F.sum("n")).first()[0] == 3
        assert spark.read.parquet(paths["has_data"]).first().has_data
        for page in landing.iterdir():
            page.unlink()


def test_failed_run_has_an_exit_code(spark, tmp_path):
    arguments = ["--landing", str(tmp_path / "nothing"), "--raw-dir", str(tmp_path / "raw")]
    assert main([*arguments, "--store", str(tmp_path / "store")]) == 1


def test_incremental_run_reads_only_new_pages(spark, landing, tmp_path):
    store, progress = str(tmp_path / "store"), str(tmp_path / "progress")

    def run():
        query = run_incremental_etl(spark, str(landing), store, progress, files_per_batch=1)
        assert query.awaitTermination(240)
        return query

    run()
    assert load_publications(spark, store).count() == 3
    newer = [entry("7", "2025-07-01T00:00:00Z", "A trojan"), entry("8", "2025-01-01T00:00:00Z")]
    (landing / "page-4.xml").write_text(PAGE.format(entries="\n".join(newer)))
    query = run()
    assert query.lastProgress["numInputRows"] <= 4
    rows = {r.paper_id: r.title for r in load_publications(spark, store).collect()}
    assert rows["7"] == "A trojan" and set(rows) == {"2512.00001", "cs/0001001", "7", "8"}
