"""Papers and publications derived from the sample tables.

Every relation covers all rows and whole texts of its tables.  The oracle SQL
in ``pubweave.plans.oracle`` derives the same relations independently.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pubweave.functions.vocabulary import TOPIC_KEYWORDS, distinct_keywords
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "nation": "n_nationkey int, n_name string",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
              " value double, props string",
}

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


_KEYWORDS = distinct_keywords(TOPIC_KEYWORDS)


def _keyword(number: str) -> str:
    words = ",".join(_KEYWORDS)
    return f"element_at(split('{words}', ','), cast({number} % {len(_KEYWORDS)} + 1 as int))"


def _moment(days: int) -> str:
    """ISO text of a day and second that depend on doc_id; German papers use
    the second accepted format."""
    day = f"date_add(date'2018-01-01', cast(doc_id * 7919 % 3600 + {days} as int))"
    seconds = "(doc_id * 37 % 86400)"
    clock = (
        f"concat_ws(':', lpad({seconds} div 3600, 2, '0'),"
        f" lpad({seconds} % 3600 div 60, 2, '0'), lpad({seconds} % 60, 2, '0'))"
    )
    return (
        f"if(lang = 'de', {day} || ' ' || {clock} || '.5', {day} || 'T' || {clock} || 'Z')"
    )


def raw_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in the raw layout, plus ``lang`` and ``n_chars``.

    Two keywords are appended to every text that is not Spanish.  Every nation is
    one more paper, without abstract and language.
    """
    nations = read_table(spark, sf_dir, "nation").selectExpr(
        "'n' || n_nationkey as id",
        "'http://example.org/abs/n' || n_nationkey || 'v1' as link",
        "n_name as title",
        "'Author 0' as authors",
        "cast(null as string) as abstract",
        "'cs.NI' as categories",
        "'2021-03-04T05:06:07Z' as published_date",
        "cast(null as string) as updated_date",
        "cast(null as string) as lang",
        "cast(null as bigint) as n_chars",
    )
    return read_table(spark, sf_dir, "documents").selectExpr(
        "'d' || doc_id as id",
        "'http://example.org/abs/d' || doc_id || 'v' || (doc_id % 12 + 1) as link",
        f"'On ' || {_keyword('doc_id * 5')} || ' in ' || source as title",
        """concat_ws('; ', 'Author ' || (doc_id % 37),
                     if(doc_id % 3 > 0, 'Author ' || (doc_id % 11), null),
                     if(doc_id % 5 = 0, ' ', null),
                     if(doc_id % 8 = 1, 'Müller, Jr.', null)) as authors""",
        f"""case when lang = 'es' then text
                 else text || ' ' || {_keyword('doc_id')} || '. '
                      || {_keyword('doc_id * 7')} end as abstract""",
        """case when doc_id % 4 = 0 then 'cs.CR; cs.LG'
                when doc_id % 4 = 1 then 'cs.CE'
                when doc_id % 4 = 2 then 'zz.ZZ;; cs.NI '
                when doc_id % 3 = 0 then null else '' end as categories""",
        f"{_moment(0)} as published_date",
        f"if(doc_id % 7 <> 0, {_moment(3)}, null) as updated_date",
        "lang",
        "n_chars",
    ).unionByName(nations)


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as papers whose abstract is the raw HTML."""
    return read_table(spark, sf_dir, "pages").selectExpr(
        "'p' || page_id as paper_id", "url as title", "html as abstract"
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as publications: sub-day dates, users as authors."""
    return read_table(spark, sf_dir, "events").selectExpr(
        "'e' || event_id as paper_id",
        "'User ' || user_id || ',  Team ' || (user_id % 10) || ' ' as authors",
        "ts as published_date",
        "event_type as tag",
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as raw papers: one row per turn, so many rows per id."""
    return read_table(spark, sf_dir, "conversations").selectExpr(
        "'c' || conv_id as id", "role as title", "text as abstract", "turn"
    )


def stored_publications(papers: DataFrame, pages: DataFrame) -> DataFrame:
    """A publications table: staged ``papers`` and undated ``pages``."""
    ingested = "timestamp_ntz'2024-01-01 00:00:00' as ingested_at"
    stored_papers = papers.selectExpr(
        "paper_id", "link", "title", "authors", "abstract", "categories",
        "published_date", "updated_date", ingested, "tag",
        "cast(length(abstract) as double) as umap_x",
        "cast(null as double) as umap_y",
    )
    stored_pages = pages.selectExpr(
        "paper_id", "title as link", "title", "'' as authors", "abstract",
        "'' as categories", "cast(null as timestamp_ntz) as published_date",
        "cast(null as timestamp_ntz) as updated_date", ingested, "'web' as tag",
        "cast(null as double) as umap_x", "cast(null as double) as umap_y",
    )
    return stored_papers.unionByName(stored_pages)


def second_batch(papers: DataFrame, turns: DataFrame) -> DataFrame:
    """Raw papers to save after ``papers``: each one again, with an earlier, the same or
    a later update, and one per conversation turn, many to a paper, some without id."""
    again = papers.selectExpr(
        "id", "link || '#again' as link", "title", "authors", "abstract", "categories",
        "published_date",
        """case length(title) % 3 when 0 then published_date when 1 then updated_date
           else '2031-01-01T00:00:00Z' end as updated_date""",
        "case length(link) % 4 when 0 then '' when 1 then '  ' when 2 then ' X ' end as tag",
    )
    new = turns.selectExpr(
        "if(title = 'system', null, id) as id", "'turn ' || turn as link", "title",
        "'' as authors", "abstract", "'' as categories",
        "'2024-01-01T00:00:00Z' as published_date",
        "'2024-01-01T' || lpad(turn % 24, 2, '0') || ':00:00Z' as updated_date",
        "' q ' as tag",
    )
    return again.unionByName(new)


def _element(name: str, text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.when(
        text.isNotNull(),
        F.concat(F.lit(f"<{name}>"), escaped, F.lit(f"</{name}>")),
    )


def atom_entry() -> Column:
    """A raw paper as an Atom entry."""
    authors = F.transform(
        F.split("authors", "; "),
        lambda name: F.concat(F.lit("<author>"), _element("name", name), F.lit("</author>")),
    )
    categories = F.transform(
        F.filter(F.split("categories", ";"), lambda code: F.trim(code) != ""),
        lambda code: F.concat(F.lit('<category term="'), F.trim(code), F.lit('"/>')),
    )
    return F.concat_ws(
        "\n  ",
        F.lit("<entry>"),
        _element("id", F.col("link")),
        _element("title", F.col("title")),
        _element("summary", F.col("abstract")),
        _element("published", F.col("published_date")),
        _element("updated", F.col("updated_date")),
        F.array_join(authors, ""),
        F.array_join(categories, ""),
        F.lit("</entry>"),
    )


def incoming_papers(staged: DataFrame, turns: DataFrame) -> DataFrame:
    """A staged batch: every stored document again, a day earlier, the same day
    or a day later, and one paper per conversation turn, with many turns to a
    paper and no key for system turns."""
    again = staged.selectExpr(
        "paper_id", "link || '#again' as link", "title", "authors", "abstract",
        "categories", "published_date",
        """if(length(title) % 10 > 0,
              updated_date + make_dt_interval(length(title) % 3 - 1), null)
           as updated_date""",
        """case length(link) % 4 when 0 then '' when 1 then '  ' when 2 then ' X '
           end as tag""",
    )
    start = "timestamp_ntz'2024-01-01 00:00:00'"
    new = turns.selectExpr(
        "if(title = 'system', null, id) as paper_id", "'turn ' || turn as link",
        "title", "'' as authors", "abstract", "'' as categories",
        f"{start} as published_date",
        f"{start} + make_dt_interval(0, cast(turn as int)) as updated_date",
        "' q ' as tag",
    )
    return again.unionByName(new)


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, nothing merged."""
    return reduce(DataFrame.unionByName, parts)
