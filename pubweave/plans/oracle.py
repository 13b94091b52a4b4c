"""The queries again as SQL for DuckDB, written against the same tables.

The SQL takes other routes than the Spark plans where it can: keywords are
matched one by one, dates are computed as timestamps, words are removed from
lists of runs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pubweave.functions.vocabulary import (
    ABSTRACT_STOPWORDS,
    BY_TAG_STOPWORDS,
    CATEGORY_LABELS,
    CLEANER_STOPWORDS,
    CORPUS_CATEGORIES,
    CORPUS_TERMS,
    OVERALL_STOPWORDS,
    SNOWBALL_STOPWORDS,
    TOPIC_KEYWORDS,
    distinct_keywords,
)

ALNUM = r"\p{L}\p{Nd}"
SPACE = r"\s\p{Z}\x{85}\x0b"
EDGE = r"[^\p{L}\p{M}\p{Nd}_]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in_list(*lists: Iterable[str]) -> str:
    return ", ".join(_quoted(w) for w in sorted({w for ws in lists for w in ws}))


def _list(values: Iterable[str]) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


def _moment(days: int) -> str:
    moment = (
        f"TIMESTAMP '2018-01-01' + to_days(CAST(doc_id * 7919 % 3600 + {days} AS INTEGER))"
        " + to_seconds(doc_id * 37 % 86400)"
    )
    return (
        f"CASE WHEN lang = 'de' THEN strftime({moment}, '%Y-%m-%d %H:%M:%S.5')"
        f" ELSE strftime({moment}, '%Y-%m-%dT%H:%M:%SZ') END"
    )


RAW = f"""
raw AS (
  SELECT 'd' || doc_id AS id,
         'http://example.org/abs/d' || doc_id || 'v' || (doc_id % 12 + 1) AS link,
         'On ' || kw[doc_id * 5 % len(kw) + 1] || ' in ' || source AS title,
         concat_ws('; ', 'Author ' || (doc_id % 37),
                   CASE WHEN doc_id % 3 > 0 THEN 'Author ' || (doc_id % 11) END,
                   CASE WHEN doc_id % 5 = 0 THEN ' ' END,
                   CASE WHEN doc_id % 8 = 1 THEN 'Müller, Jr.' END) AS authors,
         CASE WHEN lang = 'es' THEN text
              ELSE text || ' ' || kw[doc_id % len(kw) + 1] || '. '
                   || kw[doc_id * 7 % len(kw) + 1] END AS abstract,
         CASE WHEN doc_id % 4 = 0 THEN 'cs.CR; cs.LG'
              WHEN doc_id % 4 = 1 THEN 'cs.CE'
              WHEN doc_id % 4 = 2 THEN 'zz.ZZ;; cs.NI '
              WHEN doc_id % 3 = 0 THEN NULL ELSE '' END AS categories,
         {_moment(0)} AS published_date,
         CASE WHEN doc_id % 7 <> 0 THEN {_moment(3)} END AS updated_date,
         lang, n_chars
  FROM documents,
       (SELECT {_list(distinct_keywords(TOPIC_KEYWORDS))} AS kw)
  UNION ALL
  SELECT 'n' || n_nationkey, 'http://example.org/abs/n' || n_nationkey || 'v1', n_name,
         'Author 0', NULL, 'cs.NI', '2021-03-04T05:06:07Z', NULL, NULL, NULL
  FROM nation
)"""

_ITEMS = (
    "list_filter(list_transform(string_split({0}, ';'), lambda x: trim(x)),"
    " lambda x: x <> '')"
)
_LABELS = "MAP {" + ", ".join(
    f"{_quoted(code)}: {_quoted(label)}" for code, label in CATEGORY_LABELS.items()
) + "}"
AUTHORS = f"coalesce(array_to_string({_ITEMS.format('authors')}, ', '), '')"
CATEGORIES = (
    f"coalesce(array_to_string(list_transform({_ITEMS.format('categories')},"
    f" lambda x: coalesce(({_LABELS})[x], x)), ', '), '')"
)


def _parsed(column: str) -> str:
    return f"CAST(replace(replace({column}, 'T', ' '), 'Z', '') AS TIMESTAMP)"


STAGED = f"""
staged AS (
  SELECT id AS paper_id, link, title, {AUTHORS} AS authors, abstract,
         {CATEGORIES} AS categories, {_parsed('published_date')} AS published_date,
         {_parsed('updated_date')} AS updated_date, lang AS tag
  FROM raw
)"""

STORED = """
stored AS (
  SELECT paper_id, link, title, authors, abstract, categories, published_date,
         updated_date, tag, CAST(length(abstract) AS DOUBLE) AS umap_x,
         CAST(NULL AS DOUBLE) AS umap_y
  FROM staged
  UNION ALL
  SELECT 'p' || page_id, url, url, '', html, '', NULL, NULL, 'web', NULL, NULL
  FROM pages
)"""

INCOMING = """
incoming AS (
  SELECT paper_id, link || '#again' AS link, title, authors, abstract, categories,
         published_date,
         CASE WHEN length(title) % 10 > 0
              THEN updated_date + to_days(CAST(length(title) % 3 - 1 AS INTEGER))
              END AS updated_date,
         CASE length(link) % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN ' X '
              END AS tag
  FROM staged
  UNION ALL
  SELECT CASE WHEN role <> 'system' THEN 'c' || conv_id END, 'turn ' || turn, role,
         '', text, '', TIMESTAMP '2024-01-01',
         TIMESTAMP '2024-01-01' + to_hours(turn), ' q '
  FROM conversations
)"""

NEWEST = """
newest AS (
  SELECT * EXCLUDE (rn)
  FROM (SELECT *, count(*) OVER (PARTITION BY paper_id) AS copies,
               row_number() OVER (
                 PARTITION BY paper_id
                 ORDER BY updated_date DESC NULLS LAST, link DESC NULLS LAST,
                          title DESC NULLS LAST, authors DESC NULLS LAST,
                          abstract DESC NULLS LAST, categories DESC NULLS LAST,
                          published_date DESC NULLS LAST, tag DESC NULLS LAST) AS rn
        FROM incoming)
  WHERE rn = 1
)"""

ACTION = """
CASE WHEN s.paper_id IS NULL OR s.paper_id = '' THEN 'keep'
     WHEN p.paper_id IS NULL THEN 'insert'
     WHEN p.updated_date IS NULL OR s.updated_date IS NULL
          OR s.updated_date > p.updated_date THEN 'update'
     ELSE 'keep' END"""

EVENTS = """
event_log AS (
  SELECT 'e' || event_id AS paper_id,
         'User ' || user_id || ',  Team ' || (user_id % 10) || ' ' AS authors,
         ts AS published_date, event_type AS tag
  FROM events
)"""

_KEYWORD_ROWS = ", ".join(
    f"({t}, {_quoted(tag)}, {k}, {_quoted(word)})"
    for t, (tag, keywords) in enumerate(TOPIC_KEYWORDS.items())
    for k, word in enumerate(keywords)
)

KEYWORD_HITS = rf"""
keywords(tag_order, tag, kw_order, keyword) AS (VALUES {_KEYWORD_ROWS}),
lowered AS MATERIALIZED (SELECT id, lower(abstract) AS abstract FROM raw),
hits AS (
  SELECT * FROM lowered JOIN keywords ON contains(abstract, keyword)
  WHERE regexp_matches(abstract, '(^|{EDGE})' || keyword || '($|{EDGE})')
)"""

SCORES = """
scores AS (
  SELECT id, tag, tag_order,
         list_reduce(list(CAST(length(keyword) AS DOUBLE) * CAST(0.1 AS DOUBLE)
                          ORDER BY kw_order), lambda a, b: a + b) AS score
  FROM hits GROUP BY ALL
)"""

CLASSIFIED = """
best AS (
  SELECT id, tag
  FROM scores
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, tag_order) = 1
),
classified AS (
  SELECT raw.*, coalesce(best.tag, 'other') AS tag FROM raw LEFT JOIN best USING (id)
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_CLASSIFY = (RAW, KEYWORD_HITS, SCORES, CLASSIFIED)
_TAG_PATTERN = r"<[^>\n\x0b\f\r\x{85}\x{2028}\x{2029}]*>"
_STRIPPED = f"regexp_replace(lower(abstract), '{_TAG_PATTERN}', '', 'g')"


def _words(relation: str, keep: str = "", where: str = "true") -> str:
    return rf"""
words AS (
  SELECT * FROM (
    SELECT {keep} unnest(string_split(
             regexp_replace({_STRIPPED}, '[^{ALNUM}]', ' ', 'g'), ' ')) AS word
    FROM {relation} WHERE abstract IS NOT NULL AND {where})
  WHERE regexp_full_match(word, '[a-z]{{3,}}')
)"""


def _top_words(relation: str, n: int) -> str:
    return f"""
SELECT word, count(*) AS n FROM words
WHERE word NOT IN ({_in_list(SNOWBALL_STOPWORDS, OVERALL_STOPWORDS)})
GROUP BY word ORDER BY n DESC, word LIMIT {n}"""


def _ranked_words(n: int) -> str:
    return f"""
SELECT tag, word, n, CAST(rank AS INTEGER) AS rank
FROM (SELECT tag, word, n,
             row_number() OVER (PARTITION BY tag ORDER BY n DESC, word) AS rank
      FROM (SELECT tag, word, count(*) AS n FROM words
            WHERE word NOT IN ({_in_list(SNOWBALL_STOPWORDS, BY_TAG_STOPWORDS)})
            GROUP BY tag, word))
WHERE rank <= {n}"""


def _loaded(where: str = "true", columns: str = "*", limit: str = "") -> str:
    return f"""{_with(RAW, STAGED, STORED)},
loaded AS (
  SELECT paper_id, link, title, authors, abstract, categories, published_date,
         updated_date, tag
  FROM stored WHERE {where}
  ORDER BY updated_date DESC NULLS LAST, published_date DESC NULLS LAST, paper_id {limit}
)
SELECT {columns} FROM loaded"""


def _search(pattern: str) -> str:
    return (
        f"(coalesce(regexp_matches(lower(title), '{pattern}'), false)"
        f" OR coalesce(regexp_matches(lower(abstract), '{pattern}'), false))"
    )


def _runs_without(text: str, condition: str) -> str:
    return (
        f"array_to_string(list_filter(regexp_extract_all({text},"
        f" '[{ALNUM}]+|[^{ALNUM}]+'), lambda r: NOT ({condition})), '')"
    )


def _cleaned() -> str:
    kept = f"regexp_replace({_STRIPPED}, '[^{ALNUM}{SPACE}-]', '', 'g')"
    no_short = _runs_without(
        kept,
        f"regexp_full_match(r, '[{ALNUM}]') OR regexp_full_match(r, '\\p{{Nd}}+')",
    )
    squished = f"trim(regexp_replace({no_short}, '[{SPACE}]+', ' ', 'g'))"
    return _runs_without(squished, f"r IN ({_in_list(CLEANER_STOPWORDS)})")


def _corpus_rows() -> str:
    terms = f"(^|{EDGE})({'|'.join(CORPUS_TERMS)})($|{EDGE})"
    fields = " OR ".join(
        f"coalesce(regexp_matches(lower({f}), '{terms}'), false)"
        for f in ("title", "abstract", "authors")
    )
    return f"""SELECT * EXCLUDE (lang, n_chars) FROM raw
WHERE list_has_any({_ITEMS.format('categories')}, {_list(CORPUS_CATEGORIES)})
  AND {_parsed('published_date')} >= TIMESTAMP '2020-01-01 00:00:00'
  AND {_parsed('published_date')} < TIMESTAMP '2026-01-01 00:00:00'
  AND ({fields})"""


_MERGE_COLUMNS = "link title authors abstract categories published_date updated_date".split()


def _merged(
    relations: tuple[str, ...] = (RAW, STAGED, STORED, INCOMING, NEWEST), stored: str = "stored"
) -> str:
    taken = ", ".join(
        f"CASE WHEN action = 'keep' THEN p_{c} ELSE s_{c} END AS {c}"
        for c in _MERGE_COLUMNS
    )
    sides = ", ".join(f"p.{c} AS p_{c}, s.{c} AS s_{c}" for c in _MERGE_COLUMNS)
    return f"""{_with(*relations)},
usable AS (SELECT * FROM newest WHERE paper_id IS NOT NULL AND paper_id <> ''),
joined AS (
  SELECT coalesce(p.paper_id, s.paper_id) AS paper_id, {sides}, p.tag AS p_tag,
         s.tag AS s_tag, p.umap_x, p.umap_y, {ACTION} AS action
  FROM {stored} p FULL OUTER JOIN usable s ON p.paper_id = s.paper_id
)
SELECT paper_id, {taken},
       CASE action WHEN 'keep' THEN p_tag WHEN 'insert' THEN s_tag
            ELSE coalesce(nullif(trim(s_tag), ''), p_tag) END AS tag,
       umap_x, umap_y, action
FROM joined"""


SECOND = f"""
first_papers AS (
  SELECT *, NULL::DOUBLE AS umap_x, NULL::DOUBLE AS umap_y FROM staged
),
second_papers AS (
  SELECT paper_id, link || '#again' AS link, title, authors, abstract, categories,
         published_date,
         CASE length(title) % 3 WHEN 0 THEN published_date WHEN 1 THEN updated_date
              ELSE TIMESTAMP '2031-01-01' END AS updated_date,
         CASE length(link) % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN ' X '
              END AS tag
  FROM staged
  UNION ALL
  SELECT CASE WHEN role <> 'system' THEN 'c' || conv_id END, 'turn ' || turn, role,
         '', text, '', TIMESTAMP '2024-01-01',
         TIMESTAMP '2024-01-01' + to_hours(turn % 24), ' q '
  FROM conversations
),
{NEWEST.strip().replace('FROM incoming)', 'FROM second_papers)')}"""

_PUBS = """
pubs AS (
  SELECT staged.* EXCLUDE (tag), classified.tag FROM staged
  JOIN classified ON classified.id = staged.paper_id
)"""


def _store_oracles(by_author: str, staged_authors: str, n_authors: str) -> dict[str, str]:
    """SQL of the queries that run through files."""
    merged = _merged((RAW, STAGED, SECOND), "first_papers")
    pubs = _with(*_CLASSIFY, STAGED, _PUBS)
    dated = _with(RAW, STAGED)
    return {
        "store_round_trip": f"SELECT * EXCLUDE (action, umap_x, umap_y) FROM ({merged})",
        "store_counts": f"""{_with(RAW, STAGED, SECOND)}, actions AS (
  SELECT {ACTION} AS action
  FROM newest s LEFT JOIN first_papers p ON p.paper_id = s.paper_id)
SELECT 1 AS save, count(*) AS inserted, 0 AS updated, 0 AS skipped FROM staged
UNION ALL
SELECT 2, count(*) FILTER (action = 'insert'), count(*) FILTER (action = 'update'),
       (SELECT count(*) FROM second_papers) - count(*) FILTER (action <> 'keep')
FROM actions""",
        "load_store_year": f"""SELECT * EXCLUDE (action, umap_x, umap_y) FROM ({merged})
WHERE extract(year FROM published_date) = 2022""",
        "load_absent_store": f"{dated} SELECT paper_id, title, tag FROM staged WHERE paper_id <> ''",
        "raw_absent_snapshot": f"{_with(RAW)} SELECT * EXCLUDE (lang, n_chars) FROM raw",
        "etl_counts": f"""{dated}, chosen AS ({_corpus_rows()})
SELECT count(*) AS fetched, count(*) AS loaded, count(*) AS classified,
       count(*) AS inserted, 0 AS updated, 0 AS skipped FROM chosen""",
        "report_months": f"""{dated}, chosen AS ({_corpus_rows()})
SELECT CAST(date_trunc('month', published_date) AS DATE) AS month, count(*) AS n
FROM staged WHERE paper_id IN (SELECT id FROM chosen) GROUP BY month""",
        "report_authors": _with(
            RAW, STAGED, f"chosen AS ({_corpus_rows()})",
            "listed AS (SELECT * FROM staged WHERE paper_id IN (SELECT id FROM chosen))",
            staged_authors.format("listed"),
        ) + by_author,
        "raw_round_trip": f"{_with(RAW)} SELECT * EXCLUDE (lang, n_chars) FROM raw",
        "etl_papers": f"""{pubs}, chosen AS ({_corpus_rows()})
SELECT paper_id, title, authors, categories, published_date, updated_date, tag
FROM pubs WHERE paper_id IN (SELECT id FROM chosen)""",
        "mart_has_data": f"{dated} SELECT count(*) > 0 AS has_data FROM staged",
        "mart_pubs_by_day": f"""{dated}
SELECT CAST(published_date AS DATE) AS day, count(*) AS n FROM staged GROUP BY day""",
        "mart_pubs_by_month": f"""{dated}
SELECT CAST(date_trunc('month', published_date) AS DATE) AS month, count(*) AS n
FROM staged GROUP BY month""",
        "mart_pubs_by_weekday": f"""{dated}
SELECT CAST(isodow(published_date) - 1 AS INTEGER) AS weekday_idx,
       ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][isodow(published_date)] AS weekday,
       ['Пн', 'Вт', 'Ср', 'Чт', 'Пт', 'Сб', 'Вс'][isodow(published_date)] AS weekday_ru,
       count(*) AS n
FROM staged WHERE published_date IS NOT NULL GROUP BY ALL""",
        "mart_top_authors": f"{_with(RAW, STAGED, staged_authors.format('staged'))} {by_author}",
        "mart_author_counts": f"{dated} SELECT paper_id, {n_authors} AS n_authors FROM staged",
        "mart_authors_per_paper": f"""{dated}
SELECT {n_authors} AS n_authors, count(*) AS n FROM staged GROUP BY 1""",
        "mart_tag_counts": f"{pubs} SELECT tag, count(*) AS n FROM pubs GROUP BY tag",
        "mart_tag_share": f"""{pubs}
SELECT tag, n, round_even(CAST(n AS DOUBLE) / (SELECT count(*) FROM pubs) * 100, 1)
         AS percentage
FROM (SELECT tag, count(*) AS n FROM pubs GROUP BY tag)""",
        "mart_top_words": _with(RAW, _words("raw")) + _top_words("raw", 30),
        "mart_topic_words": _with(
            *_CLASSIFY, _words("classified", "tag,", "tag <> 'other'")
        ) + _ranked_words(5),
    }


def all_oracles() -> dict[str, str]:
    """SQL by query name."""
    merged = _merged()
    staged_authors = """
author_rows AS (
  SELECT paper_id, trim(unnest(string_split_regex(authors, ',\\s*'))) AS authors
  FROM {0} WHERE authors IS NOT NULL
)"""
    by_author = """
SELECT authors, count(*) AS n FROM author_rows
GROUP BY authors ORDER BY n DESC, authors LIMIT 10"""
    n_authors = "CAST(length(authors) - length(replace(authors, ',', '')) + 1 AS INTEGER)"
    atom_entries = f"""{_with(RAW)}
SELECT regexp_extract(link, 'abs/(.*)v', 1) AS id, link, title,
       array_to_string(list_transform(string_split(authors, '; '), lambda x: trim(x)), '; ')
         AS authors,
       trim(abstract, ' \t' || chr(10) || chr(13)) AS abstract,
       coalesce(array_to_string({_ITEMS.format('categories')}, '; '), '') AS categories,
       published_date, updated_date
FROM raw"""
    return _store_oracles(by_author, staged_authors, n_authors) | {
        "atom_entries": atom_entries,
        "atom_files": atom_entries,
        "pages_union": f"""{_with(RAW)}
SELECT id, title, abstract FROM raw
UNION ALL SELECT 'p' || page_id, url, html FROM pages
UNION ALL SELECT 'c' || conv_id, role, text FROM conversations""",
        "corpus_filter": f"{_with(RAW)} {_corpus_rows()}",
        "newest_first_topn": f"""{_with(EVENTS)}
SELECT * FROM event_log ORDER BY published_date DESC NULLS LAST, paper_id LIMIT 100""",
        "paper_id_from_link": f"{_with(RAW)} SELECT id, id AS paper_id FROM raw",
        "authors_normalized": f"{_with(RAW)} SELECT id, {AUTHORS} AS authors FROM raw",
        "categories_named": f"{_with(RAW)} SELECT id, {CATEGORIES} AS categories FROM raw",
        "timestamps_parsed": f"""{_with(RAW)}
SELECT id, {_parsed('published_date')} AS published_date,
       {_parsed('updated_date')} AS updated_date FROM raw""",
        "staged_publications": f"{_with(RAW, STAGED)} SELECT * FROM staged",
        "search_regex": f"""{_with(RAW)}
SELECT id, title FROM raw WHERE {_search('mal.are|phish(ing|er)')}""",
        "search_regex_year": f"""{_with(RAW)}
SELECT id, title, published_date FROM raw
WHERE {_search('attack')} AND year({_parsed('published_date')}) = 2024""",
        "load_publications_ordered": _loaded(),
        "load_all_filters": _loaded(
            "EXTRACT(year FROM published_date) = 2023"
            " AND lower(categories) LIKE '%cryptography and security%'"
            " AND (lower(title) LIKE '%attack%' OR lower(abstract) LIKE '%attack%')"
        ),
        "load_year": _loaded(
            "EXTRACT(year FROM published_date) = 2022", "paper_id, published_date"
        ),
        "load_limit": _loaded(limit="LIMIT 50"),
        "load_like_wildcard": _loaded(
            "lower(title) LIKE '%mal_are%src%' OR lower(abstract) LIKE '%mal_are%src%'",
            "paper_id, title",
        ),
        "load_category_code": _loaded(
            "lower(categories) LIKE '%zz.zz%'", "paper_id, categories"
        ),
        "papers_by_day": f"""{_with(RAW, STAGED, STORED)}
SELECT CAST(published_date AS DATE) AS day, count(*) AS n FROM stored GROUP BY day""",
        "papers_by_month": f"""{_with(RAW, STAGED, STORED)}
SELECT CAST(date_trunc('month', published_date) AS DATE) AS month, count(*) AS n
FROM stored GROUP BY month""",
        "events_by_day": """
SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY day""",
        "papers_by_weekday": f"""{_with(EVENTS)}
SELECT CAST(idx AS INTEGER) AS weekday_idx, label AS weekday, label_ru AS weekday_ru, n
FROM (SELECT isodow(published_date) - 1 AS idx, count(*) AS n FROM event_log
      WHERE published_date IS NOT NULL GROUP BY idx)
JOIN (VALUES (0, 'Mon', 'Пн'), (1, 'Tue', 'Вт'), (2, 'Wed', 'Ср'), (3, 'Thu', 'Чт'),
             (4, 'Fri', 'Пт'), (5, 'Sat', 'Сб'), (6, 'Sun', 'Вс')) l(i, label, label_ru)
  ON i = idx""",
        "author_rows": f"""{_with(RAW, STAGED, staged_authors.format('staged'))}
SELECT paper_id, authors FROM author_rows""",
        "top_authors": f"{_with(RAW, STAGED, staged_authors.format('staged'))} {by_author}",
        "top_event_users": f"{_with(EVENTS, staged_authors.format('event_log'))} {by_author}",
        "author_counts": f"""{_with(RAW, STAGED)}
SELECT paper_id, {n_authors} AS n_authors FROM staged""",
        "authors_per_paper_hist": f"""{_with(RAW, STAGED)}
SELECT {n_authors} AS n_authors, count(*) AS n FROM staged GROUP BY 1""",
        "tag_counts": f"""{_with(*_CLASSIFY)}
SELECT tag, count(*) AS n FROM classified GROUP BY tag""",
        "tag_share": f"""{_with(*_CLASSIFY)}
SELECT tag, n, round_even(CAST(n AS DOUBLE) / (SELECT count(*) FROM raw) * 100, 1)
         AS percentage
FROM (SELECT tag, count(*) AS n FROM classified GROUP BY tag)""",
        "has_data": f"""{_with(RAW, STAGED, STORED)}
SELECT count(*) > 0 AS has_data FROM stored""",
        "classify_papers": f"{_with(*_CLASSIFY)} SELECT id, tag FROM classified",
        "keyword_presence": f"""{_with(RAW, KEYWORD_HITS)}
SELECT DISTINCT id, keyword FROM hits""",
        "keyword_scores": f"""{_with(RAW, KEYWORD_HITS, SCORES)}
SELECT id, tag, score FROM scores""",
        "top_words": _with(RAW, _words("raw")) + _top_words("raw", 30),
        "top_words_html": "WITH" + _words(
            "(SELECT html AS abstract FROM pages)"
        ) + _top_words("pages", 100),
        "word_counts_by_tag": f"""{_with(RAW, _words('raw', 'lang AS tag,'))}
SELECT tag, word, count(*) AS n FROM words
WHERE word NOT IN ({_in_list(SNOWBALL_STOPWORDS, ABSTRACT_STOPWORDS)})
GROUP BY tag, word""",
        "top_words_by_tag": f"""{_with(*_CLASSIFY, _words('classified', 'tag,', "tag <> 'other'"))}
SELECT tag, word, n FROM ({_ranked_words(5)})""",
        "topic_words_ranked": _with(
            *_CLASSIFY, _words("classified", "tag,", "tag <> 'other'")
        ) + _ranked_words(10),
        "clean_text": f"{_with(RAW)} SELECT id, {_cleaned()} AS cleaned FROM raw",
        "newest_per_key": f"{_with(RAW, STAGED, INCOMING, NEWEST)} SELECT * FROM newest",
        "new_papers_only": f"""{_with(RAW, STAGED, STORED, INCOMING)}
SELECT paper_id, link, updated_date FROM incoming s
WHERE paper_id IS NOT NULL AND paper_id <> ''
  AND NOT EXISTS (SELECT 1 FROM stored p WHERE p.paper_id = s.paper_id)""",
        "upsert_merge": merged,
        "upsert_changes": f"{merged} WHERE action <> 'keep'",
        "upsert_counts": f"""{_with(RAW, STAGED, STORED, INCOMING, NEWEST)}
SELECT count(*) FILTER (action = 'insert') AS inserted,
       count(*) FILTER (action = 'update') AS updated,
       (SELECT count(*) FROM incoming) - count(*) FILTER (action <> 'keep') AS skipped
FROM (SELECT {ACTION} AS action
      FROM newest s LEFT JOIN stored p ON p.paper_id = s.paper_id)""",
    }
