"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_OP1 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_KINDS = [
    (
        "assign",
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]"
        r"|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''"),
        2,
        8,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]


def _spans(order: int) -> str:
    kind, pattern, group, least = _KINDS[order]
    return f"""
  SELECT doc_id, row, source, repo, {order} AS ord, '{kind}' AS kind, hit, value,
         (list_sum([length(x) for x in gaps[1:i]])
          + coalesce(list_sum([length(x) for x in hits[1:i - 1]]), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit,
               unnest("values") AS value
        FROM (SELECT *, string_split_regex(t, '{pattern}') AS gaps,
                     regexp_extract_all(t, '{pattern}') AS hits,
                     regexp_extract_all(t, '{pattern}', {group}) AS "values" FROM texts))
  WHERE length(value) >= {least}"""


_OP4 = f"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS source, concat_ws('/', source, lang) AS repo,
         coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
spans AS ({" UNION ALL ".join(_spans(k) for k in range(3))}),
owners AS (
  SELECT value, count(DISTINCT source) AS n, count(DISTINCT repo) AS n_repos
  FROM spans GROUP BY value),
base AS (
  SELECT row, ord, s, kind || ':' || s || ':' || (s + length(hit)) AS span,
         n = 1 AND n_repos <= 3 AS live, n_repos || ':' || n AS spread,
         'live:' || s || ':' || (s + length(hit)) AS live_span
  FROM spans JOIN owners USING (value)),
everything AS (
  SELECT row, ord, s, span, TRUE AS is_base, spread FROM base
  UNION ALL SELECT row, ord + 3, s, live_span, FALSE, NULL FROM base WHERE live),
joined AS (
  SELECT row, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access,
         count(*) FILTER (ord = 2) AS n_hex, count(*) FILTER (NOT is_base) AS n_live,
         string_agg(span, ',' ORDER BY s, ord) FILTER (is_base) AS base,
         string_agg(span, ',' ORDER BY s, ord) AS spans,
         string_agg(spread, ',' ORDER BY s, ord) FILTER (is_base) AS spread
  FROM everything GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(spread, '') AS spread
FROM texts LEFT JOIN joined USING (row)
"""


_OP11 = r"""
WITH RECURSIVE pieces AS (
  SELECT coalesce(lang, 'und') AS lang, piece, row_number() OVER () AS piece_id
  FROM (SELECT lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
words AS (
  SELECT lang, piece_id, ws[i] AS w, i
  FROM (SELECT lang, piece_id, ws, unnest(range(1, len(ws) + 1)) AS i
        FROM (SELECT lang, piece_id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces))),
places AS (
  SELECT lang, w AS a1, lead(w, 1) OVER p AS a2, lead(w, 2) OVER p AS a3, lead(w, 3) OVER p AS a4
  FROM words WINDOW p AS (PARTITION BY piece_id ORDER BY i)),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
grams AS (
  SELECT lang, a1 AS g, 1 AS k, count(*) AS f FROM places GROUP BY lang, a1
  UNION ALL SELECT lang, a1 || ' ' || a2, 2, count(*) FROM places WHERE a2 IS NOT NULL
  GROUP BY lang, a1, a2
  UNION ALL SELECT lang, a1 || ' ' || a2 || ' ' || a3, 3, count(*) FROM places
  WHERE a3 IS NOT NULL GROUP BY lang, a1, a2, a3
  UNION ALL SELECT lang, a1 || ' ' || a2 || ' ' || a3 || ' ' || a4, 4, count(*) FROM places
  WHERE a4 IS NOT NULL GROUP BY lang, a1, a2, a3, a4),
frequent AS MATERIALIZED (
  SELECT lang, g, k, f, string_split(g, ' ') AS ws FROM grams WHERE f >= 30),
shorter AS (
  SELECT lang, array_to_string(ws[1:k - 1], ' ') AS g, f FROM frequent WHERE k > 2
  UNION ALL SELECT lang, array_to_string(ws[2:k], ' '), f FROM frequent WHERE k > 2
  UNION ALL SELECT lang, array_to_string(ws[i:i + 1], ' '), f
  FROM frequent, (VALUES (1), (2), (3)) AS spot(i) WHERE k = 4),
longer AS (SELECT lang, g, max(f) AS more FROM shorter GROUP BY lang, g),
kept AS (
  SELECT frequent.* FROM frequent LEFT JOIN longer USING (lang, g)
  WHERE k > 1 AND NOT coalesce(100 * more::HUGEINT >= 80 * f::HUGEINT, FALSE)),
cuts AS (
  SELECT kept.lang, kept.g, kept.k, kept.f AS a, spot.c, x.f AS l, y.f AS r,
         2000000 * kept.f::HUGEINT // (x.f + y.f) AS score
  FROM kept JOIN (VALUES (1), (2), (3)) AS spot(c) ON spot.c < kept.k
  JOIN frequent x ON x.lang = kept.lang AND x.g = array_to_string(kept.ws[1:spot.c], ' ')
  JOIN frequent y ON y.lang = kept.lang AND y.g = array_to_string(kept.ws[spot.c + 1:kept.k], ' ')),
lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank
  FROM lowest),
edges AS (
  SELECT lang, g, f, array_to_string(ws[1:3], ' ') AS tail, array_to_string(ws[2:4], ' ') AS head
  FROM frequent WHERE k = 4),
steps AS (
  SELECT x.lang, x.g AS g, y.g AS next FROM edges x
  JOIN frequent v ON v.lang = x.lang AND v.g = x.head AND v.f = x.f
  JOIN edges y ON y.lang = x.lang AND y.tail = x.head AND y.f = x.f),
walk AS (
  SELECT lang, g AS root, g FROM edges ANTI JOIN steps s ON s.lang = edges.lang AND s.next = edges.g
  UNION ALL SELECT walk.lang, root, next FROM walk JOIN steps USING (lang, g)),
passages AS (
  SELECT lang, g, count(*) OVER (PARTITION BY lang, root) + 3 AS passage_words FROM walk)
SELECT lang, rank, g AS phrase, a, l, r, n, score::BIGINT AS score, passage_words
FROM ranked JOIN totals USING (lang) LEFT JOIN passages USING (lang, g) WHERE rank <= 2000
"""


def llm_oracles() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op4_secret_scan": _OP4, "op11_collocations": _OP11}
