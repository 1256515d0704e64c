"""SQL (in DuckDB's dialect) of the pairwise problems, by all pairs of tokens: for small tables, where it is the plainest statement of what is meant."""

from __future__ import annotations

HAN = r"[\x{3005}\x{3007}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]"
BLANK = r"[\s\p{Z}\x{85}\x{feff}\x{200b}-\x{200d}\x{2060}\x{1c}-\x{1f}]"


def token_rows(source: str) -> str:
    """``source``: a query of s, r, t. One row for each distinct token of a text: runs of letters or digits, pairs of adjacent Han characters."""
    runs = f"regexp_extract_all(regexp_replace(lower(coalesce(t, '')), '({HAN}+)', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"
    pairs = "flatten(list_transform(list_filter(runs, lambda x: han(x)), lambda x: list_transform(range(1, length(x)), lambda i: substring(x, CAST(i AS INTEGER), 2))))"
    pairs = pairs.replace("han(x)", f"regexp_matches(x, '^{HAN}')")
    words = f"list_filter(runs, lambda x: NOT regexp_matches(x, '^{HAN}'))"
    return f"SELECT s, r, unnest(list_distinct(list_concat({words}, {pairs}))) AS tok FROM (SELECT s, r, {runs} AS runs FROM ({source}))"


def links(left: str, right: str, order: str) -> str:
    """Pairs (s, a, b) of rows of two token tables, in ``order`` (a condition on a.r and b.r), that share 60 % of all their tokens."""
    return f"""SELECT s, a, b FROM (SELECT a.s AS s, a.r AS a, b.r AS b, count(*) AS n FROM {left} a JOIN {right} b ON a.s = b.s AND a.tok = b.tok AND {order} GROUP BY 1, 2, 3) p
  JOIN (SELECT s, r AS a, count(*) AS na FROM {left} GROUP BY 1, 2) USING (s, a) JOIN (SELECT s, r AS b, count(*) AS nb FROM {right} GROUP BY 1, 2) USING (s, b) WHERE 5 * n >= 3 * (na + nb - n)"""


P1_FOUND = f"""
WITH RECURSIVE src AS (SELECT 'edition_items' AS s, item_row AS r, coalesce(title, '') || ' ' || coalesce(summary, '') AS t FROM edition_items UNION ALL SELECT 'articles', article_row, description FROM articles),
tok AS MATERIALIZED ({token_rows('SELECT * FROM src')}),
link AS MATERIALIZED ({links('tok', 'tok', 'a.r < b.r')}),
both_ways AS MATERIALIZED (SELECT s, a, b FROM link UNION ALL SELECT s, b, a FROM link),
reach AS (SELECT s, a, b FROM both_ways UNION SELECT q.s, q.a, w.b FROM reach q JOIN both_ways w ON q.s = w.s AND q.b = w.a)
SELECT s AS record_set, CAST(a AS BIGINT) AS row_a, CAST(b AS BIGINT) AS row_b FROM reach WHERE a < b"""

P1_GROUPS = P1_FOUND.replace("SELECT s AS record_set, CAST(a AS BIGINT) AS row_a, CAST(b AS BIGINT) AS row_b FROM reach WHERE a < b", """SELECT s AS record_set, CAST(a AS BIGINT) AS row_key, CAST(least(a, min(b)) AS BIGINT) AS first_row, CAST(count(*) + 1 AS BIGINT) AS group_size FROM reach WHERE a <> b GROUP BY s, a""")

_NID = f"nullif(lower(regexp_replace(coalesce(id, ''), '^{BLANK}+|{BLANK}+$', '', 'g')), '')"

P4_FOUND = f"""
WITH RECURSIVE old AS MATERIALIZED ({token_rows("SELECT 0 AS s, item_row AS r, title AS t FROM edition_items")}), new AS MATERIALIZED ({token_rows("SELECT 0 AS s, batch_row AS r, title AS t FROM incoming_items")}),
ids AS (SELECT batch_row AS r, {_NID} AS nid FROM incoming_items), known AS MATERIALIZED (SELECT DISTINCT a AS r FROM ({links('new', 'old', 'true')}) UNION SELECT r FROM ids WHERE nid IN (SELECT {_NID} FROM edition_items)),
inner_links AS (SELECT a, b FROM ({links('new', 'new', 'a.r > b.r')}) UNION SELECT x.r, y.r FROM ids x JOIN ids y ON x.nid = y.nid AND x.r > y.r),
ordered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY batch_row) AS k, batch_row AS r, batch_row IN (SELECT r FROM known) AS hit, coalesce((SELECT list(b) FROM inner_links WHERE a = batch_row), []) AS before FROM incoming_items),
pass AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS r, false AS again, CAST([] AS BIGINT[]) AS accepted
  UNION ALL SELECT o.k, o.r, o.hit OR len(list_intersect(o.before, p.accepted)) > 0, CASE WHEN o.hit OR len(list_intersect(o.before, p.accepted)) > 0 THEN p.accepted ELSE list_append(p.accepted, o.r) END FROM pass p JOIN ordered o ON o.k = p.k + 1)
SELECT CAST(r AS BIGINT) AS batch_row FROM pass WHERE again"""
