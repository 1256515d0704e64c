"""Rankings, quotas and the read side."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.operators import scoring, selection
from tidewire.plans import sqltext as S
from tidewire.plans.registry import query, table


def by_score():
    return [F.desc_nulls_last("score"), F.desc_nulls_last("published_at"), F.asc("item_row")]


_BY = "score DESC NULLS LAST, published_at DESC NULLS LAST, item_row"


@query("topk_shortlist", f"SELECT item_row, score FROM edition_items ORDER BY {_BY} LIMIT 36")
def shortlist(spark, sf):
    return table(spark, sf, "edition_items").orderBy(*by_score()).limit(36).select("item_row", "score")


@query("topk_per_event", f"SELECT event_id, item_row, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {_BY}) AS place FROM edition_items) WHERE place <= 3")
def per_event(spark, sf):
    return selection.first_per_key(table(spark, sf, "edition_items"), ["event_id"], by_score(), 3).select("event_id", "item_row", "place")


@query("topk_stream_rank", f"SELECT item_row, CAST(row_number() OVER (ORDER BY {_BY}) AS INTEGER) AS stream_rank FROM edition_items ORDER BY {_BY} LIMIT 300")
def stream_rank(spark, sf):
    top = table(spark, sf, "edition_items").orderBy(*by_score()).limit(300)
    return top.withColumn("stream_rank", F.row_number().over(W.orderBy(*by_score()))).select("item_row", "stream_rank")


@query("topk_quota_single", """
WITH placed AS (SELECT paper_row, research_area, length(coalesce(abstract, '')) AS n, row_number() OVER (PARTITION BY research_area ORDER BY length(coalesce(abstract, '')) DESC, paper_row) AS place FROM papers)
SELECT paper_row, research_area, CAST(n AS INTEGER) AS n FROM placed ORDER BY place > 12, n DESC, paper_row LIMIT 60""")
def quota_single(spark, sf):
    p = table(spark, sf, "papers").withColumn("n", F.length(F.coalesce("abstract", F.lit(""))))
    return selection.capped_per_key(p, "research_area", [F.desc("n"), F.asc("paper_row")], 12, 60).select("paper_row", "research_area", "n")


_POOL = f"""pool AS (SELECT CAST(row_number() OVER (ORDER BY {_BY}) AS INTEGER) AS ord, item_row, event_id, {S.category_key('category')} AS cat, {S.category_key('source')} AS src, score, published_at AS ts FROM (SELECT * FROM edition_items WHERE score IS NOT NULL ORDER BY {_BY} LIMIT 36))"""


@query("topk_quota_dual", f"""
WITH RECURSIVE {_POOL}, pass AS (SELECT 0 AS k, CAST([] AS STRUCT(o INTEGER, r BIGINT, a VARCHAR, b VARCHAR, p INTEGER)[]) AS acc
  UNION ALL SELECT k + 1, CASE WHEN len(acc) < 10 AND NOT list_contains(list_transform(acc, lambda x: x.o), ord) AND (k // 36 > 0 OR len(list_filter(acc, lambda x: x.a = cat)) < 3) AND (k // 36 > 1 OR len(list_filter(acc, lambda x: x.b = src)) < 2)
    THEN list_append(acc, {{'o': ord, 'r': CAST(item_row AS BIGINT), 'a': cat, 'b': src, 'p': CAST(k // 36 AS INTEGER)}}) ELSE acc END FROM pass JOIN pool ON ord = k % 36 + 1 WHERE k < 108)
SELECT x.r AS row, x.a AS key_a, x.b AS key_b, x.p AS relaxed FROM (SELECT unnest(acc) AS x FROM pass WHERE k = 108)""")
def quota_dual(spark, sf):
    """Ten rows, at most three of a category and two of a source; a greedy fold over a bounded pool."""
    e = table(spark, sf, "edition_items").where("score IS NOT NULL")
    rows = e.select(F.col("item_row").alias("row"), scoring.category_key(F.col("category")).alias("key_a"), scoring.category_key(F.col("source")).alias("key_b"), "score", "published_at")
    return selection.greedy_two_caps(rows, [F.desc("score"), F.desc_nulls_last("published_at"), F.asc("row")], 36, 10, 3, 2)


_FRESH = lambda field, column, points: f"CASE WHEN len(list_filter(acc, lambda x: x.{field} IS NOT DISTINCT FROM {column})) > 0 THEN 0 ELSE {points} END"


@query("topk_spotlight", f"""
WITH RECURSIVE {_POOL}, pick AS (SELECT 1 AS k, [{{'o': ord, 'r': CAST(item_row AS BIGINT), 'e': event_id, 'c': cat, 's': src}}] AS acc FROM pool WHERE ord = 1
  UNION ALL SELECT k + 1, arg_max(next, key) FROM (SELECT k, list_append(acc, {{'o': ord, 'r': CAST(item_row AS BIGINT), 'e': event_id, 'c': cat, 's': src}}) AS next,
    {{'e': {_FRESH('e', 'event_id', 40)}, 'c': {_FRESH('c', 'cat', 24)}, 's': {_FRESH('s', 'src', 14)}, 'score': score, 't': coalesce(ts, TIMESTAMP '1900-01-01'), 'o': -ord}} AS key FROM pick, pool WHERE k < 6 AND NOT list_contains(list_transform(acc, lambda x: x.o), ord)) GROUP BY k)
SELECT CAST(place AS INTEGER) AS place, acc[place].r AS row FROM pick, unnest([1, 2, 3, 4, 5, 6]) AS t(place) WHERE k = 6""")
def spotlight(spark, sf):
    """The rows that bring most news one after another."""
    e = table(spark, sf, "edition_items").where("score IS NOT NULL").orderBy(*by_score()).limit(36)
    rows = e.withColumn("ord", F.row_number().over(W.orderBy(*by_score()))).select(
        "ord", F.col("item_row").alias("row"), F.col("event_id").alias("event"), scoring.category_key(F.col("category")).alias("category"), scoring.category_key(F.col("source")).alias("source"), "score", F.col("published_at").alias("ts")
    )
    return selection.spotlight(rows, 36, 6)


_SEARCH = "lower(coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(source, '') || ' ' || array_to_string(coalesce(tags, []), ' '))"


def search_text():
    return F.lower(F.concat(*(x for c in ("title", "summary", "source") for x in (F.coalesce(c, F.lit("")), F.lit(" "))), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))


@query("view_search", f"SELECT item_row FROM edition_items WHERE contains({_SEARCH}, 'satellite') AND {S.category_key('category')} = '航空航天' AND published_at >= TIMESTAMP '2026-07-28 00:00:00' ORDER BY {_BY} LIMIT 24")
def search(spark, sf):
    e = table(spark, sf, "edition_items")
    kept = e.where(F.contains(search_text(), F.lit("satellite")) & (scoring.category_key(F.col("category")) == "航空航天") & (F.col("published_at") >= F.lit("2026-07-28 00:00:00").cast("timestamp_ntz")))
    return kept.orderBy(*by_score()).limit(24).select("item_row")


@query("view_watchwords", f"SELECT item_row, CAST(contains({_SEARCH}, 'drone') AS INTEGER) + CAST(contains({_SEARCH}, 'radar') AS INTEGER) + CAST(contains({_SEARCH}, '卫星') AS INTEGER) AS n_words FROM edition_items WHERE contains({_SEARCH}, 'drone') OR contains({_SEARCH}, 'radar') OR contains({_SEARCH}, '卫星')")
def watchwords(spark, sf):
    words = F.array(*map(F.lit, ("drone", "radar", "卫星")))
    e = table(spark, sf, "edition_items").select("item_row", search_text().alias("t"))
    return e.withColumn("n_words", F.size(F.filter(words, lambda w: F.contains("t", w)))).where("n_words > 0").select("item_row", "n_words")


@query("view_facets", f"SELECT {S.category_key('category')} AS facet, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT lower(source)) AS BIGINT) AS n_sources FROM edition_items GROUP BY 1")
def facets(spark, sf):
    return table(spark, sf, "edition_items").groupBy(scoring.category_key(F.col("category")).alias("facet")).agg(F.count("*").alias("n"), F.count_distinct(F.lower("source")).alias("n_sources"))


@query("view_tag_facets", "SELECT lower(tag) AS tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(tags) AS tag FROM edition_items) GROUP BY 1")
def tag_facets(spark, sf):
    return table(spark, sf, "edition_items").select(F.explode("tags").alias("tag")).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


@query("view_item_keys", "SELECT item_row, coalesce(CAST(edition_date AS VARCHAR), 'unknown') || '::' || coalesce(id, '') AS item_key FROM edition_items")
def item_keys(spark, sf):
    return table(spark, sf, "edition_items").select("item_row", F.concat(F.coalesce(F.col("edition_date").cast("string"), F.lit("unknown")), F.lit("::"), F.coalesce("id", F.lit(""))).alias("item_key"))


@query("view_edition_nav", "SELECT CAST(edition_date AS VARCHAR) AS edition_date, CAST(lag(edition_date) OVER (ORDER BY edition_date) AS VARCHAR) AS earlier, CAST(lead(edition_date) OVER (ORDER BY edition_date) AS VARCHAR) AS later FROM editions")
def edition_nav(spark, sf):
    w = W.orderBy("edition_date")  # one row a day: small whatever the items' number
    e = table(spark, sf, "editions").select("edition_date", F.lag("edition_date").over(w).alias("earlier"), F.lead("edition_date").over(w).alias("later"))
    return e.select(*(F.col(c).cast("string").alias(c) for c in e.columns))
