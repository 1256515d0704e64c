"""Reports, their rules, enrichment and the reader's lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.config import CATEGORIES, LIMITS
from tidewire.functions import text
from tidewire.operators import enrich, registry, reports, scoring, selection, views
from tidewire.plans import sqltext as S
from tidewire.plans.link_plans import report_items
from tidewire.plans.rank_plans import by_score
from tidewire.plans.registry import query, table
from tidewire.plans.score_plans import _KEPT, _PREPARED, _TOTAL, AREAS, NOW, candidates, now, paper_candidates, papers_sql
from tidewire.shared import scratch_path
from tidewire.sources import sinks

_BY = "score DESC NULLS LAST, published_at DESC NULLS LAST, item_row"
_TEN = f"ten AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edition_date ORDER BY {_BY}) AS place FROM edition_items) WHERE place <= 10)"


def ten(spark, sf):
    return selection.first_per_key(table(spark, sf, "edition_items"), ["edition_date"], by_score(), 10)


@query("report_items", f"""
WITH {_PREPARED}, {_KEPT} SELECT article_row, best AS category, {_TOTAL} AS score, CASE WHEN description <> '' THEN {S.clip('description', 180)} ELSE '据' || source || '公开信息，' || title || '。现有元数据有限，详情应以原始报道为准。' END AS summary, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS published_at FROM kept""")
def items(spark, sf):
    """Scored articles in the shape in which they are published."""
    p = reports.published(scoring.scored(candidates(spark, sf).withColumn("row", F.col("article_row")), now()))
    return p.select(F.col("row").alias("article_row"), "category", "score", "summary", "published_at")


@query("report_key_facts")
def key_facts(spark, sf):
    """Clauses that say more than the summary; the greedy choice by similarity is held against a loop in the tests."""
    a = scoring.prepared(table(spark, sf, "articles"), now())
    facts = reports.key_facts(F.col("description"), reports.summary_of(F.col("title"), F.col("source"), F.col("description")))
    return a.select("article_row", F.array_join(facts, "|").alias("key_facts"))


@query("report_papers", f"SELECT paper_row, area AS research_area, CAST(round_even(paper_score, 0) AS INTEGER) AS score, array_to_string(all_keywords, '|') AS keywords FROM ({papers_sql(f"TIMESTAMP '{NOW}'")})")
def papers(spark, sf):
    p = reports.published_papers(scoring.scored_papers(paper_candidates(spark, sf), now(), AREAS))
    return p.select("paper_row", "research_area", "score", F.array_join("collection_keywords", "|").alias("keywords"))


@query("report_brief", f"""
WITH {_TEN}, c AS (SELECT edition_date, coalesce(category, '') AS category, count(*) AS n FROM ten GROUP BY 1, 2), top AS (SELECT edition_date, string_agg(category, '、' ORDER BY n DESC, category) AS lead_cats FROM (SELECT *, row_number() OVER (PARTITION BY edition_date ORDER BY n DESC, category) AS p FROM c) WHERE p <= 3 GROUP BY 1)
SELECT CAST(edition_date AS VARCHAR) AS edition_date, CAST(count(*) AS BIGINT) AS n_items, CAST(count(DISTINCT source) AS BIGINT) AS n_sources, arg_min(title, place) AS headline, any_value(lead_cats) AS "leading" FROM ten JOIN top USING (edition_date) GROUP BY 1""")
def brief(spark, sf):
    b = reports.brief(ten(spark, sf).withColumn("category", F.coalesce("category", F.lit(""))))
    return b.withColumn("edition_date", F.col("edition_date").cast("string"))


_NAMES = ", ".join(f"'{c}'" for c in CATEGORIES)


@query("dq_report", f"""
WITH {_TEN}, r AS (SELECT edition_date, CASE WHEN count(*) <> 10 THEN 1 ELSE 0 END AS "wrong number of items", count(id) - count(DISTINCT id) AS "repeated id", count(*) FILTER (coalesce({S.squeeze('id')} = '', true)) AS "missing id", count(*) FILTER (coalesce({S.squeeze('title')} = '', true)) AS "missing title", count(*) FILTER (coalesce({S.squeeze('source')} = '', true)) AS "missing source",
  count(*) FILTER (NOT coalesce(category IN ({_NAMES}), false)) AS "unknown category", count(*) FILTER (NOT coalesce(regexp_matches(url, '^https?://'), false)) AS "unusable address", count(*) FILTER (NOT coalesce(regexp_matches(event_id, '^evt?-[0-9a-f]{{12}}$'), false)) AS "unusable event", 0 AS "summary repeated as a fact" FROM ten GROUP BY 1)
SELECT CAST(edition_date AS VARCHAR) AS edition_date, rule, CAST(n AS BIGINT) AS n FROM (UNPIVOT r ON COLUMNS(* EXCLUDE (edition_date)) INTO NAME rule VALUE n) WHERE n > 0""")
def report_violations(spark, sf):
    """Rules that the editions' reports break."""
    v = reports.report_violations(ten(spark, sf).withColumn("key_facts", F.array().cast("array<string>")))
    return v.withColumn("edition_date", F.col("edition_date").cast("string"))


@query("dq_stream", f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY {_BY}) AS rank FROM edition_items ORDER BY {_BY} LIMIT 300), r AS (SELECT count(*) FILTER (coalesce(trim(id) = '', true)) AS "missing id", count(id) - count(DISTINCT id) AS "repeated id" FROM s)
SELECT rule, CAST(n AS BIGINT) AS n FROM (UNPIVOT r ON COLUMNS(*) INTO NAME rule VALUE n) WHERE n > 0""")
def stream_violations(spark, sf):
    """Rules that the stream of the best 300 items breaks."""
    from pyspark.sql import Window as W

    top = table(spark, sf, "edition_items").orderBy(*by_score()).limit(LIMITS.stream_limit)
    return reports.stream_violations(top.withColumn("rank", F.row_number().over(W.orderBy(*by_score()))).withColumn("content_type", F.lit("news")), F.least(F.lit(LIMITS.stream_limit), F.count("*")))


_STATUS = f"""{_TEN}, st AS (SELECT edition_date, editorial_status, schema_version, count(id) AS n FROM editions LEFT JOIN ten USING (edition_date) GROUP BY ALL)"""


@query("run_gate", f"""
WITH {_STATUS} SELECT CAST(edition_date AS VARCHAR) AS edition_date, CASE WHEN n = 10 AND coalesce(schema_version, 0) < 9 THEN 'schema_upgrade_required' WHEN n = 10 THEN 'healthy_edition_exists' ELSE 'edition_missing_or_unhealthy' END AS reason, NOT (n = 10 AND coalesce(schema_version, 0) >= 9) AS run FROM st""")
def gate(spark, sf):
    """Whether each edition would have to be made again."""
    n = ten(spark, sf).groupBy("edition_date").agg(F.count("id").alias("n_items"))
    e = table(spark, sf, "editions").join(n, "edition_date", "left")
    status = F.struct(F.lit("ok").alias("state"), "edition_date", "n_items", "schema_version")
    out = e.select("edition_date", reports.needs_run(status, F.col("edition_date"), F.lit(False), required=9).alias("x"))
    return out.select(F.col("edition_date").cast("string").alias("edition_date"), "x.reason", "x.run")


@query("run_health", f"""
WITH {_STATUS}, g AS (SELECT max(generated_at) AS g FROM editions) SELECT CAST(e.edition_date AS VARCHAR) AS edition_date, CASE WHEN epoch_us(g) - epoch_us(generated_at) > 36 * 3.6e9 THEN 'stale' WHEN n <> 10 THEN 'wrong number' ELSE 'ok' END AS health FROM editions e JOIN st USING (edition_date), g""")
def health(spark, sf):
    """What a reader is told of each edition at the moment when the newest came out."""
    n = ten(spark, sf).groupBy("edition_date").agg(F.count("id").alias("n_items"))
    e = table(spark, sf, "editions")
    latest = e.agg(F.max("generated_at").alias("g"))
    age = (F.unix_micros(F.col("g").cast("timestamp")) - F.unix_micros(F.col("generated_at").cast("timestamp"))) / F.lit(3.6e9)
    no = F.lit(False)
    return e.join(n, "edition_date", "left").join(F.broadcast(latest)).select(F.col("edition_date").cast("string").alias("edition_date"), reports.health(F.coalesce("n_items", F.lit(0)), age, no, no, no, no).alias("health"))


@query("run_status", "SELECT CAST(epoch(max(ts)) AS BIGINT) AS at_s, arg_max(event_type, ts) AS state, CAST(epoch(max(ts) FILTER (event_type = 'ok')) AS BIGINT) AS ok_s, CAST(arg_max(user_id, ts) FILTER (value > 50) AS BIGINT) AS last_user FROM events")
def status(spark, sf):
    """Events as a log of runs: the newest, and the last known value of what it does not report."""
    log = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("state"), F.when(F.col("value") > 50, F.col("user_id")).alias("last_user"))
    return sinks.run_status(log).select(F.unix_seconds("at").alias("at_s"), "state", F.unix_seconds("last_success").alias("ok_s"), "last_user")


@query("snk_edition_index", "SELECT CAST(edition_date AS VARCHAR) AS edition_date, CAST(n_items AS BIGINT) AS n_items, CAST(n_sources AS BIGINT) AS n_sources, CAST(place AS INTEGER) AS place FROM (SELECT edition_date, row_number() OVER (ORDER BY edition_date DESC) AS place FROM editions) JOIN (SELECT edition_date, count(*) AS n_items, count(DISTINCT source) AS n_sources FROM edition_items GROUP BY 1) USING (edition_date) WHERE place <= 5")
def edition_index(spark, sf):
    i = sinks.edition_index(table(spark, sf, "edition_items"), table(spark, sf, "editions"), 5)
    return i.select(F.col("edition_date").cast("string").alias("edition_date"), "n_items", "n_sources", "place")


@query("snk_search_shards", "SELECT item_id, CAST(n AS BIGINT) AS n FROM (SELECT coalesce(id, '') AS item_id, count(*) AS n FROM edition_items WHERE edition_date IN (SELECT edition_date FROM editions ORDER BY 1 DESC LIMIT 3) GROUP BY 1)")
def search_shards(spark, sf):
    """Shards of all editions, written again for the newest three only, and read back."""
    path = scratch_path(spark, "shards")
    e = table(spark, sf, "edition_items")
    sinks.write_shards(e, path)
    sinks.write_shards(e, path, sinks.retained_editions(table(spark, sf, "editions"), 3))
    return spark.read.parquet(path).groupBy(F.coalesce("id", F.lit("")).alias("item_id")).agg(F.count("*").alias("n"))


@query("enr_scores")
def model_scores(spark, sf):
    """The stand-in model's scores of all items and what they make of the rule's; batches are checked and asked again in halves."""
    e = table(spark, sf, "edition_items")
    got = enrich.model_scores(e.select(F.col("item_row").alias("id"), F.col("title").alias("text")))
    rule = F.coalesce("score", F.lit(0))
    return e.join(got.withColumn("item_row", F.col("id").cast("long")).drop("id"), "item_row").select("item_row", "model_score", scoring.fused(F.col("model_score"), rule).alias("fused"))


@query("enr_untranslated", "SELECT item_row FROM edition_items WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM incoming_items WHERE id IS NOT NULL)")
def untranslated(spark, sf):
    return enrich.untranslated(table(spark, sf, "edition_items").where("id IS NOT NULL"), table(spark, sf, "incoming_items").where("id IS NOT NULL")).select("item_row")


@query("enr_reusable", "SELECT DISTINCT e.item_row FROM edition_items e JOIN incoming_items i ON e.id = i.id AND e.title = i.title WHERE trim(e.title) <> '' AND trim(e.summary) <> '' AND e.confidence = (SELECT min(confidence) FROM edition_items)")
def reusable(spark, sf):
    """Items whose wording still holds for the incoming ones; the confidence stands for the provider."""
    e = table(spark, sf, "edition_items").withColumns({"original_title": F.col("title"), "provider": F.col("confidence"), "model": F.lit("m")})
    first = table(spark, sf, "edition_items").agg(F.min("confidence").alias("c")).first()["c"]
    return enrich.reusable(e, table(spark, sf, "incoming_items").where("id IS NOT NULL").select("id", "title"), first, "m").select("item_row").distinct()


@query("enr_featured", f"""
WITH {_TEN}, d AS (SELECT id, min_by(score, item_row) AS score, min_by(title, item_row) AS title FROM ten WHERE id IS NOT NULL GROUP BY 1)
SELECT i.batch_row, CASE WHEN d.id IS NOT NULL THEN d.score END AS score, coalesce(d.title, i.title) AS title, d.id IS NOT NULL AS is_top_story FROM incoming_items i LEFT JOIN d ON d.id = i.id""")
def featured(spark, sf):
    """Incoming items with what the reports say of them."""
    d = ten(spark, sf).where("id IS NOT NULL").groupBy("id").agg(F.min_by("score", "item_row").alias("score"), F.min_by("title", "item_row").alias("title"), F.lit("m").alias("provider"))
    s = table(spark, sf, "incoming_items").select("batch_row", "id", "title", F.lit(None).cast("int").alias("score"), F.lit("").alias("provider"))
    # A worded title that is null keeps the stream's own.
    out = enrich.merged_featured(s.withColumn("own", F.col("title")), d, ("score",), ("title",))
    return out.select("batch_row", "score", F.coalesce("title", "own").alias("title"), "is_top_story")


@query("view_stream", f"SELECT item_row FROM edition_items WHERE source = (SELECT source FROM edition_items WHERE source <> '' GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 1) AND published_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR ORDER BY {_BY} LIMIT 48")
def stream_view(spark, sf):
    """Two pages of the largest source's items of the last day."""
    e = table(spark, sf, "edition_items").withColumn("published_at", F.col("published_at").cast("timestamp"))
    largest = e.where("source != ''").groupBy("source").count().orderBy(F.desc("count"), "source").first()["source"]
    hay = views.searched(e, ("title", "summary", "source", "category"), ("tags",))
    return views.page(views.view(e, hay, source=largest, hours=24, generated=now()), by_score(), 2).select("item_row")


_HAY = "lower(concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''), array_to_string(coalesce(collection_keywords, []), ' ')))"


@query("view_my_keywords", f"SELECT paper_row FROM papers WHERE contains({_HAY}, 'orbit') OR contains({_HAY}, 'testing')")
def my_keywords(spark, sf):
    p = table(spark, sf, "papers")
    return views.view(p, views.searched(p, ("title", "abstract"), ("collection_keywords",)), mine=["orbit", "Testing"]).select("paper_row")


@query("view_facet_order", f"""
WITH f AS (SELECT {S.strip("coalesce(category, '')")} AS facet, count(*) AS n FROM edition_items GROUP BY 1)
SELECT facet, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY coalesce(nullif(list_position([{_NAMES}], facet), 0), 7), facet) AS INTEGER) AS place FROM f WHERE facet <> ''""")
def facet_order(spark, sf):
    from pyspark.sql import Window as W

    f = views.facets(table(spark, sf, "edition_items"), text.strip(F.coalesce("category", F.lit(""))))
    return f.select("facet", "n", F.row_number().over(W.orderBy("ord")).alias("place"))


_SAFE = "replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("view_marked", f"SELECT item_row, regexp_replace({_SAFE}, '(?i)(satellite|drone|卫星)', '<mark>\\1</mark>', 'g') AS title FROM edition_items WHERE title IS NOT NULL")
def marked(spark, sf):
    words = views.terms("drone satellite Drone", ("卫星",))
    return table(spark, sf, "edition_items").where("title IS NOT NULL").select("item_row", views.marked(F.col("title"), words).alias("title"))


@query("view_word_lists", """
WITH w AS (SELECT user_id AS usr, left(event_type || (event_id % 40), 40) AS word, ts FROM events), o AS (SELECT usr, lower(word) AS k, arg_min(word, ts) AS word, min(ts) AS t0 FROM w GROUP BY 1, 2)
SELECT usr AS user_id, word, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY t0, k) AS place FROM o) WHERE place <= 20""")
def word_lists(spark, sf):
    w = table(spark, sf, "events").select(F.col("user_id").alias("user"), F.concat("event_type", (F.col("event_id") % 40).cast("string")).alias("word"), F.col("ts").alias("at"))
    return views.word_list(w).select(F.col("user").alias("user_id"), "word", "place")


@query("view_bookmarks", "SELECT user_id, CAST(event_id % 50 AS VARCHAR) AS item, CAST(count(*) AS BIGINT) AS changes FROM events GROUP BY ALL HAVING count(*) % 2 = 1")
def bookmarks(spark, sf):
    """What is marked after all changes: an odd number of them sets a mark."""
    changes = table(spark, sf, "events").select(F.col("user_id").alias("user"), (F.col("event_id") % 50).cast("string").alias("key"), F.col("ts").alias("at"), F.col("event_type").alias("snapshot"))
    kept = views.toggled(changes.limit(0), changes)
    n = changes.groupBy("user", "key").agg(F.count("*").alias("changes"))
    return kept.join(n, ["user", "key"]).select(F.col("user").alias("user_id"), F.col("key").alias("item"), "changes")


@query("view_edition_breaks", f"""
SELECT item_row, edition_date IS DISTINCT FROM lag(edition_date) OVER (ORDER BY edition_date DESC, {_BY}) AS starts FROM (SELECT * FROM edition_items ORDER BY edition_date DESC, {_BY} LIMIT 500)""")
def edition_breaks(spark, sf):
    """Where a new edition begins in a reader's list of 500 rows."""
    from pyspark.sql import Window as W

    order = [F.desc("edition_date"), *by_score()]
    top = table(spark, sf, "edition_items").orderBy(*order).limit(500)
    return top.select("item_row", (~F.col("edition_date").eqNullSafe(F.lag("edition_date").over(W.orderBy(*order)))).alias("starts"))


@query("view_hydrated", "SELECT i.item_row, length(coalesce(i.summary, '')) AS n FROM edition_items i JOIN (SELECT DISTINCT edition_date, id FROM edition_items WHERE score >= 60 AND id IS NOT NULL) c USING (edition_date, id)")
def hydrated(spark, sf):
    """Compact rows with all of their item again, by edition and id."""
    e = table(spark, sf, "edition_items")
    compact = e.where("score >= 60 AND id IS NOT NULL").select("edition_date", "id").distinct()
    return e.join(compact, ["edition_date", "id"]).select("item_row", F.length(F.coalesce("summary", F.lit(""))).alias("n"))


@query("state_last_good", "SELECT paper_row, true AS stale FROM papers")
def last_good(spark, sf):
    """No paper was collected in this run, so the previous ones stay, marked as stale."""
    p = table(spark, sf, "papers").select("paper_row")
    return registry.last_good(p.where("paper_row < 0"), p)
