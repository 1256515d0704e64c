"""State from batch to batch, and windows that fall back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.config import DENIAL_MARKERS, OUTLOOK, OUTLOOK_UNLINKED
from tidewire.operators import events as EV
from tidewire.operators import registry as R
from tidewire.plans import sqltext as S
from tidewire.plans.link_plans import _HISTORY, _NP
from tidewire.plans.registry import query, table

NOW = "2024-01-20 12:00:00"


def _records(e):
    # An event without an identifier has no record.
    item = F.when(F.trim("id") != "", F.lower(F.trim("id")))
    return R.batch_records(e.where("event_id IS NOT NULL").select(
        F.col("event_id").alias("event"), F.col("edition_date").alias("day"), item.alias("item"), F.lower(F.coalesce("source", F.lit(""))).alias("grp"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("summary", F.lit("")).alias("summary"), "score", F.col("published_at").alias("ts"), F.col("item_row").alias("row"),
    ))


_OLD = "TIMESTAMP '1970-01-01'"
_REG = f"""it AS (SELECT event_id, edition_date AS day, coalesce(score, 0) AS sc, coalesce(published_at, {_OLD}) AS pub, item_row, CASE WHEN trim(id) <> '' THEN lower(trim(id)) END AS nid, lower(coalesce(source, '')) AS grp, coalesce(title, '') AS title, coalesce(category, '') AS category FROM edition_items WHERE event_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY day, sc DESC, pub DESC, nid NULLS FIRST, item_row) AS ord FROM it),
spans AS (SELECT event_id, min(day) AS first_seen, max(day) AS last_seen, arg_max(title, ord) AS title, arg_max(category, ord) AS category, arg_max(sc, ord) AS score FROM o GROUP BY 1),
ids AS (SELECT event_id, list(nid ORDER BY p) AS items FROM (SELECT event_id, nid, min(ord) AS p, row_number() OVER (PARTITION BY event_id ORDER BY min(ord) DESC) AS back FROM o WHERE nid IS NOT NULL GROUP BY 1, 2) WHERE back <= 120 GROUP BY 1),
grps AS (SELECT event_id, list(grp ORDER BY p) AS groups FROM (SELECT event_id, grp, min(ord) AS p, row_number() OVER (PARTITION BY event_id ORDER BY min(ord) DESC) AS back FROM o WHERE grp <> '' GROUP BY 1, 2) WHERE back <= 16 GROUP BY 1),
lines AS (SELECT event_id, count(*) AS n_updates FROM (SELECT DISTINCT event_id, day, nid FROM o WHERE nid IS NOT NULL) GROUP BY 1),
r AS (SELECT s.*, coalesce(items, []) AS items, coalesce(groups, []) AS groups, least(24, coalesce(n_updates, 0)) AS n_updates FROM spans s LEFT JOIN ids USING (event_id) LEFT JOIN grps USING (event_id) LEFT JOIN lines USING (event_id))"""


@query("state_registry", f"""
WITH {_REG} SELECT event_id, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen, title, category, CAST(score AS INTEGER) AS score, array_to_string(items, ' ') AS items, array_to_string(groups, '|') AS groups, CAST(n_updates AS INTEGER) AS n_updates,
  CASE WHEN first_seen < last_seen OR n_updates > 1 THEN 'tracking' ELSE 'new' END AS status FROM r""")
def registry(spark, sf):
    """All editions but the last as the state, the last as a batch that is merged into it."""
    e = table(spark, sf, "edition_items")
    latest = table(spark, sf, "editions").agg(F.max("edition_date").alias("d"))
    rows = e.join(F.broadcast(latest))
    state, batch = _records(rows.where("edition_date < d")), _records(rows.where("edition_date = d"))
    out = R.upsert(state, batch, F.lit("2026-08-30").cast("date"))
    return out.select(F.col("event").alias("event_id"), F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"), "title", "category", "score", F.array_join("items", " ").alias("items"), F.array_join("groups", "|").alias("groups"), F.size("timeline").alias("n_updates"), "status")


@query("stat_weekly_digest", f"""
WITH {_REG}, latest AS (SELECT max(edition_date) AS d FROM editions), w AS (SELECT date_trunc('week', d)::DATE AS start, CAST(isoyear(d) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0') AS week FROM latest),
p AS (WITH {_NP} SELECT event_id, least(8, count(DISTINCT row_b)) AS n_papers FROM forward JOIN edition_items ON item_row = row_a WHERE event_id IS NOT NULL GROUP BY 1),
c AS (SELECT r.*, week, start, coalesce(n_papers, 0) AS n_papers, score + least(12, 2 * n_updates) + least(10, 2 * greatest(1, len(groups))) + least(8, 2 * coalesce(n_papers, 0)) AS points FROM r CROSS JOIN w LEFT JOIN p USING (event_id) WHERE last_seen BETWEEN start AND start + 6)
SELECT week, event_id, CAST(points AS INTEGER) AS points, CAST(place AS INTEGER) AS place, CASE WHEN first_seen >= start THEN '本周新出现' WHEN n_updates >= 3 THEN '持续演化' ELSE '继续发展' END AS trend
FROM (SELECT *, row_number() OVER (ORDER BY points DESC, last_seen DESC, event_id) AS place FROM c) WHERE place <= 8""")
def weekly_digest(spark, sf):
    """The latest week's eight events, from the registry's records and their papers."""
    from tidewire.plans.link_plans import news_to_papers

    e = table(spark, sf, "edition_items")
    latest = table(spark, sf, "editions").agg(F.max("edition_date").alias("d")).first()["d"]
    links = news_to_papers(spark, sf).select(F.col("row_a").alias("item_row"), "row_b").join(e.where("event_id IS NOT NULL").select("item_row", F.col("event_id").alias("event")), "item_row")
    papers = links.groupBy("event").agg(F.least(F.lit(8), F.count_distinct("row_b")).alias("n_papers"))
    start = F.to_date(F.date_trunc("week", F.lit(latest)))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.lit(latest)).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), F.lit(latest)).cast("string"), 2, "0"))
    return R.weekly(_records(e), papers, start).select(week.alias("week"), F.col("event").alias("event_id"), "points", "place", "trend")


@query("state_paper_links", f"""
WITH {_NP}, l AS (SELECT event_id, row_b, max(points) AS points FROM forward JOIN edition_items ON item_row = row_a WHERE event_id IS NOT NULL GROUP BY ALL)
SELECT event_id, row_b AS paper_row, points FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY points DESC, row_b) AS place FROM l) WHERE place <= 8""")
def paper_links(spark, sf):
    """Of every event the eight best papers of its items."""
    from tidewire.operators.selection import first_per_key
    from tidewire.plans.link_plans import news_to_papers

    e = table(spark, sf, "edition_items").where("event_id IS NOT NULL").select(F.col("item_row").alias("row_a"), "event_id")
    l = news_to_papers(spark, sf).join(e, "row_a").groupBy("event_id", "row_b").agg(F.max("points").alias("points"))  # noqa: E741
    return first_per_key(l, ["event_id"], [F.desc("points"), F.asc("row_b")], 8).select("event_id", F.col("row_b").alias("paper_row"), "points")


_LINKED = f"""WITH {_HISTORY}, links AS (SELECT r.row_a, r.points, r.direct, r.day_b, h.id AS prev_id, i.event_id AS prev_event, i.item_row AS prev_row FROM ranked r JOIN h ON h.item_row = r.row_b JOIN edition_items i ON i.item_row = r.row_b WHERE place <= 3)"""


def _report_links(spark, sf):
    """The latest report's links with the earlier rows' ids and events."""
    from tidewire.plans.link_plans import history_of_report

    prev = table(spark, sf, "edition_items").select(F.col("item_row").alias("row_b"), F.col("id").alias("prev_id"), F.coalesce("event_id", F.lit("")).alias("prev_event"), F.col("title").alias("prev_title"), F.col("summary").alias("prev_summary"))
    links = history_of_report(spark, sf).join(prev, "row_b")
    return links.select(F.col("row_a").alias("row"), "row_b", "prev_id", "prev_event", "prev_title", "prev_summary", F.col("day_b").alias("prev_day"), "points", F.col("direct").alias("same_story"))


def _report(spark, sf):
    from tidewire.plans.link_plans import report_items

    latest = table(spark, sf, "editions").agg(F.max("edition_date").alias("d"))
    return report_items(spark, sf).join(F.broadcast(latest), F.col("day") == F.col("d")).drop("d")


@query("state_event_ids", f"""
{_LINKED}, cand AS (SELECT row_a, points + CASE WHEN direct THEN 20 ELSE 0 END AS points, prev_event AS event FROM links WHERE (direct OR points >= 45) AND coalesce(prev_event, '') <> ''),
best AS (SELECT row_a, arg_max(event, {{'p': points, 'e': event}}) AS event FROM cand GROUP BY 1), before AS (SELECT row_a, arg_min(prev_id, {{'d': day_b, 'i': prev_id}}) AS prev FROM links WHERE direct GROUP BY 1)
SELECT r.item_row, coalesce(event, 'evt-' || left(sha1(coalesce(nullif(lower({S.squeeze("coalesce(prev, r.id, '')")}), ''), 'unknown-event')), 12)) AS event_id FROM report r LEFT JOIN best b ON b.row_a = r.item_row LEFT JOIN before p ON p.row_a = r.item_row""")
def event_ids(spark, sf):
    """The latest report's items as if they were new: events are taken over from what they are linked to."""
    none = spark.createDataFrame([], "id string, event string")
    out = EV.event_ids(_report(spark, sf).select("row", "id"), _report_links(spark, sf), none)
    return out.select(F.col("row").alias("item_row"), "event_id")


_SAID = "coalesce(title, '') || ' ' || coalesce(summary, '')"
_DENIED = lambda x: "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in DENIAL_MARKERS) + ")"
_FACTS = "list_slice(list_filter(regexp_split_to_array(coalesce(summary, ''), '[.。!?！？]+'), lambda f: trim(f) <> ''), 1, 3)"


@query("state_evidence_matrix", f"""
{_LINKED}, own AS (SELECT i.*, {S.history_tokens(_SAID)} AS words, {_DENIED(_SAID)} AS denied FROM edition_items i JOIN report USING (item_row)),
prev AS (SELECT l.row_a, {S.history_tokens(_SAID)} AS words, {_DENIED(_SAID)} AS denied FROM links l JOIN edition_items i ON i.item_row = l.prev_row),
d AS (SELECT item_row, least(2, count(*)) AS n FROM own o JOIN prev p ON p.row_a = o.item_row WHERE o.denied <> p.denied AND len(list_intersect(o.words, p.words)) >= 2 GROUP BY 1)
SELECT o.item_row, CAST(len({_FACTS}) AS INTEGER) AS n_claims, CAST(coalesce(d.n, 0) AS INTEGER) AS n_disputes, CASE WHEN coalesce(d.n, 0) > 0 THEN 'contested' WHEN greatest(1, coalesce(corroboration, 1)) >= 2 THEN 'multi-source' ELSE 'single-source' END AS overall FROM own o LEFT JOIN d USING (item_row)""")
def evidence_matrix(spark, sf):
    """Claims (sentences of the summary), earlier rows that differ in denial, and how well the latest report's items are backed."""
    links = _report_links(spark, sf).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("prev_day").alias("day"), F.col("prev_title").alias("title"), F.col("prev_summary").alias("summary")))).alias("related"))
    facts = F.filter(F.split(F.coalesce("summary", F.lit("")), "[.。!?！？]+"), lambda f: F.trim(f) != "")
    df = _report(spark, sf).join(links, "row", "left").withColumns({"facts": facts, "groups": F.array(F.lower(F.coalesce("source", F.lit("")))), "related": F.coalesce("related", F.array().cast("array<struct<day:date,title:string,summary:string>>"))})
    return EV.evidence_matrix(df).select("item_row", F.size("claims").alias("n_claims"), F.size("disputes").alias("n_disputes"), "overall")


_STATEMENTS = "[" + ", ".join(f"{{'linked': {k}, 'h': '{h}', 's': '{s}'}}" for k, those in (("true", OUTLOOK), ("false", OUTLOOK_UNLINKED)) for h, s, _ in those) + "]"


@query("state_forecasts", f"""
{_LINKED}, f AS (SELECT r.item_row, event_id, r.edition_date, unnest({_STATEMENTS}) AS x, r.item_row IN (SELECT row_a FROM links) AS linked FROM report r JOIN edition_items USING (item_row))
SELECT item_row, 'pred-' || left(sha1(concat_ws('|', event_id, x.h, {S.norm_title('x.s')})), 12) AS forecast, x.h AS horizon, CAST(edition_date + CASE WHEN x.h = '中期' THEN 90 ELSE 30 END AS VARCHAR) AS due FROM f WHERE x.linked = linked""")
def forecasts(spark, sf):
    """What is expected of the latest report's events, and when it is due."""
    linked = _report_links(spark, sf).select("row").distinct().withColumn("linked", F.lit(True))
    df = _report(spark, sf).join(linked, "row", "left").select(F.col("event_id").alias("event"), F.col("item_row").cast("string").alias("item"), "category", "day", F.coalesce("linked", F.lit(False)).alias("linked"))
    return EV.forecasts(df).select(F.get("evidence", F.lit(0)).cast("long").alias("item_row"), "forecast", "horizon", F.col("due").cast("string").alias("due"))


@query("state_dossiers", f"""
{_LINKED}, t AS (SELECT row_a, list(prev_id ORDER BY day_b, prev_id) AS ids, min(day_b) AS first FROM links GROUP BY 1)
SELECT r.item_row, CASE WHEN ids IS NULL THEN 'new' ELSE 'tracking' END AS status, CAST(coalesce(first, r.edition_date) AS VARCHAR) AS first_seen, CAST(1 + coalesce(len(ids), 0) AS INTEGER) AS n_updates, array_to_string(list_append(coalesce(ids, []), coalesce(r.id, '')), ' ') AS timeline FROM report r LEFT JOIN t ON t.row_a = r.item_row""")
def dossiers(spark, sf):
    items = _report(spark, sf).select("row", F.coalesce("id", F.lit("")).alias("id"), F.col("event_id").alias("event"), "day", F.coalesce("corroboration", F.lit(1)).alias("independent"))
    d = EV.dossiers(items, _report_links(spark, sf))
    return d.select(F.col("row").alias("item_row"), "status", F.col("first_seen").cast("string").alias("first_seen"), "n_updates", F.array_join(F.transform("timeline", lambda x: x["id"]), " ").alias("timeline"))


@query("state_timeline", """
SELECT event_id, string_agg(CAST(item_row AS VARCHAR), ' ' ORDER BY edition_date, item_row) AS items FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY edition_date DESC, item_row DESC) AS back FROM edition_items) WHERE back <= 8 GROUP BY 1""")
def timeline(spark, sf):
    from tidewire.operators.selection import first_per_key

    e = first_per_key(table(spark, sf, "edition_items"), ["event_id"], [F.desc("edition_date"), F.desc("item_row")], 8)
    items = F.array_sort(F.collect_list(F.struct("edition_date", "item_row")))
    return e.groupBy("event_id").agg(F.array_join(F.transform(items, lambda x: x["item_row"].cast("string")), " ").alias("items"))


@query("state_ledger", """
WITH e AS (SELECT 'f' || (event_id % 997) AS forecast, user_id AS event, CAST(ts AS DATE) AS created, CAST(ts AS DATE) + 5 AS due, CASE WHEN value > 95 THEN 'confirmed' ELSE 'open' END AS status, event_id AS seq FROM events),
one AS (SELECT forecast, arg_max(event, seq) AS event, arg_max(created, seq) AS created, arg_max(due, seq) AS due, arg_max(status, seq) AS status, array_to_string(list_sort(list(seq))[-12:], ' ') AS evidence FROM e GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY created DESC, forecast) AS place FROM one)
SELECT forecast, CAST(event AS BIGINT) AS event, CAST(created AS VARCHAR) AS created, CASE WHEN status <> 'open' THEN status WHEN due <= DATE '2024-02-02' THEN 'due' ELSE 'open' END AS status, evidence FROM ranked WHERE place <= 12""")
def ledger(spark, sf):
    e = table(spark, sf, "events")
    day = F.to_date("ts")
    rows = e.select(F.concat(F.lit("f"), (F.col("event_id") % 997)).alias("forecast"), F.col("user_id").alias("event"), day.alias("created"), F.date_add(day, 5).alias("due"), F.lit("").alias("statement"), F.when(F.col("value") > 95, "confirmed").otherwise("open").alias("status"), F.array(F.col("event_id").cast("string")).alias("evidence"), F.col("event_id").alias("seq"))
    return R.ledger(rows, F.lit("2024-02-02").cast("date")).select("forecast", "event", F.col("created").cast("string").alias("created"), "status", F.array_join("evidence", " ").alias("evidence"))


_AGES = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3.6e9"


@query("state_backfill", f"""
WITH a AS (SELECT event_id, {_AGES} AS age FROM events), c AS (SELECT count(*) FILTER (age <= 24) AS h24, count(*) FILTER (age <= 36) AS h36, count(*) FILTER (age <= 48) AS h48 FROM a WHERE age BETWEEN -2 AND 72),
w AS (SELECT CASE WHEN h24 >= 600 THEN 24 WHEN h36 >= 600 THEN 36 WHEN h48 >= 600 THEN 48 ELSE 72 END AS hours FROM c)
SELECT event_id, CAST(hours AS INTEGER) AS hours, CASE WHEN age <= 24 THEN 24 WHEN age <= 36 THEN 36 WHEN age <= 48 THEN 48 ELSE 72 END AS first_window FROM a, w WHERE age BETWEEN -2 AND hours""")
def backfill(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return R.backfill(e, F.col("ts"), F.lit(NOW).cast("timestamp"), 600).select("event_id", F.col("hours").cast("int").alias("hours"), F.col("window").alias("first_window"))


@query("state_cache_recovery", f"""
WITH a AS (SELECT event_id, {_AGES} AS age FROM events) SELECT event_id, CASE WHEN age <= 8 THEN 'fresh' ELSE 'cache' END AS origin FROM a
WHERE age BETWEEN -2 AND 8 OR (age BETWEEN -2 AND 24 AND event_id % 2 = 0 AND age > 8)""")
def cache_recovery(spark, sf):
    """The fresh rows and, where it adds to them, what a cache (here: of even ids) still holds of the window."""
    e = table(spark, sf, "events").select("event_id", ((F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9).alias("age"))
    fresh = e.where(F.col("age").between(-2, 8)).select("event_id", F.lit("fresh").alias("origin"))
    cache = e.where(F.col("age").between(-2, 24) & (F.col("event_id") % 2 == 0)).select("event_id", F.lit("cache").alias("origin"))
    return fresh.unionByName(cache.join(fresh.select("event_id"), "event_id", "left_anti"))


@query("state_late_rows", """
SELECT item_row, CAST(date_diff('day', CAST(published_at AS DATE), edition_date) AS INTEGER) AS days_late FROM edition_items WHERE date_diff('day', CAST(published_at AS DATE), edition_date) NOT BETWEEN 0 AND 1""")
def late_rows(spark, sf):
    late = F.date_diff("edition_date", F.to_date("published_at"))
    return table(spark, sf, "edition_items").select("item_row", late.alias("days_late")).where(~F.col("days_late").between(0, 1))
