"""Counts, baselines, anomalies, calendar buckets, quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.config import CATEGORIES, LIMITS
from tidewire.operators import anomaly, scoring
from tidewire.plans import sqltext as S
from tidewire.plans.registry import query, table
from tidewire.plans.score_plans import AREAS, NOW, now, paper_candidates, papers_sql

_CAT = S.category_key("category")


@query("agg_category_counts", f"SELECT CAST(edition_date AS VARCHAR) AS edition_date, {_CAT} AS category, CAST(count(*) AS BIGINT) AS n FROM edition_items GROUP BY ALL")
def category_counts(spark, sf):
    e = table(spark, sf, "edition_items")
    return e.groupBy(F.col("edition_date").cast("string").alias("edition_date"), scoring.category_key(F.col("category")).alias("category")).agg(F.count("*").alias("n"))


@query("agg_diversity_violations", f"""
SELECT CAST(edition_date AS VARCHAR) AS edition_date, {_CAT} AS category, CAST(count(*) AS BIGINT) AS n FROM edition_items GROUP BY ALL
HAVING count(*) > 3 AND count(DISTINCT lower(source)) < count(*)""")
def diversity_violations(spark, sf):
    e = table(spark, sf, "edition_items").groupBy(F.col("edition_date").cast("string").alias("edition_date"), scoring.category_key(F.col("category")).alias("category"))
    return e.agg(F.count("*").alias("n"), F.count_distinct(F.lower("source")).alias("s")).where("n > 3 AND s < n").drop("s")


@query("agg_month_shards", """
SELECT strftime(edition_date, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n_items, CAST(count(DISTINCT edition_date) AS BIGINT) AS n_editions, CAST(min(edition_date) AS VARCHAR) AS first_date, CAST(max(edition_date) AS VARCHAR) AS last_date
FROM edition_items GROUP BY 1""")
def month_shards(spark, sf):
    e = table(spark, sf, "edition_items").groupBy(F.date_format("edition_date", "yyyy-MM").alias("month"))
    return e.agg(F.count("*").alias("n_items"), F.count_distinct("edition_date").alias("n_editions"), F.min("edition_date").cast("string").alias("first_date"), F.max("edition_date").cast("string").alias("last_date"))


@query("agg_seen_span", "SELECT event_id, CAST(min(edition_date) AS VARCHAR) AS first_seen, CAST(max(edition_date) AS VARCHAR) AS last_seen, CAST(count(DISTINCT edition_date) AS BIGINT) AS n_days FROM edition_items GROUP BY 1")
def seen_span(spark, sf):
    return table(spark, sf, "edition_items").groupBy("event_id").agg(F.min("edition_date").cast("string").alias("first_seen"), F.max("edition_date").cast("string").alias("last_seen"), F.count_distinct("edition_date").alias("n_days"))


_GRID = """
days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), kinds AS (SELECT DISTINCT event_type AS dim FROM events),
counts AS (SELECT CAST(ts AS DATE) AS day, event_type AS dim, count(*) AS n FROM events GROUP BY ALL),
grid AS (SELECT day, dim, coalesce(n, 0) AS n FROM days CROSS JOIN kinds LEFT JOIN counts USING (day, dim))"""


@query("agg_daily_grid", f"WITH {_GRID} SELECT CAST(day AS VARCHAR) AS day, dim, CAST(n AS BIGINT) AS n FROM grid")
def daily_grid(spark, sf):
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("dim"))
    return anomaly.daily_grid(e).select(F.col("day").cast("string").alias("day"), "dim", "n")


@query("agg_median_mad", f"WITH {_GRID} SELECT dim, CAST(median(n) AS DOUBLE) AS med, CAST(mad(n) AS DOUBLE) AS mad FROM grid GROUP BY dim")
def median_mad(spark, sf):
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("dim"))
    return anomaly.median_mad(anomaly.daily_grid(e)).select("dim", "med", "mad")


_SQUEEZED = S.squeeze("coalesce(t, '')")
_SIGNALS = f"""latest AS (SELECT max(edition_date) AS d FROM editions),
e AS (SELECT edition_date AS day, {S.strip("coalesce(category, '')")} AS cat, coalesce(tags, []) AS tags, lower(coalesce(source, '')) AS grp FROM edition_items),
names AS (SELECT 'entity' AS dimension, name, lower(name) AS needle FROM (SELECT DISTINCT {_SQUEEZED} AS name FROM (SELECT unnest(tags) AS t FROM e, latest WHERE day = d) WHERE {_SQUEEZED} <> '' ORDER BY 1 LIMIT 40)
  UNION ALL SELECT 'category', c, c FROM (SELECT unnest([{', '.join(f"'{c}'" for c in CATEGORIES)}]) AS c)),
each AS (SELECT day, grp, 'category' AS dimension, cat AS needle FROM e UNION ALL SELECT day, grp, 'entity', unnest(list_distinct(list_transform(tags, lambda t: lower({_SQUEEZED})))) FROM e),
m AS (SELECT n.dimension, n.name, day, grp FROM each JOIN names n USING (dimension, needle)),
days AS (SELECT DISTINCT day FROM e, latest WHERE day < d AND day >= d - 30),
now AS (SELECT dimension, name, count(*) AS c, count(DISTINCT nullif(grp, '')) AS g FROM m, latest WHERE day = d GROUP BY ALL),
base AS (SELECT n.dimension, n.name, days.day, count(m.day) AS n FROM now n CROSS JOIN days LEFT JOIN m ON m.dimension = n.dimension AND m.name = n.name AND m.day = days.day GROUP BY ALL),
stat AS (SELECT dimension, name, median(n) AS med, mad(n) AS mad, count(*) AS observed FROM base GROUP BY ALL),
judged AS (SELECT n.dimension, n.name, n.c, s.med, c / greatest(0.5, med) AS ratio, (c - med) / greatest(1, 1.4826 * mad) AS dev FROM now n JOIN stat s USING (dimension, name) WHERE observed >= 5 AND c >= 2 AND g >= 2),
signals AS (SELECT *, CASE WHEN ratio >= 3 AND dev >= 3 THEN 'high' ELSE 'elevated' END AS severity FROM judged WHERE ratio >= 1.8 AND c - med >= 1.5 AND dev >= 1.5)"""


def signal_items(spark, sf):
    e = table(spark, sf, "edition_items")
    return e.select(F.col("edition_date").alias("day"), "category", "tags", F.lower(F.coalesce("source", F.lit(""))).alias("grp"))


@query("stat_anomalies", f"""
WITH {_SIGNALS} SELECT dimension, name, CAST(c AS BIGINT) AS current_count, CAST(round_even(ratio, 1) AS DOUBLE) AS ratio, severity, CAST(row_number() OVER (ORDER BY severity = 'high' DESC, round_even(dev, 1) DESC, round_even(ratio, 1) DESC, dimension, name) AS INTEGER) AS place FROM signals""")
def anomalies(spark, sf):
    """What stands out in the latest edition; five observed days are enough here, as the smallest tables have no more."""
    latest = table(spark, sf, "editions").agg(F.max("edition_date").alias("d")).first()["d"]
    out = anomaly.signals(signal_items(spark, sf), F.lit(latest), min_observed=5)
    return out.select("dimension", "name", "current_count", F.bround("ratio", 1).alias("ratio"), "severity", "place")


@query("agg_source_counts", "SELECT CAST(edition_date AS VARCHAR) AS edition_date, source, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY edition_date ORDER BY n DESC, source) AS INTEGER) AS place FROM (SELECT edition_date, coalesce(source, '未知来源') AS source, count(*) AS n FROM edition_items GROUP BY 1, 2)")
def source_counts(spark, sf):
    """Sources of every edition by falling count, then name."""
    from pyspark.sql import Window as W

    g = table(spark, sf, "edition_items").groupBy("edition_date", F.coalesce("source", F.lit("未知来源")).alias("source")).agg(F.count("*").alias("n"))
    return g.select(F.col("edition_date").cast("string").alias("edition_date"), "source", "n", F.row_number().over(W.partitionBy("edition_date").orderBy(F.desc("n"), "source")).alias("place"))


@query("agg_area_counts", f"SELECT area, CAST(count(*) AS BIGINT) AS n FROM ({papers_sql(f"TIMESTAMP '{NOW}'")}) GROUP BY 1")
def area_counts(spark, sf):
    return scoring.scored_papers(paper_candidates(spark, sf), now(), AREAS).groupBy("area").agg(F.count("*").alias("n"))


@query("agg_quota_profile", f"""
WITH top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edition_date ORDER BY score DESC NULLS LAST, published_at DESC NULLS LAST, item_row) AS place FROM edition_items) WHERE place <= 10),
k AS (SELECT edition_date, {_CAT} AS category, {S.category_key('source')} AS source FROM top)
SELECT CAST(edition_date AS VARCHAR) AS edition_date, kind, name, CAST(n AS BIGINT) AS n, n > CASE kind WHEN 'category' THEN 3 ELSE 2 END AS violated
FROM (SELECT edition_date, kind, name, count(*) AS n FROM (SELECT edition_date, 'category' AS kind, category AS name FROM k UNION ALL SELECT edition_date, 'source', source FROM k) GROUP BY 1, 2, 3)""")
def quota_profile(spark, sf):
    """Of every report's ten items: counts by category and source, and which exceed three or two."""
    from tidewire.plans.link_plans import report_items

    k = report_items(spark, sf).select("edition_date", F.explode(F.array(F.struct(F.lit("category").alias("kind"), scoring.category_key(F.col("category")).alias("name")), F.struct(F.lit("source").alias("kind"), scoring.category_key(F.col("source")).alias("name")))).alias("x"))
    g = k.groupBy(F.col("edition_date").cast("string").alias("edition_date"), "x.kind", "x.name").agg(F.count("*").alias("n"))
    return g.withColumn("violated", F.col("n") > F.when(F.col("kind") == "category", LIMITS.per_category).otherwise(LIMITS.per_domain))


@query("dq_violations", f"""
SELECT 'item without id' AS rule, CAST(count(*) AS BIGINT) AS n FROM edition_items WHERE id IS NULL OR trim(id) = ''
UNION ALL SELECT 'item without title', count(*) FROM edition_items WHERE {S.squeeze("coalesce(title, '')")} = ''
UNION ALL SELECT 'score out of range', count(*) FROM edition_items WHERE score NOT BETWEEN 0 AND 100
UNION ALL SELECT 'item of no edition', count(*) FROM edition_items WHERE edition_date NOT IN (SELECT edition_date FROM editions)
UNION ALL SELECT 'unusable url', count(*) FROM edition_items WHERE NOT coalesce(regexp_matches(url, '^https?://'), false)""")
def violations(spark, sf):
    e, d = table(spark, sf, "edition_items"), table(spark, sf, "editions")
    from tidewire.functions.text import squeeze

    rules = {
        "item without id": F.col("id").isNull() | (F.trim("id") == ""),
        "item without title": squeeze(F.coalesce("title", F.lit(""))) == "",
        "score out of range": ~F.col("score").between(0, 100),
        "item of no edition": F.col("known").isNull(),
        "unusable url": ~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)),
    }
    rows = e.join(d.select("edition_date", F.lit(1).alias("known")).distinct(), "edition_date", "left")
    # All rules in one pass over the items.
    counts = rows.agg(*(F.count_if(c).alias(n) for n, c in rules.items()))
    return counts.unpivot([], list(rules), "rule", "n")
