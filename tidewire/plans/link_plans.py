"""Duplicates, clusters, associations and plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.config import LIMITS, NEWS_RESEARCH_AREAS
from tidewire.functions import text, web
from tidewire.operators import clustering, linkage, scoring, selection
from tidewire.plans import sqltext as S
from tidewire.plans.registry import query, table
from tidewire.plans.score_plans import AREAS, NOW, now, paper_candidates, papers_sql
from tidewire.shared import written

_URL = f"{S.canonical_url('url')}"


@query("join_dedup_url", f"""
SELECT item_row, CAST(min(item_row) OVER (PARTITION BY u) AS BIGINT) AS first_row FROM (SELECT item_row, {_URL} AS u FROM edition_items) WHERE u <> ''""")
def dedup_url(spark, sf):
    e = table(spark, sf, "edition_items").select("item_row", web.canonical_url(F.col("url")).alias("u")).where("u != ''")
    first = e.groupBy("u").agg(F.min("item_row").alias("first_row"))  # partial sums first: a hot address costs no window
    return e.join(first, "u").select("item_row", "first_row")


def collected_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "articles").select("article_row", "title", "description", "url", "domain", "source", "published_at")


def title_rows(articles: DataFrame, *also: str) -> DataFrame:
    """Collected articles as nodes: newest first, ties by their number."""
    a = scoring.prepared(articles, now())
    return a.select(F.col("article_row").alias("row"), "ts", "title", "description", "url", "domain", "source", F.struct((-F.unix_micros("ts")).alias("t"), F.col("article_row").alias("n")).alias("ord"), *also)


def collected_titles(spark, sf) -> DataFrame:
    """Cleaned once, as the days are counted before the titles are sent."""
    return written(linkage.titled(title_rows(collected_rows(spark, sf)).select("row", "ts", "title")), "titles")


_TITLES = f"""prepared AS ({S.prepared(NOW)}),
t AS (SELECT article_row AS row_no, ts, {S.norm_title('title')} AS norm, {S.title_tokens('title')} AS tokens, {S.acronyms('title')} AS acr FROM prepared)"""


@query("join_same_event", f"""
WITH {_TITLES}, pairs AS (SELECT a.row_no AS row_a, b.row_no AS row_b, a.norm = b.norm AS equal, list_intersect(a.tokens, b.tokens) AS shared, least(len(a.tokens), len(b.tokens)) AS smaller, list_intersect(a.acr, b.acr) AS acr
  FROM t a JOIN t b ON a.row_no < b.row_no AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400000000)
SELECT row_a, row_b FROM pairs
WHERE equal OR (len(shared) >= 4 AND len(shared) / smaller >= 0.5) OR (len(shared) >= 3 AND len(shared) / smaller >= 0.35 AND len(list_intersect(shared, acr)) > 0)""")
def same_event(spark, sf):
    """Rules 1, 3 and 4: equal normalised titles, shared tokens, shared tokens with an acronym of both."""
    return linkage.pairs_by_words(collected_titles(spark, sf))


@query("join_near_titles")
def near_titles(spark, sf):
    """Rule 2: the sequence ratio, which SQL does not know; held against all pairs in the tests."""
    return linkage.pairs_by_ratio(collected_titles(spark, sf))


def clusters(spark, sf) -> DataFrame:
    """The leader of each collected article; only what this needs is cleaned."""
    rows = written(title_rows(collected_rows(spark, sf)).select("row", "ts", "title", "url", "ord"), "collected")
    return clustering.leaders(rows.select("row", "ord", "url"), linkage.same_event_pairs(rows.select("row", "ts", "title")))


@query("join_leaders")
def leaders(spark, sf):
    """Clusters by address, title and time as a pass in order of time forms them; held against such a pass in the tests."""
    return clusters(spark, sf)


def of_clusters(articles: DataFrame, lead: DataFrame) -> DataFrame:
    """The articles in ``lead`` with their leader. Written as collected, so that no other article is cleaned."""
    return title_rows(written(articles.join(lead.select(F.col("row").alias("article_row"), "leader"), "article_row"), "clustered"), "leader")


@query("agg_merged_evidence")
def merged_evidence(spark, sf):
    """What each cluster knows together: members, evidence, independent groups; held against a pass in the tests."""
    shared, alone = clustering.parted(clusters(spark, sf))
    one = F.lit(1).cast("long")  # an article alone is its own only evidence
    merged = clustering.merged(clustering.evidence(of_clusters(collected_rows(spark, sf), shared))).drop("description")
    return merged.unionByName(alone.select("leader", one.alias("n_members"), one.alias("n_evidence"), one.alias("corroboration")))


@query("score_merged")
def score_merged(spark, sf):
    """The pipeline from collected articles to scored leaders, with corroboration and the best weight of all evidence."""
    from tidewire.plans.score_plans import outlets

    shared, alone = clustering.parted(clusters(spark, sf))
    rows = written(clustering.evidence(of_clusters(collected_rows(spark, sf), shared)), "evidence")
    own = ("row", "ts", "title", "description", "leader", "domain", "source")
    many = rows.where("row = leader").drop("description").join(clustering.merged(rows), "leader").select(*own, "corroboration")
    # Of the articles alone only those of the window are scored, and one without a date stands at its edge.
    recent = F.col("published_at").isNull() | scoring.in_window(F.col("published_at").cast("timestamp"), now())
    single = of_clusters(collected_rows(spark, sf).where(recent), alone).select(*own, F.lit(1).cast("long").alias("corroboration"))
    single = written(single, "alone")
    kept = rows.where("kept").select("leader", "domain", "source").unionByName(single.select("leader", "domain", "source"))
    weight = scoring.weighted_outlets(kept, *outlets(spark, sf)).groupBy("leader").agg(F.max("weight").alias("weight"))
    also = table(spark, sf, "articles").select(F.col("article_row").alias("row"), "category", F.col("published_at").isNull().alias("estimated"))
    return scoring.scored(many.unionByName(single).join(weight, "leader").join(also, "row"), now()).select(F.col("row").alias("article_row"), F.col("best.name").alias("best_category"), "raw_score", "corroboration")


_BEST = "score DESC NULLS LAST, published_at DESC NULLS LAST, item_row"


def report_items(spark, sf) -> DataFrame:
    """The ten best items of every edition; a top list, whatever the table's size."""
    from tidewire.operators.selection import first_per_key
    from tidewire.plans.rank_plans import by_score

    e = table(spark, sf, "edition_items").withColumn("day", F.col("edition_date"))
    return first_per_key(e, ["edition_date"], by_score(), 10).withColumn("row", F.col("item_row")).drop("place")


_LOWER = lambda c: f"list_distinct(list_filter(list_transform(coalesce({c}, []), lambda w: lower({S.squeeze('w')})), lambda w: w <> ''))"
_UNION = lambda a, b: f"list_distinct(list_concat({a}, {b}))"
_SHARE = lambda a, b: f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0.0 END)"
_SIDE = f"""c AS (SELECT item_row, id, edition_date, score, published_at, {S.strip("coalesce(category, '')")} AS cat, {_LOWER('tags')} AS tags, {S.clean('title')} AS ct, {S.clean('summary')} AS cs FROM edition_items),
h AS (SELECT *, {S.history_tokens('ct')} AS tt, {_UNION(S.history_tokens('ct'), S.history_tokens('cs'))} AS al, {S.norm_title('ct')} AS norm, {S.title_tokens('ct')} AS tok, {S.acronyms('ct')} AS acr FROM c)"""
_HISTORY = f"""{_SIDE}, latest AS (SELECT max(edition_date) AS d FROM editions),
report AS (SELECT h.* FROM h, latest WHERE edition_date = d ORDER BY {_BEST} LIMIT 10),
pairs AS (SELECT a.item_row AS row_a, b.item_row AS row_b, b.edition_date AS day_b, a.cat = b.cat AS same, list_intersect(a.tt, b.tt) AS st, len(list_intersect(a.al, b.al)) AS sa, {_SHARE('a.tt', 'b.tt')} AS t, {_SHARE('a.al', 'b.al')} AS al, {_SHARE('a.tags', 'b.tags')} AS g,
  a.norm = b.norm OR (len(list_intersect(a.tok, b.tok)) >= 4 AND {_SHARE('a.tok', 'b.tok')} >= 0.5) OR (len(list_intersect(a.tok, b.tok)) >= 3 AND {_SHARE('a.tok', 'b.tok')} >= 0.35 AND len(list_intersect(list_intersect(list_intersect(a.tok, b.tok), a.acr), b.acr)) > 0) AS direct
  FROM report a, h b WHERE b.edition_date < a.edition_date AND b.edition_date >= a.edition_date - 365 AND b.id IS NOT NULL AND a.id IS DISTINCT FROM b.id),
scored AS (SELECT *, CAST(greatest(0, least(100, round_even(55 * t + 27 * al + 10 * g + CASE WHEN same THEN 5 ELSE 0 END + CASE WHEN direct THEN 18 ELSE 0 END, 0))) AS INTEGER) AS points FROM pairs
  WHERE direct OR len(st) >= 2 OR sa >= 3 OR t >= 0.28 OR al >= 0.2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_a ORDER BY points DESC, day_b DESC, row_b) AS place FROM scored WHERE points >= 30)"""


def history_of_report(spark, sf) -> DataFrame:
    latest = table(spark, sf, "editions").agg(F.max("edition_date").alias("d"))  # one row
    report = report_items(spark, sf).join(F.broadcast(latest), F.col("day") == F.col("d")).drop("d")
    archive = table(spark, sf, "edition_items").select(F.col("item_row").alias("row"), "id", F.col("edition_date").alias("day"), "title", "summary", "category", "tags")
    return linkage.history_links(report, archive)


@query("join_history", f"""
WITH {_HISTORY} SELECT row_a, row_b, points, CAST(place AS INTEGER) AS place, CASE WHEN direct THEN '同一事件后续' ELSE '相关主题演进' END AS label FROM ranked WHERE place <= 3""")
def history(spark, sf):
    """The latest report's ten items and what the archive of a year has on each."""
    return history_of_report(spark, sf).select("row_a", "row_b", "points", "place", "label")


@query("join_history_reasons", f"""
WITH {_HISTORY} SELECT row_a, row_b, CASE WHEN direct THEN '标题结构显示为同一事件的后续报道|' ELSE '' END || CASE WHEN len(st) > 0 THEN '标题共享关键词：' || array_to_string(list_sort(st)[1:4], '、') ELSE '' END AS reasons FROM ranked WHERE place <= 3""")
def history_reasons(spark, sf):
    """The first reasons of each link: the same event, and the shared words of the titles."""
    out = history_of_report(spark, sf)
    said = F.filter("reasons", lambda r: r.startswith("标题共享关键词") | r.startswith("标题结构"))
    joined = F.concat(F.array_join(said, "|"), F.when(F.col("direct") & (F.size(said) == 1), "|").otherwise(""))
    return out.select("row_a", "row_b", joined.alias("reasons"))


def edition_papers(spark, sf) -> DataFrame:
    """The papers of every edition: of the week before its end of day, at most 60 and 12 of an area first, best score first."""
    days = table(spark, sf, "editions").select(F.col("edition_date").alias("day"))
    end = F.date_add("day", 1).cast("timestamp")
    terms = written(scoring.paper_terms(paper_candidates(spark, sf), AREAS), "paper-terms")  # once a paper, not once a day
    p = scoring.fresh_papers(terms.join(days, scoring.in_paper_window(F.col("published_at"), F.col("updated_at"), end)), end)
    order = [F.desc("paper_score"), F.desc("updated_at"), F.asc("paper_row")]
    # Cut in two steps: no area can fill more than 60 places of a day.
    placed = selection.first_per_key(p, ["day", "area"], order, LIMITS.paper_limit).withColumn("over", F.col("place") > LIMITS.paper_per_area).drop("place")
    return selection.first_per_key(placed, ["day"], [F.asc("over"), *order], LIMITS.paper_limit).drop("place")


_EDITION_PAPERS = f"""p0 AS (SELECT p.*, e.edition_date AS day FROM papers p JOIN editions e ON greatest(p.published_at, coalesce(p.updated_at, p.published_at)) >= CAST(e.edition_date + 1 AS TIMESTAMP) - INTERVAL 7 DAY AND p.published_at <= CAST(e.edition_date + 1 AS TIMESTAMP) + INTERVAL 2 HOUR),
p1 AS ({papers_sql('CAST(day + 1 AS TIMESTAMP)').replace(' FROM papers)', ' FROM p0)')}),
p2 AS (SELECT *, row_number() OVER (PARTITION BY day, area ORDER BY paper_score DESC, upd DESC, paper_row) > 12 AS over FROM p1),
p3 AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY over, paper_score DESC, upd DESC, paper_row) AS place FROM p2)"""


@query("topk_edition_papers", f"WITH {_EDITION_PAPERS} SELECT CAST(day AS VARCHAR) AS day, paper_row, area, CAST(place AS INTEGER) AS place FROM p3 WHERE place <= 60")
def papers_of_editions(spark, sf):
    p = edition_papers(spark, sf)
    order = [F.asc("over"), F.desc("paper_score"), F.desc("updated_at"), F.asc("paper_row")]
    return selection.first_per_key(p, ["day"], order, LIMITS.paper_limit).select(F.col("day").cast("string").alias("day"), "paper_row", "area", "place")


#: An area named like a category belongs to it, beside the fixed ones.
_AREAS = {n: (*those, n) for n, those in NEWS_RESEARCH_AREAS.items()}


def news_to_papers(spark, sf) -> DataFrame:
    news = table(spark, sf, "edition_items").select(F.col("item_row").alias("row"), F.col("edition_date").alias("day"), "title", "summary", "category", "tags")
    papers = written(edition_papers(spark, sf), "edition-papers").select(F.col("paper_row").alias("row"), "day", "title", "abstract", "tags", "keywords", "area", F.bround("paper_score").cast("int").alias("score"))
    return linkage.paper_links(news, papers, _AREAS)


_WORDS = lambda *c: S.history_tokens(" || ' ' || ".join(c))
_MATCH = "CASE cat " + " ".join(f"WHEN '{n}' THEN area IN ({', '.join(f"'{a}'" for a in those)})" for n, those in _AREAS.items()) + " ELSE false END"
_NP = f"""{_EDITION_PAPERS}, pt AS (SELECT *, list_filter(list_concat([area], all_keywords, [coalesce(primary_category, '')], {S.longest(S.found_words('body', scoring.TOPICS), 200)}), lambda w: w <> '') AS raw_tags FROM p3 WHERE place <= 60),
pw AS (SELECT paper_row, day, area, CAST(round_even(paper_score, 0) AS INTEGER) AS ps, {_LOWER('all_keywords')} AS keys, {S.clean('title')} AS ct, {S.clean('abstract')} AS ca, array_to_string(list_filter(raw_tags, lambda w, i: list_position(raw_tags, w) = i)[1:5], ' ') AS tg, array_to_string(all_keywords, ' ') AS kw FROM pt),
p AS (SELECT *, {_WORDS('ct')} AS tt, {_UNION(_WORDS('ct'), _WORDS('ca', 'tg', 'kw'))} AS al FROM pw),
nw AS (SELECT item_row, edition_date AS day, {S.strip("coalesce(category, '')")} AS cat, {_LOWER('tags')} AS tags, {S.clean('title')} AS ct, {S.clean('summary')} AS cs, array_to_string(coalesce(tags, []), ' ') AS tg FROM edition_items),
n AS (SELECT *, {_WORDS('ct')} AS tt, {_UNION(_WORDS('ct'), _WORDS('cs', 'tg'))} AS al FROM nw),
pairs AS (SELECT item_row AS row_a, paper_row AS row_b, ps, cat, area, {_SHARE('n.tt', 'p.tt')} AS t, {_SHARE('n.al', 'p.al')} AS al, len(list_intersect(n.tt, p.tt)) AS st, len(list_intersect(n.al, p.al)) AS sa, len(list_intersect(n.tags, p.keys)) AS hits FROM n JOIN p USING (day)),
scored AS (SELECT *, CAST(greatest(0, least(100, round_even(48 * t + 28 * al + CASE WHEN {_MATCH} THEN 14 ELSE 0 END + least(12, hits * 6), 0))) AS INTEGER) AS points FROM pairs WHERE st >= 1 OR sa >= 2 OR hits > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_a ORDER BY points DESC, ps DESC, row_b) AS place FROM scored WHERE points >= 24),
forward AS (SELECT row_a, row_b, points, CAST(place AS INTEGER) AS place, CASE WHEN cat IN ('无人系统', 'AI', '军事动态') AND area IN ('机器人与无人系统', '自主与控制系统', '人工智能', '机器学习') THEN '潜在使能技术' WHEN cat = '航空航天' AND area IN ('天文与空间科学', '空间物理') THEN '科学与任务背景' ELSE '同主题研究' END AS relation FROM ranked WHERE place <= 3)"""


@query("join_news_papers", f"WITH {_NP} SELECT * FROM forward")
def news_papers(spark, sf):
    """The best three papers of every item, among the papers of its edition."""
    return news_to_papers(spark, sf).select("row_a", "row_b", "points", "place", "relation")


@query("join_papers_news", f"""
WITH {_NP} SELECT row_b AS paper_row, row_a AS item_row, points FROM (SELECT f.*, row_number() OVER (PARTITION BY row_b ORDER BY points DESC, published_at DESC NULLS LAST, row_a) AS back FROM forward f JOIN edition_items ON item_row = row_a) WHERE back <= 3""")
def papers_news(spark, sf):
    """Of every paper the best three of the items that have it among their best."""
    when = table(spark, sf, "edition_items").select(F.col("item_row").alias("row_a"), "published_at")
    back = linkage.reverse_links(news_to_papers(spark, sf), when)
    return back.select(F.col("row_b").alias("paper_row"), F.col("row_a").alias("item_row"), "points")


_NID = "lower(trim(id))"


@query("join_unseen", f"SELECT batch_row FROM incoming_items WHERE id IS NOT NULL AND {_NID} NOT IN (SELECT {_NID} FROM edition_items WHERE id IS NOT NULL)")
def unseen(spark, sf):
    key = F.lower(F.trim("id"))
    known = table(spark, sf, "edition_items").where("id IS NOT NULL").select(key.alias("k"))
    return table(spark, sf, "incoming_items").where("id IS NOT NULL").withColumn("k", key).join(known, "k", "left_anti").select("batch_row")


@query("join_reused_titles", f"""
SELECT batch_row, CAST(min(item_row) AS BIGINT) AS item_row FROM incoming_items i JOIN edition_items e ON lower(trim(i.id)) = lower(trim(e.id)) AND {S.squeeze('i.title')} = {S.squeeze('e.title')} GROUP BY 1""")
def reused_titles(spark, sf):
    of = lambda t, c: table(spark, sf, t).select(c, F.lower(F.trim("id")).alias("k"), text.squeeze(F.col("title")).alias("t"))
    return of("incoming_items", "batch_row").join(of("edition_items", "item_row"), ["k", "t"]).groupBy("batch_row").agg(F.min("item_row").alias("item_row"))


@query("join_retained", "SELECT item_row FROM edition_items WHERE edition_date IN (SELECT edition_date FROM editions ORDER BY edition_date DESC LIMIT 3)")
def retained(spark, sf):
    kept = table(spark, sf, "editions").select("edition_date").orderBy(F.desc("edition_date")).limit(3)
    return table(spark, sf, "edition_items").join(kept, "edition_date", "left_semi").select("item_row")


@query("agg_independent_sources", f"""
WITH names AS (SELECT lower(n) AS name, min(source_id) AS source_id FROM (SELECT source_id, unnest(list_concat([source, domain], coalesce(aliases, []))) AS n FROM sources) GROUP BY 1)
SELECT event_id, CAST(count(DISTINCT coalesce(s.evidence_group, 'outlet:' || k)) AS BIGINT) AS n_groups
FROM (SELECT event_id, {S.category_key('source')} AS k FROM edition_items) e LEFT JOIN names n ON e.k = n.name LEFT JOIN sources s USING (source_id) WHERE k <> '' GROUP BY 1""")
def independent_sources(spark, sf):
    s = table(spark, sf, "sources")
    names = s.select("source_id", "evidence_group", F.explode(F.concat(F.array("source", "domain"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    names = names.groupBy(F.lower("n").alias("k")).agg(F.min_by("evidence_group", "source_id").alias("grp"))
    e = table(spark, sf, "edition_items").select("event_id", scoring.category_key(F.col("source")).alias("k")).where("k != ''").distinct()
    return e.join(names, "k", "left").groupBy("event_id").agg(F.count_distinct(F.coalesce("grp", F.concat(F.lit("outlet:"), "k"))).alias("n_groups"))
