"""Filters, classification and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.config import CATEGORIES, COLLECTION_KEYWORDS, EXCLUDE, IMPACT, OTHER_AREA, OTHER_PRIORITY, PENALTY
from tidewire.operators import scoring
from tidewire.plans import sqltext as S
from tidewire.plans.registry import query, table

NOW = "2026-07-30 12:00:00"
#: The tables' own preprint categories, in order of precedence.
AREAS = (("xp.AI", "AI", 10), ("xp.RO", "无人系统", 10), ("xp.AE", "航空航天", 9), ("xp.QP", "前沿技术", 8), ("xp.SY", "军事动态", 9), ("xp.CR", "局部冲突", 8))


def now():
    return F.lit(NOW).cast("timestamp")


def outlets(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Weights of hosts and names as the table of sources has them."""
    s = table(spark, sf, "sources")
    names = s.select(F.explode(F.concat(F.array("source"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"), "weight")
    return s.select(F.col("source_id").alias("place"), F.lower("domain").alias("host"), "weight"), names


def candidates(spark, sf) -> DataFrame:
    """Collected articles with the weight of their outlet; each is its own only evidence."""
    a = scoring.prepared(table(spark, sf, "articles").select("article_row", "title", "description", "url", "domain", "source", "category", "published_at"), now())
    return scoring.weighted_outlets(a, *outlets(spark, sf)).withColumn("corroboration", F.lit(1))


_NAME, _POINTS = S.best_category("body", "cat")
_BODY = "lower(title || ' ' || description)"
_TOPICS = S.hits("body", scoring.TOPICS)
_PREPARED = f"prepared AS ({S.prepared(NOW)}), body AS (SELECT *, {_BODY} AS body, {S.category_key('category')} AS cat FROM prepared)"
_WEIGHT = """coalesce((SELECT arg_min(weight, source_id) FROM sources s WHERE b.domain = lower(s.domain) OR ends_with(b.domain, '.' || lower(s.domain))),
  (SELECT max(weight) FROM (SELECT weight, unnest(list_concat([source], coalesce(aliases, []))) AS name FROM sources) n WHERE n.name = b.source),
  CASE WHEN regexp_matches(b.domain, '\\.(gov|mil)$') THEN 18 ELSE 10 END)"""
_KEPT = f"""kept AS (SELECT *, greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3.6e9) AS age, {_TOPICS} AS n_topics, {_NAME} AS best, {_WEIGHT} AS weight FROM body b
  WHERE ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{NOW}' + INTERVAL 2 HOUR AND ({_TOPICS}) > 0 AND ({S.hits('body', EXCLUDE)}) = 0)"""
_PRIORITY = "CASE best " + " ".join(f"WHEN '{n}' THEN {p}" for n, (p, _) in CATEGORIES.items()) + " END"
_TERMS = {
    "source": "weight", "priority": _PRIORITY, "recency": "CAST(round_even(greatest(0, 20 - 0.5 * age), 0) AS INTEGER)", "impact": f"least(22, {S.weighted('body', IMPACT)})", "relevance": "least(12, 2 * n_topics)",
    "evidence": "CASE WHEN length(description) >= 80 THEN 3 ELSE 2 END", "corroboration": "0", "penalty": f"-least(24, 12 * {S.hits('body', PENALTY)})", "date_penalty": "CASE WHEN estimated THEN -7 ELSE 0 END", "late_penalty": "0",
}
_TOTAL = "CAST(greatest(0, least(100, 15 + " + " + ".join(f"({t})" for t in _TERMS.values()) + ")) AS INTEGER)"


@query("score_classify", f"WITH {_PREPARED} SELECT article_row, {_NAME} AS best_category, CAST({_POINTS} AS INTEGER) AS points FROM body")
def classify(spark, sf):
    a = scoring.prepared(table(spark, sf, "articles"), now()).withColumn("body", scoring.body_of("title", "description"))
    return scoring.classified(a, F.col("body"), F.col("category")).select("article_row", F.col("best.name").alias("best_category"), F.col("best.points").alias("points"))


@query("score_articles", f"WITH {_PREPARED}, {_KEPT} SELECT article_row, best AS best_category, {_TOTAL} AS raw_score FROM kept")
def score_articles(spark, sf):
    """The qualified articles of the last day by the integer formula, all terms."""
    return scoring.scored(candidates(spark, sf), now()).select("article_row", F.col("best.name").alias("best_category"), "raw_score")


@query("score_terms", f"WITH {_PREPARED}, {_KEPT} SELECT article_row, " + ", ".join(f"CAST({t} AS INTEGER) AS {n}" for n, t in _TERMS.items()) + " FROM kept")
def score_terms(spark, sf):
    return scoring.scored(candidates(spark, sf), now()).select("article_row", "parts.*")


_TAGS = "CASE best " + " ".join(f"WHEN '{n}' THEN {S.longest(S.found_words('body', w), 3)}" for n, (_, w) in CATEGORIES.items()) + " END"


@query("score_tags", f"WITH {_PREPARED}, {_KEPT} SELECT article_row, array_to_string({_TAGS}, '|') AS tags FROM kept")
def score_tags(spark, sf):
    """The three longest words that brought a row into its category."""
    return scoring.scored(candidates(spark, sf), now()).select("article_row", F.array_join("tags", "|").alias("tags"))


@query("score_reasons", f"""
WITH {_PREPARED}, {_KEPT}, t AS (SELECT *, {_TERMS['penalty']} AS penalty, {S.found_words('body', tuple(IMPACT))} AS words FROM kept)
SELECT article_row, '来源权重 ' || weight || '/20|发布约 ' || printf('%.1f', round_even(age, 1)) || ' 小时|命中 ' || n_topics || ' 个主题信号' || CASE WHEN len(words) > 0 THEN '|影响信号：' || array_to_string(words[1:3], '、') ELSE '' END
  || CASE WHEN penalty < 0 THEN '|编辑质量降权 ' || penalty ELSE '' END || CASE WHEN estimated THEN '|发布时间无法解析，按 24 小时窗口边缘处理并降权' ELSE '' END AS reasons FROM t""")
def score_reasons(spark, sf):
    return scoring.scored(candidates(spark, sf), now()).select("article_row", F.array_join("reasons", "|").alias("reasons"))


@query("score_weights", f"WITH {_PREPARED} SELECT article_row, CAST({_WEIGHT} AS INTEGER) AS weight FROM prepared b")
def score_weights(spark, sf):
    return candidates(spark, sf).select("article_row", "weight")


@query("flt_window_24h", f"SELECT article_row FROM articles WHERE published_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{NOW}' + INTERVAL 2 HOUR")
def window_24h(spark, sf):
    return table(spark, sf, "articles").where(scoring.in_window(F.col("published_at").cast("timestamp"), now())).select("article_row")


@query("flt_paper_window", f"SELECT paper_row FROM papers WHERE greatest(published_at, updated_at) >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND published_at <= TIMESTAMP '{NOW}' + INTERVAL 2 HOUR")
def paper_window(spark, sf):
    p = table(spark, sf, "papers").select("paper_row", F.col("published_at").cast("timestamp").alias("pub"), F.col("updated_at").cast("timestamp").alias("upd"))
    return p.where(scoring.in_paper_window(F.col("pub"), F.col("upd"), now())).select("paper_row")


@query("flt_relevant", f"WITH {_PREPARED} SELECT article_row, CAST({_TOPICS} AS INTEGER) AS n_hits FROM body WHERE ({_TOPICS}) > 0 AND ({S.hits('body', EXCLUDE)}) = 0")
def relevant(spark, sf):
    a = scoring.prepared(table(spark, sf, "articles"), now()).withColumn("body", scoring.body_of("title", "description"))
    c = scoring.classified(a, F.col("body"), F.col("category"))
    return c.where((F.col("any_hits") > 0) & ~scoring.excluded(F.col("hits"))).select("article_row", F.col("any_hits").alias("n_hits"))


def paper_candidates(spark, sf) -> DataFrame:
    p = table(spark, sf, "papers")
    return p.withColumns({"published_at": F.col("published_at").cast("timestamp"), "updated_at": F.coalesce("updated_at", "published_at").cast("timestamp")})


def _area_sql(of: int) -> str:
    out = f"'{OTHER_AREA}'" if of == 1 else str(OTHER_PRIORITY)
    for a in reversed(AREAS):
        out = f"CASE WHEN list_contains(cats, '{a[0]}') THEN {f"'{a[1]}'" if of == 1 else a[2]} ELSE {out} END"
    return out


def papers_sql(now: str) -> str:
    """Scored papers at a moment (SQL text of a timestamp); a query of its own over ``papers`` (and what ``now`` names)."""
    met = [(label, f"({S.hits('body', words)}) > 0", max(2, p - 5)) for label, p, words in COLLECTION_KEYWORDS]
    labels = "list_filter([" + ", ".join(f"CASE WHEN {hit} THEN '{label}' END" for label, hit, _ in met) + "], lambda x: x IS NOT NULL)"
    boost = "least(18, " + " + ".join(f"CASE WHEN {hit} THEN {points} ELSE 0 END" for _, hit, points in met) + ")"
    return f"""SELECT *, CASE WHEN own_area = '{OTHER_AREA}' AND len(all_keywords) > 0 THEN all_keywords[1] ELSE own_area END AS area,
  least(100.0, 35 + 2 * {_area_sql(2)} + greatest(0.0, 28.0 - age_days * 4) + least(14, 2 * ({_TOPICS})) + {boost} + CASE WHEN n >= 500 THEN 8 WHEN n >= 180 THEN 5 ELSE 2 END) AS paper_score
FROM (SELECT *, coalesce(nullif({S.squeeze("coalesce(research_area, '')")}, ''), {_area_sql(1)}) AS own_area, list_slice(list_concat(own_keywords, list_filter({labels}, lambda x: NOT list_contains(own_keywords, x))), 1, 20) AS all_keywords,
  greatest(0.0, (epoch_us({now}) - epoch_us(greatest(published_at, upd))) / 8.64e10) AS age_days FROM (
  SELECT *, coalesce(updated_at, published_at) AS upd, lower(concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))) AS body, length(coalesce(abstract, '')) AS n,
    coalesce(list_transform(list_filter(list_transform(collection_keywords, lambda x, i: {{'x': x, 'i': i}}), lambda q: list_position(collection_keywords, q.x) = q.i), lambda q: q.x), []) AS own_keywords,
    CASE WHEN len(list_filter(coalesce(categories, []), lambda c: {S.squeeze('c')} <> '')) > 0 THEN categories ELSE [coalesce(primary_category, '')] END AS cats FROM papers))"""


@query("score_papers", f"SELECT paper_row, area, CAST(round_even(paper_score, 0) AS INTEGER) AS paper_score FROM ({papers_sql(f"TIMESTAMP '{NOW}'")}) WHERE greatest(published_at, upd) >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND published_at <= TIMESTAMP '{NOW}' + INTERVAL 2 HOUR")
def score_papers(spark, sf):
    """Papers of the last week; the score is rounded when it is published."""
    p = scoring.scored_papers(paper_candidates(spark, sf), now(), AREAS)
    return p.where(scoring.in_paper_window(F.col("published_at"), F.col("updated_at"), now())).select("paper_row", "area", F.bround("paper_score").cast("int").alias("paper_score"))


@query("score_fused", """
SELECT item_row, CASE WHEN corroboration > 1 THEN CAST(round_even(0.65 * (corroboration * 20) + 0.35 * coalesce(score, 0), 0) AS INTEGER) ELSE coalesce(score, 0) END AS fused FROM edition_items""")
def fused(spark, sf):
    """Corroborated rows stand for those a model has scored."""
    e = table(spark, sf, "edition_items")
    return e.select("item_row", scoring.fused(F.when(F.col("corroboration") > 1, F.col("corroboration") * 20), F.coalesce("score", F.lit(0))).alias("fused"))


@query("score_confidence", """
WITH named AS (SELECT name, max(weight) AS weight FROM (SELECT weight, lower(unnest(list_concat([source, domain], coalesce(aliases, [])))) AS name FROM sources) GROUP BY 1),
e AS (SELECT event_id, lower(source) AS s, coalesce(weight, 10) AS weight FROM edition_items LEFT JOIN named ON lower(source) = name)
SELECT event_id, CAST(count(DISTINCT s) AS BIGINT) AS n_groups, CASE WHEN count(DISTINCT s) >= 3 OR (count(DISTINCT s) >= 2 AND max(weight) >= 17) THEN '高'
  WHEN count(DISTINCT s) >= 2 OR max(weight) >= 16 THEN '中' ELSE '待核验' END AS level FROM e GROUP BY event_id""")
def confidence(spark, sf):
    """Of an event, by its sources and the weight of the best of them."""
    s = table(spark, sf, "sources")
    named = s.select(F.explode(F.concat(F.array("source", "domain"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"), "weight").groupBy(F.lower("name").alias("s")).agg(F.max("weight").alias("weight"))
    e = table(spark, sf, "edition_items").select("event_id", F.lower("source").alias("s")).join(named, "s", "left")
    g = e.groupBy("event_id").agg(F.count_distinct("s").alias("n_groups"), F.max(F.coalesce("weight", F.lit(10))).alias("weight"))
    return g.select("event_id", "n_groups", scoring.confidence(F.col("n_groups"), F.col("weight")).alias("level"))
