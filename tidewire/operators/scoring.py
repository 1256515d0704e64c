"""Classification and scores as column expressions; roundings are half-even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.config import CATEGORIES, COLLECTION_KEYWORDS, EXCLUDE, FEED_WEIGHTS, HOST_WEIGHTS, IMPACT, LIMITS, OTHER_AREA, OTHER_PRIORITY, OTHER_WEIGHT, PAPER_AREAS, PENALTY, PUBLIC_BODY_WEIGHT
from tidewire.functions import lexicon, text, web

TOPICS = tuple(dict.fromkeys(w for _, words in CATEGORIES.values() for w in words))
WORDS = (*TOPICS, *IMPACT, *PENALTY, *EXCLUDE)


def category_key(c: Column) -> Column:
    return F.lower(text.strip(F.coalesce(c, F.lit(""))))


def prepared(articles: DataFrame, now: Column, hours: int = LIMITS.lookback_hours) -> DataFrame:
    """Articles as collected: clean title and description, canonical address, host, and a date; one without a usable date
    stands at the window's edge and is marked. Rows without a title go."""
    raw = articles.withColumns({"title": text.clean_text(F.col("title"), 300), "description": text.clean_text(F.col("description"), 900), "url": web.canonical_url(F.col("url"))})
    host = F.regexp_replace(F.lower(text.strip(F.coalesce("domain", F.lit("")))), r"^www\.", "")
    ts = F.col("published_at").cast("timestamp")
    return raw.where("title != ''").withColumns({
        "domain": F.when(host != "", host).otherwise(web.domain(F.col("url"))), "source": text.squeeze(F.coalesce("source", F.lit(""))),
        "ts": F.coalesce(ts, now - F.make_interval(hours=F.lit(hours))), "estimated": ts.isNull(),
    })


def body_of(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns)))


def classified(df: DataFrame, body: Column, default: Column) -> DataFrame:
    """Adds ``hits`` (all words of the lexicon that occur), ``any_hits`` (how many tell a topic) and ``best`` (the winning
    category with points, priority and up to three tags): three points a hit, two for the default, ties by precedence."""
    df = df.withColumn("hits", lexicon.occurring(body, WORDS))
    each = []
    for i, (n, (priority, words)) in enumerate(CATEGORIES.items()):
        own = lexicon.among(F.col("hits"), words)
        each.append(F.struct((F.lit(3) * F.size(own) + F.when(category_key(default) == n.lower(), 2).otherwise(0)).alias("points"), F.lit(-i).alias("order"), F.lit(n).alias("name"), F.lit(priority).alias("priority"), own.alias("words")))
    # The array's greatest element has the most points and, of those, comes first.
    df = df.withColumn("best", F.array_max(F.array(*each)))
    ranked = F.array_sort(F.transform("best.words", lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return df.withColumns({"tags": F.transform(F.slice(ranked, 1, 3), lambda x: x["w"]), "any_hits": F.size(lexicon.among(F.col("hits"), TOPICS))})


def excluded(hits: Column) -> Column:
    return F.arrays_overlap(hits, F.array(*map(F.lit, EXCLUDE)))


def in_window(ts: Column, now: Column, hours: int = LIMITS.lookback_hours) -> Column:
    """From ``hours`` before ``now`` to two hours after it, both ends included."""
    return ts.between(now - F.make_interval(hours=F.lit(hours)), now + F.make_interval(hours=F.lit(LIMITS.future_hours)))


def weight_tables(spark) -> tuple[DataFrame, DataFrame]:
    """The configured weights: hosts with their order, and feeds by name."""
    hosts = spark.createDataFrame([(i, h, w) for i, (h, w) in enumerate(HOST_WEIGHTS)], "place int, host string, weight int")
    return hosts, spark.createDataFrame(list(FEED_WEIGHTS), "name string, weight int")


def weighted_outlets(outlets: DataFrame, hosts: DataFrame, names: DataFrame) -> DataFrame:
    """``outlets``: domain, source. Adds ``weight``: of the first host in order that the domain is or lies under, else of
    the name, else 18 for public bodies and 10 for all others. The domain's suffixes make it an equality join."""
    each = outlets.select("domain").distinct()
    parts = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    by_host = each.withColumn("host", F.explode(suffixes)).join(hosts, "host").groupBy("domain").agg(F.min_by("weight", "place").alias("by_host"))
    by_name = names.groupBy(F.col("name").alias("source")).agg(F.max("weight").alias("by_name"))
    public = F.when(F.col("domain").rlike(r"\.(?:gov|mil)$"), PUBLIC_BODY_WEIGHT).otherwise(OTHER_WEIGHT)
    return outlets.join(by_host, "domain", "left").join(by_name, "source", "left").withColumn("weight", F.coalesce("by_host", "by_name", public).cast("int")).drop("by_host", "by_name")


def scored(df: DataFrame, now: Column, hours: int = LIMITS.lookback_hours) -> DataFrame:
    """``df``: prepared rows with weight and corroboration. The rows of the window that hit a topic and are no paid
    content, with ``best``, ``tags``, ``parts`` (the score's terms), ``raw_score`` (0 to 100) and ``reasons``."""
    df = classified(df.where(in_window(F.col("ts"), now, hours)).withColumn("body", body_of("title", "description")), F.col("body"), F.col("category"))
    df = df.where((F.col("any_hits") > 0) & ~excluded(F.col("hits")))
    weights = F.create_map(*(F.lit(x) for pair in IMPACT.items() for x in pair))
    df = df.withColumns({"age": F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("ts")) / F.lit(3.6e9)), "impact": lexicon.among(F.col("hits"), tuple(IMPACT))})
    late = F.col("age") > LIMITS.lookback_hours
    parts = {
        "source": F.col("weight"), "priority": F.col("best.priority"),
        "recency": F.bround(F.greatest(F.lit(0.0), F.lit(20.0) - F.lit(0.5) * F.col("age"))).cast("int"),
        "impact": F.least(F.lit(22), F.aggregate("impact", F.lit(0), lambda a, w: a + weights[w])),
        "relevance": F.least(F.lit(12), F.lit(2) * F.col("any_hits")),
        "evidence": F.when(F.length("description") >= 80, 3).otherwise(2),
        "corroboration": F.least(F.lit(12), F.lit(4) * F.greatest(F.lit(0), F.col("corroboration") - 1)),
        "penalty": -F.least(F.lit(24), F.lit(12) * F.size(lexicon.among(F.col("hits"), PENALTY))),
        "date_penalty": F.when(F.col("estimated"), -7).otherwise(0),
        "late_penalty": F.when(late, -F.least(F.lit(18), F.lit(4) + F.lit(3) * F.floor((F.col("age") - LIMITS.lookback_hours) / 12).cast("int"))).otherwise(0),
    }
    df = df.withColumn("parts", F.struct(*(c.cast("int").alias(n) for n, c in parts.items())))
    total = sum((F.col(f"parts.{n}") for n in parts), F.lit(15))
    df = df.withColumns({"raw_score": F.greatest(F.lit(0), F.least(F.lit(100), total)), "supplemental": late})
    return df.withColumn("reasons", reasons(hours))


def reasons(hours: int) -> Column:
    """Why a row has its score, in words; only what applies."""
    p = lambda n: F.col(f"parts.{n}")
    said = lambda *x: F.concat(*(y.cast("string") if isinstance(y, Column) else F.lit(y) for y in x))
    return F.array_compact(F.array(
        said("来源权重 ", p("source"), "/20"), said("发布约 ", F.format_string("%.1f", F.bround("age", 1)), " 小时"), said("命中 ", F.col("any_hits"), " 个主题信号"),
        F.when(F.size("impact") > 0, said("影响信号：", F.array_join(F.slice("impact", 1, 3), "、"))),
        F.when(F.col("corroboration") > 1, said(F.col("corroboration"), " 个独立来源相互印证")),
        F.when(p("penalty") < 0, said("编辑质量降权 ", p("penalty"))),
        F.when(F.col("estimated"), F.lit(f"发布时间无法解析，按 {hours} 小时窗口边缘处理并降权")),
        F.when(F.col("supplemental"), said("超过 24 小时，作为补充观察并降权 ", p("late_penalty"))),
    ))


def area_of(categories: Column, areas: tuple[tuple[str, str, int], ...] = PAPER_AREAS) -> Column:
    """Area and priority of the first defined category among a paper's."""
    out = F.struct(F.lit(OTHER_AREA).alias("area"), F.lit(OTHER_PRIORITY).alias("priority"))
    for name, area, priority in reversed(areas):
        has = F.exists(categories, lambda c: c.startswith("astro-ph.") | (c == name)) if name == "astro-ph" else F.array_contains(categories, name)
        out = F.when(has, F.struct(F.lit(area).alias("area"), F.lit(priority).alias("priority"))).otherwise(out)
    return out


def scored_papers(papers: DataFrame, now: Column, areas: tuple[tuple[str, str, int], ...] = PAPER_AREAS) -> DataFrame:
    """``papers``: title, abstract, published_at, updated_at (timestamps), categories, primary_category, research_area, collection_keywords.

    Adds area, keywords (with those that match), tags and paper_score (not rounded before it is published).
    """
    return fresh_papers(paper_terms(papers, areas), now)


def fresh_papers(terms: DataFrame, now: Column) -> DataFrame:
    """What ``paper_terms`` gives, with paper_score at a moment."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(F.greatest("published_at", "updated_at"))) / F.lit(8.64e10))
    score = F.col("base") + F.greatest(F.lit(0.0), F.lit(28.0) - age * 4) + F.col("topical")
    return terms.withColumn("paper_score", F.least(F.lit(100.0), score.cast("double"))).drop("base", "topical")


def paper_terms(papers: DataFrame, areas: tuple[tuple[str, str, int], ...] = PAPER_AREAS) -> DataFrame:
    """What a paper's text and categories bring to its score, at any time."""
    none = F.array().cast("array<string>")
    some = lambda c: F.when(text.squeeze(F.coalesce(c, F.lit(""))) != "", text.squeeze(c))
    own = F.filter(F.coalesce("categories", none), lambda c: text.squeeze(c) != "")
    aliases = tuple(a for _, _, words in COLLECTION_KEYWORDS for a in words)
    df = papers.withColumn("hits", lexicon.occurring(body_of("title", "abstract"), (*TOPICS, *aliases)))
    df = df.withColumn("found", area_of(F.when(F.size(own) > 0, own).otherwise(F.array(F.coalesce("primary_category", F.lit("")))), areas))
    met = [(F.lit(label), F.arrays_overlap("hits", F.array(*map(F.lit, words))), max(2, priority - 5)) for label, priority, words in COLLECTION_KEYWORDS]
    labels = F.array_compact(F.array(*(F.when(hit, label) for label, hit, _ in met)))
    df = df.withColumn("keywords", F.slice(F.array_distinct(F.concat(F.coalesce("collection_keywords", none), labels)), 1, 20))
    area = F.coalesce(some(F.col("research_area")), F.col("found.area"))
    df = df.withColumn("area", F.when((area == OTHER_AREA) & (F.size("keywords") > 0), F.get("keywords", F.lit(0))).otherwise(area))
    topics = lexicon.among(F.col("hits"), TOPICS)
    boost = F.least(F.lit(18), sum((F.when(hit, points).otherwise(0) for _, hit, points in met), F.lit(0)))
    n = F.length(F.coalesce("abstract", F.lit("")))
    topical = F.least(F.lit(14), F.lit(2) * F.size(topics)) + boost + F.when(n >= 500, 8).when(n >= 180, 5).otherwise(2)
    by_length = F.transform(F.array_sort(F.transform(topics, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), lambda x: x["w"])
    tags = F.array_distinct(F.filter(F.concat(F.array("area"), "keywords", F.array(F.coalesce("primary_category", F.lit(""))), by_length), lambda t: t.isNotNull() & (t != "")))
    return df.withColumns({"base": F.lit(35) + F.lit(2) * F.col("found.priority"), "topical": topical, "tags": F.slice(tags, 1, 5), "n_topics": F.size(topics)}).drop("hits", "found")


def in_paper_window(published: Column, updated: Column, now: Column, days: int = LIMITS.paper_days) -> Column:
    return (F.greatest(published, updated) >= now - F.make_interval(days=F.lit(days))) & (published <= now + F.make_interval(hours=F.lit(LIMITS.future_hours)))


def confidence(n_groups: Column, weight: Column) -> Column:
    return F.when((n_groups >= 3) | ((n_groups >= 2) & (weight >= 17)), "高").when((n_groups >= 2) | (weight >= 16), "中").otherwise("待核验")


def fused(model: Column, rule: Column, weight: str = str(LIMITS.model_weight)) -> Column:
    """A model's score mixed into the rule's; rows that no model scored keep the rule's. Decimal weights keep halves halves."""
    w = F.lit(weight).cast("decimal(3,2)")
    mixed = F.bround(w * model.cast("int") + (F.lit(1).cast("decimal(3,2)") - w) * rule.cast("int")).cast("int")
    return F.when(model.isNotNull(), mixed).otherwise(rule)
