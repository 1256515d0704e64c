"""Reports: what is published of an item, its key facts, the brief, and the rules that a report must keep."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidewire.config import CATEGORIES
from tidewire.functions import text
from tidewire.functions.similarity import close

CLAUSE = r"(?<=[。！？.!?])\s+|[；;]\s*|,\s+|\s+(?i:and|while|whereas|after|but)\s+"


def normal(x: str) -> str:
    return re.sub(r"[^a-z0-9一-鿿]+", "", x.lower())


def distinct_clauses(clauses: list[str], summary: str, most: int = 3) -> list[str]:
    """Clauses that say something else than the summary and each other, at most ``most``."""
    told, taken = normal(summary or ""), []
    for c in clauses:
        own = normal(c)
        if len(taken) < most and own and own != told and not (told and close(own, told, 0.9)) and not any(SequenceMatcher(None, own, normal(t)).ratio() >= 0.86 for t in taken):
            taken.append(c)
    return taken


@F.pandas_udf(ArrayType(StringType()))
def _chosen(clauses: pd.Series, summary: pd.Series) -> pd.Series:
    return pd.Series([distinct_clauses(list(c), s) if c is not None and len(c) else [] for c, s in zip(clauses, summary)])


def key_facts(description: Column, summary: Column) -> Column:
    """Up to three clauses of a description (its first 700 characters, clauses of twelve and more) that are not the summary again. The greedy choice alone is Python."""
    parts = F.transform(F.split(text.clip(description, 700), CLAUSE), lambda c: F.regexp_replace(text.clip(text.squeeze(c), 140), r"^[ ,.;，。；]+|[ ,.;，。；]+$", ""))
    return _chosen(F.filter(parts, lambda c: F.length(c) >= 12), summary)


def summary_of(title: Column, source: Column, description: Column) -> Column:
    """The description's first 180 characters, or where there is none a sentence that says so."""
    return F.when(description != "", text.clip(description, 180)).otherwise(F.concat(F.lit("据"), source, F.lit("公开信息，"), title, F.lit("。现有元数据有限，详情应以原始报道为准。")))


def published(scored: DataFrame) -> DataFrame:
    """Scored articles in the shape in which items are published."""
    summary = summary_of(F.col("title"), F.col("source"), F.col("description"))
    return scored.select(
        "row", F.col("title"), F.col("title").alias("original_title"), summary.alias("summary"), key_facts(F.col("description"), summary).alias("key_facts"), F.col("best.name").alias("category"), "source", "domain", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), "url",
        F.greatest(F.lit(0), F.least(F.lit(100), F.col("raw_score"))).alias("score"), F.col("parts").alias("score_parts"), F.col("reasons").alias("score_reasons"), "tags", "corroboration", "supplemental",
    )


def published_papers(scored: DataFrame) -> DataFrame:
    """Scored papers in the shape in which they are published; here the score is rounded."""
    summary = text.clip(F.coalesce("abstract", F.lit("")), 360)
    return scored.select("paper_row", F.col("id"), "title", summary.alias("summary"), F.col("area").alias("research_area"), F.col("keywords").alias("collection_keywords"), "tags", "authors", "url", "pdf_url", F.bround("paper_score").cast("int").alias("score"), F.lit("paper").alias("content_type"))


def brief(items: DataFrame) -> DataFrame:
    """``items``: edition_date, category, source, score, title, place. One row an edition: items, sources, the three strongest categories, the first title."""
    cats = items.groupBy("edition_date", "category").agg(F.count("*").alias("n"))
    top = cats.groupBy("edition_date").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "category"))).alias("x"))  # a report has few categories
    one = items.groupBy("edition_date").agg(F.count("*").alias("n_items"), F.count_distinct("source").alias("n_sources"), F.min_by("title", "place").alias("headline"))
    return one.join(top, "edition_date").select("edition_date", "n_items", "n_sources", "headline", F.array_join(F.transform(F.slice("x", 1, 3), lambda c: c["category"]), "、").alias("leading"))


def report_violations(items: DataFrame, expected: int = 10) -> DataFrame:
    """``items``: edition_date, id, title, summary, category, url, event_id, source, key_facts. Rules that an edition breaks, with how often; none means it is valid. One pass and one shuffle."""
    same = F.exists(F.coalesce("key_facts", F.array().cast("array<string>")), lambda f: text.normalized_title(f) == text.normalized_title(F.coalesce("summary", F.lit(""))))
    blank = lambda c: F.coalesce(text.squeeze(F.col(c)) == "", F.lit(True))
    rules = {
        "wrong number of items": F.when(F.count("*") != expected, 1).otherwise(0), "repeated id": F.count("id") - F.count_distinct("id"), "missing id": F.count_if(blank("id")), "missing title": F.count_if(blank("title")), "missing source": F.count_if(blank("source")),
        "unknown category": F.count_if(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))), "unusable address": F.count_if(~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False))), "unusable event": F.count_if(~F.coalesce(F.col("event_id").rlike("^evt?-[0-9a-f]{12}$"), F.lit(False))), "summary repeated as a fact": F.count_if(same),
    }
    counts = items.groupBy("edition_date").agg(*(c.cast("long").alias(n) for n, c in rules.items()))
    return counts.unpivot(["edition_date"], list(rules), "rule", "n").where("n > 0")


def stream_violations(items: DataFrame, said: Column) -> DataFrame:
    """``items``: id, rank, content_type. Rules that a stream breaks; ``said`` is the number of items that it states."""
    n = F.count("*")
    rules = {"no items": F.when(n == 0, 1).otherwise(0), "stated number differs": F.when(n != said, 1).otherwise(0), "missing id": F.count_if(F.coalesce(F.trim("id") == "", F.lit(True))), "repeated id": F.count("id") - F.count_distinct("id"), "no news": F.count_if(F.col("content_type") != "news"), "ranks with gaps": F.when(F.coalesce(F.max("rank"), F.lit(0)) != n, 1).otherwise(0)}
    return items.agg(*(c.cast("long").alias(r) for r, c in rules.items())).unpivot([], list(rules), "rule", "n").where("n > 0")


def needs_run(status: Column, today: Column, forced: Column, required: int = 0, expected: int = 10) -> Column:
    """``status``: a struct of state, edition_date, n_items, schema_version (or null). Whether to run, and why."""
    healthy = F.coalesce((status["state"] == "ok") & (status["edition_date"] == today) & (status["n_items"] == expected), F.lit(False))
    old = F.coalesce(status["schema_version"], F.lit(0)) < required
    out = lambda run, why: F.struct(F.lit(run).alias("run"), F.lit(why).alias("reason"))
    return F.when(forced, out(True, "manual_force_refresh")).when(healthy & old & F.lit(required > 0), out(True, "schema_upgrade_required")).when(healthy, out(False, "healthy_edition_exists")).otherwise(out(True, "edition_missing_or_unhealthy"))


def health(n_items: Column, age_hours: Column, failed: Column, late: Column, partial: Column, supplemented: Column, expected: int = 10, most_hours: int = 36) -> Column:
    """What a reader is told of an edition; the first that applies."""
    return F.when(failed, "failed").when(late, "missing today").when(age_hours > most_hours, "stale").when(n_items != expected, "wrong number").when(partial, "partly translated").when(supplemented, "supplemented").otherwise("ok")
