"""Cleaning, identifiers, tokens, dates and provenance over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.config import DENIAL_MARKERS
from tidewire.functions import dates, text, web
from tidewire.plans import sqltext as S
from tidewire.plans.registry import query, table


@query("fn_clean_text", f"SELECT article_row, {S.clip(S.clean('title'), 300)} AS clean_title, {S.clip(S.clean('description'), 200)} AS clean_description FROM articles")
def clean_text(spark, sf):
    a = table(spark, sf, "articles")
    return a.select("article_row", text.clean_text(F.col("title"), 300).alias("clean_title"), text.clean_text(F.col("description"), 200).alias("clean_description"))


_PARSED = """coalesce(
  try_strptime(x, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(x, '%Y%m%dT%H%M%SZ'), try_strptime(x, '%Y-%m-%d %H:%M:%S'),
  try_strptime(regexp_replace(x, '^[A-Za-z]+, *', ''), '%d %b %Y %H:%M:%S +0000'),
  CASE WHEN regexp_full_match(x, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}[+-]\\d{2}:\\d{2}') THEN CAST(CAST(x AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) END)"""


@query("fn_parse_dates", f"""
SELECT article_row, CAST(epoch({_PARSED}) AS BIGINT) AS epoch_s, {_PARSED} IS NULL AS estimated
FROM (SELECT article_row, regexp_replace(published_raw, '^{S.SPACE}+|{S.SPACE}+$', '', 'g') AS x FROM articles)""")
def parse_dates(spark, sf):
    ts = dates.parse(F.col("published_raw"))
    return table(spark, sf, "articles").select("article_row", F.unix_seconds(ts).alias("epoch_s"), ts.isNull().alias("estimated"))


@query("fn_canonical_urls", f"SELECT item_row, {S.canonical_url('url')} AS canonical, {S.domain('url')} AS host FROM edition_items")
def canonical_urls(spark, sf):
    return table(spark, sf, "edition_items").select("item_row", web.canonical_url(F.col("url")).alias("canonical"), web.domain(F.col("url")).alias("host"))


@query("fn_article_ids", f"""
SELECT item_row, left(sha1(CASE WHEN c <> '' THEN c ELSE lower(coalesce(title, '')) END), 14) AS own_id
FROM (SELECT item_row, title, {S.canonical_url('url')} AS c FROM edition_items)""")
def article_ids(spark, sf):
    return table(spark, sf, "edition_items").select("item_row", web.article_id(F.col("url"), F.col("title")).alias("own_id"))


@query("fn_event_ids", f"""
SELECT item_row, 'evt-' || left(sha1(CASE WHEN t = '' THEN 'unknown-event' ELSE t END), 12) AS own_event
FROM (SELECT item_row, lower({S.clean('title')}) AS t FROM edition_items)""")
def event_ids(spark, sf):
    return table(spark, sf, "edition_items").select("item_row", web.event_id(text.clean_text(F.col("title"))).alias("own_event"))


@query("fn_title_tokens", f"""
SELECT item_row, {S.norm_title("coalesce(title, '')")} AS normalized, array_to_string({S.title_tokens("coalesce(title, '')")}, ' ') AS tokens,
  array_to_string({S.acronyms("coalesce(title, '')")}, ' ') AS acronyms FROM edition_items""")
def title_tokens(spark, sf):
    t = F.coalesce("title", F.lit(""))
    return table(spark, sf, "edition_items").select(
        "item_row", text.normalized_title(t).alias("normalized"), F.array_join(text.title_tokens(t), " ").alias("tokens"), F.array_join(text.acronyms(t), " ").alias("acronyms")
    )


@query("fn_history_tokens", f"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {S.history_tokens('c')} AS t FROM (SELECT doc_id, {S.clean('text')} AS c FROM documents))""")
def history_tokens(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("c")).select("doc_id", text.history_tokens(F.col("c")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def _wire_sql() -> str:
    d, s, t = "lower(coalesce(domain, ''))", "lower(coalesce(source, ''))", "left(coalesce(description, ''), 500)"
    return f"""CASE WHEN regexp_full_match({d}, '(.*\\.)?reuters\\.com') OR {s} = 'reuters' THEN 'wire:reuters'
      WHEN regexp_full_match({d}, '(.*\\.)?apnews\\.com') OR {s} IN ('ap', 'associated press') THEN 'wire:ap'
      WHEN regexp_matches({t}, '(?i)(^|[\\s(—-])reuters([\\s),.:;—-]|$)') THEN 'wire:reuters'
      WHEN regexp_matches({t}, '(?i)\\bassociated press\\b') OR regexp_matches({t}, '(^|[\\s(—-])AP([\\s),.:;—-]|$)') THEN 'wire:ap' ELSE '' END"""


@query("fn_source_groups", f"""
SELECT article_row, {_wire_sql()} AS wire, CASE WHEN {_wire_sql()} <> '' THEN {_wire_sql()} ELSE 'outlet:' ||
  lower(trim(coalesce(CASE WHEN trim(domain) <> '' THEN domain END, CASE WHEN trim(source) <> '' THEN source END, {S.canonical_url('url')}))) END AS source_group
FROM articles""")
def source_groups(spark, sf):
    d, s, u, x = (F.col(c) for c in ("domain", "source", "url", "description"))
    return table(spark, sf, "articles").select("article_row", web.wire_family(d, s, x).alias("wire"), web.source_group(d, s, u, x).alias("source_group"))


_DENIAL = "|".join(DENIAL_MARKERS)


@query("fn_denial_markers", f"SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '{_DENIAL}') AS denies FROM documents")
def denial_markers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.denial(F.coalesce("text", F.lit(""))).alias("denies"))


@query("fn_edition_dates", "SELECT CAST(edition_date AS VARCHAR) AS edition_date, CAST(CAST(timezone(tz_name, timezone('UTC', generated_at)) AS DATE) AS VARCHAR) AS local_date FROM editions WHERE tz_name IS NOT NULL")
def edition_dates(spark, sf):
    e = table(spark, sf, "editions").where("tz_name IS NOT NULL")
    return e.select(F.col("edition_date").cast("string").alias("edition_date"), dates.edition_date(F.col("generated_at").cast("timestamp"), F.col("tz_name")).cast("string").alias("local_date"))


@query("fn_forecast_due", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CASE WHEN o_orderstatus = 'O' THEN 90 ELSE 30 END AS VARCHAR) AS due_after FROM orders")
def forecast_due(spark, sf):
    o = table(spark, sf, "orders")
    horizon = F.when(F.col("o_orderstatus") == "O", "中期").otherwise("短期")
    return o.select("o_orderkey", dates.due_date(F.to_date("o_orderdate").cast("string"), horizon).cast("string").alias("due_after"))
