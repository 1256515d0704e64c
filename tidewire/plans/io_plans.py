"""Readers, writers and streams, run over the project's tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.plans import sqltext as S
from tidewire.plans.registry import query, table
from tidewire.shared import scratch_path
from tidewire.sources import feeds, sinks
from tidewire.streaming import windows


@query("src_month_shards", "SELECT strftime(edition_date, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT id) AS BIGINT) AS n_ids FROM edition_items WHERE edition_date >= DATE '2026-07-01' GROUP BY 1")
def month_shards(spark, sf):
    """Shards written by month and read again; a filter on the month prunes directories."""
    path = scratch_path(spark, "shards")
    sinks.write_shards(table(spark, sf, "edition_items"), path)
    return spark.read.parquet(path).where("month >= '2026-07'").groupBy("month").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


@query("src_replaced_edition", """
SELECT CAST(edition_date AS VARCHAR) AS edition_date, CAST(count(*) AS BIGINT) AS n FROM edition_items WHERE edition_date < (SELECT max(edition_date) FROM editions) OR score >= 50 GROUP BY 1""")
def replaced_edition(spark, sf):
    """All editions written, then the last one written again with its better items only: the others stay."""
    path = scratch_path(spark, "editions")
    e = table(spark, sf, "edition_items").select("item_row", "score", "edition_date")
    sinks.write_editions(e, path)
    last = table(spark, sf, "editions").agg(F.max("edition_date").alias("last"))
    sinks.write_editions(e.join(F.broadcast(last)).where("edition_date = last AND score >= 50").drop("last"), path)
    return spark.read.parquet(path).groupBy(F.col("edition_date").cast("string").alias("edition_date")).agg(F.count("*").alias("n"))


@query("src_latest_papers", r"SELECT paper_row FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(id, 'v\d+$', '') ORDER BY paper_row) AS n FROM papers) WHERE n = 1")
def latest_papers(spark, sf):
    return feeds.latest_versions(table(spark, sf, "papers")).select("paper_row")


@query("stream_hourly_counts", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_s, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def hourly_counts(spark, sf):
    out = windows.run_updates(windows.hourly_counts(windows.read_stream(spark, sf, "events.parquet"), "ts", "event_type"), "hour", "event_type")
    return out.select(F.unix_seconds("hour").alias("hour_s"), "event_type", "n")


@query("stream_dedup", f"SELECT CAST(count(DISTINCT {S.canonical_url('url')}) AS BIGINT) AS n_urls FROM edition_items WHERE published_at IS NOT NULL")
def dedup(spark, sf):
    """Addresses first seen in the stream. A row later than the watermark is dropped; the table is one micro-batch, in which nothing is late."""
    s = windows.read_stream(spark, sf, "edition_items.parquet").where("published_at IS NOT NULL")
    out = windows.run_once(windows.deduplicated(s, "published_at", "url").select("canonical"))
    return out.agg(F.count("*").alias("n_urls"))
