"""Tables, shards, an index, feeds, a digest and run records out."""

from __future__ import annotations

import json
import uuid
from html import escape as html
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text

SEARCHED = ("id", "event_id", "title", "summary", "category", "source", "country", "published_at", "url", "score", "confidence", "tags", "corroboration", "original_title", "key_facts", "related_count")


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """A small document, whole or not at all: written beside its place and renamed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    temp = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    out.write(bytearray(body.encode()))
    out.close()
    if fs.exists(place):
        fs.delete(place, False)
    fs.rename(temp, place)


def read_text(spark: SparkSession, path: str, fallback: object) -> object:
    """A small JSON document, or the fallback where there is none that can be read."""
    try:
        return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    except Exception:  # noqa: BLE001  (missing, unreadable or no JSON: the fallback is the answer to all)
        return fallback


def write_editions(items: DataFrame, path: str) -> None:
    """Each edition replaces its own partition and leaves the others alone."""
    items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("edition_date").parquet(path)


def retained_editions(editions: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` editions (a number of editions, not of days)."""
    return editions.orderBy(F.desc("edition_date")).limit(n)


def edition_index(items: DataFrame, editions: DataFrame, n: int) -> DataFrame:
    """The archive's index: the newest ``n`` editions with their counts, newest first by ``place``."""
    from pyspark.sql import Window as W

    kept = retained_editions(editions, n)
    counts = items.join(kept.select("edition_date"), "edition_date", "left_semi").groupBy("edition_date").agg(F.count("*").alias("n_items"), F.count_distinct("source").alias("n_sources"))
    place = F.row_number().over(W.orderBy(F.desc("edition_date")))  # at most ``n`` rows
    return kept.join(counts, "edition_date", "left").select("edition_date", "headline", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), place.alias("place"))


def compact(items: DataFrame) -> DataFrame:
    """The searched fields of an item, its edition and that it is compact; fields a table lacks are null."""
    return items.select(*(F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in SEARCHED), "edition_date", F.lit(True).alias("compact"))


def write_shards(items: DataFrame, path: str, kept: DataFrame | None = None) -> None:
    """The searched fields by month, so that a search over a span reads its months only.

    Months that are written replace what was there; with ``kept`` (edition_date) rows of other editions are left out, and
    months that have none left are removed.
    """
    spark = items.sparkSession
    df = compact(items if kept is None else items.join(kept.select("edition_date").distinct(), "edition_date", "left_semi")).withColumn("month", F.date_format("edition_date", "yyyy-MM"))
    df.repartition("month", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    if kept is None:
        return
    months = {r["m"] for r in kept.select(F.date_format("edition_date", "yyyy-MM").alias("m")).distinct().toArrow().to_pylist()}  # one a month
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(place):
        name = s.getPath().getName()
        if name.startswith("month=") and name.removeprefix("month=") not in months:
            fs.delete(s.getPath(), True)


def replaced(archive: DataFrame, edition: DataFrame) -> DataFrame:
    """The archive with one edition's rows in place of those of its date."""
    return archive.join(edition.select("edition_date").distinct(), "edition_date", "left_anti").unionByName(edition)


def _top(items: DataFrame, n: int) -> list[dict]:
    columns = ("id", "title", "summary", "url", "category", "source", "score", "key_facts")
    have = [F.col(c) if c in items.columns else F.lit(None).alias(c) for c in columns]
    at = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")
    return items.orderBy(F.desc("score"), F.desc("published_at"), "id").limit(n).select(*have, at, F.col("edition_date").cast("string").alias("day")).toArrow().to_pylist()


def atom_feed(items: DataFrame, title: str, site: str, n: int = 10) -> str:
    """An Atom document of at most ``n`` items, summary and key facts together."""
    quote = lambda x: escape(x, {'"': "&quot;"})
    parts = []
    for r in _top(items, n):
        facts = " ".join(f"• {f}" for f in r["key_facts"] or [])
        said = " ".join(x for x in (r["summary"] or "", facts) if x)
        parts.append(f'<entry><id>urn:item:{escape(r["day"] or "")}:{escape(r["id"] or "")}</id><title>{escape(r["title"] or "")}</title><updated>{r["at"] or ""}</updated><link href="{quote(r["url"] or site)}"/><summary>{escape(said)}</summary></entry>')
    return f'<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>{escape(title)}</title><id>{escape(site)}</id>{"".join(parts)}</feed>'


def recipients(raw: str) -> list[str]:
    """Addresses between semicolons or line ends, each once, in order."""
    return list(dict.fromkeys(p for p in (x.strip() for x in raw.replace("\n", ";").split(";")) if p))


def safe_url(url: Column) -> Column:
    """Web addresses with a host only, else empty."""
    plain = text.strip(F.coalesce(url, F.lit("")))
    return F.when(plain.rlike(r"(?i)^https?://[^/\s]+"), plain).otherwise("")


def digest(items: DataFrame, headline: str, site: str, n: int = 10) -> tuple[str, str]:
    """A report as plain text and as HTML, everything escaped; it must have exactly ``n`` items."""
    rows = _top(items, n)
    if len(rows) != n:
        raise ValueError(f"a digest needs {n} items, there are {len(rows)}")
    plain = [headline, ""] + [f"{i}. [{r['category'] or ''}] {r['title'] or ''}\n{r['summary'] or ''}\n{r['url'] or site}" for i, r in enumerate(rows, 1)]
    cells = "".join(f'<li><a href="{html(r["url"] or site)}">{html(r["title"] or "")}</a><p>{html(r["summary"] or "")}</p><small>{html(r["source"] or "")}</small></li>' for r in rows)
    return "\n".join(plain), f"<h1>{html(headline)}</h1><ol>{cells}</ol>"


def run_status(log: DataFrame) -> DataFrame:
    """``log``: at, state, and what a run reports (null where it failed before). The newest run, with the last known value of everything it does not report."""
    kept = [c for c in log.columns if c not in ("at", "state")]
    known = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in kept]
    return log.agg(F.max("at").alias("at"), F.max_by("state", "at").alias("state"), F.max(F.when(F.col("state") == "ok", F.col("at"))).alias("last_success"), *known)


def export_view(rows: DataFrame, path: str, **view: object) -> None:
    """The rows of a view as JSON lines, each with the view's query."""
    rows.withColumn("view", F.lit(json.dumps(view, ensure_ascii=False, sort_keys=True))).write.mode("overwrite").json(path)
