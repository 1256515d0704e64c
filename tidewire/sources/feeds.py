"""RSS, Atom and preprint feeds that have been landed as files, one file a document.

Python only takes the documents apart, into the elements of each entry in document order; which element means what is
decided by column expressions.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import dates, text, web

ENTRIES = 50
ATTRIBUTES = ("href", "rel", "url", "medium", "type", "term")
_PART = ["direct boolean", "tag string", "text string", *(f"{a} string" for a in ATTRIBUTES)]
SCHEMA = f"feed string, entry_no int, parts array<struct<{', '.join(c.replace(' ', ':') for c in _PART)}>>"
_PARTS = pa.list_(pa.struct([(c.split()[0], pa.bool_() if c.endswith("boolean") else pa.string()) for c in _PART]))


def entries(document: bytes) -> list[list[dict]]:
    """The elements of a feed's first entries; an unreadable document has none. Names lose their namespace and case."""
    try:
        root = ET.fromstring(document)
    except ET.ParseError:
        return []
    found = [e for path in ("item", "entry") for e in root.iterfind(f".//{{*}}{path}")][:ENTRIES]
    out = []
    for entry in found:
        own = set(map(id, entry))
        parts = []
        for e in entry.iterfind(".//*"):
            of = {a: e.get(a) for a in ATTRIBUTES}
            parts.append({"direct": id(e) in own, "tag": str(e.tag).rpartition("}")[2].lower(), "text": "".join(e.itertext()).strip()} | of)
        out.append(parts)
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(path.rsplit("/", 1)[-1], i, parts) for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, parts in enumerate(entries(content))]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], _PARTS)], ["feed", "entry_no", "parts"])


def first_of(*tags: str) -> Column:
    """The text of the first direct element with one of the names."""
    return F.get(F.filter("parts", lambda p: p["direct"] & p["tag"].isin(*tags)), F.lit(0))["text"]


def link() -> Column:
    """An alternate link's address or a link's text, whichever comes first, else the entry's identifier."""
    address = F.transform(F.filter("parts", lambda p: p["direct"] & (p["tag"] == "link")), lambda p: F.when(p["href"].isNotNull() & F.coalesce(p["rel"], F.lit("alternate")).isin("alternate", ""), p["href"]).when(p["text"] != "", p["text"]))
    return F.coalesce(F.get(F.array_compact(address), F.lit(0)), first_of("guid", "id"))


def image() -> Column:
    """The address of a thumbnail, or of content or an enclosure that says it is an image."""
    shown = lambda p: (p["tag"] == "thumbnail") | (p["tag"].isin("content", "enclosure") & ((p["medium"] == "image") | p["type"].startswith("image/")))
    return F.get(F.filter("parts", lambda p: p["url"].isNotNull() & F.coalesce(shown(p), F.lit(False))), F.lit(0))["url"]


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(_parse, SCHEMA)


def read_feeds(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Entries of all feed files under ``path``: cleaned, with a date (a day before ``now`` where none is usable); only those with a title and a web address."""
    ts, url, title = dates.parse(first_of("pubdate", "published", "updated", "date")), link(), text.clean_text(first_of("title"), 300)
    return read_parts(spark, path).where(url.rlike("^https?://") & (title != "")).select(
        "feed", "entry_no", title.alias("title"), text.clean_text(first_of("description", "summary", "content", "encoded"), 900).alias("description"),
        web.canonical_url(url).alias("url"), web.domain(url).alias("domain"), web.article_id(url, title).alias("id"), image().alias("image"),
        F.coalesce(ts, now - F.expr("INTERVAL 24 HOURS")).alias("published_at"), ts.isNull().alias("date_estimated"),
    )


def read_preprints(spark: SparkSession, path: str, now: Column, days: int = 7) -> DataFrame:
    """Preprints of landed Atom documents: one row a preprint whatever its version (the first), its categories and at most
    20 authors, only of the last ``days`` by publication or update."""
    all_of = lambda tag, value: F.array_distinct(F.filter(F.transform(F.filter("parts", lambda p: p["tag"] == tag), lambda p: p[value]), lambda t: t.isNotNull() & (t != "")))
    number = F.regexp_replace(F.regexp_extract(first_of("id"), r"([^/]+)$", 1), r"v\d+$", "")
    pub, upd = dates.parse(first_of("published")), dates.parse(first_of("updated"))
    rows = read_parts(spark, path).select(
        number.alias("id"), text.clean_text(first_of("title"), 400).alias("title"), text.clean_text(first_of("summary"), 4000).alias("abstract"), pub.alias("published_at"), F.coalesce(upd, pub).alias("updated_at"),
        F.slice(all_of("name", "text"), 1, 20).alias("authors"), all_of("category", "term").alias("categories"), F.struct("feed", "entry_no").alias("ord"),
    ).where("id != '' AND title != ''")
    recent = rows.where((F.greatest("published_at", "updated_at") >= now - F.make_interval(days=F.lit(days))) & (F.col("published_at") <= now + F.expr("INTERVAL 2 HOURS")))
    one = recent.groupBy("id").agg(F.min_by(F.struct(*(c for c in rows.columns if c not in ("id", "ord"))), "ord").alias("x"))
    return one.select("id", "x.*")


def preprint_query(term: str) -> str:
    """A literal search for a term in titles and abstracts; several words are quoted."""
    plain = " ".join(term[:120].replace('"', " ").split())
    quoted = f'"{plain}"' if " " in plain else plain
    return f"(ti:{quoted} OR abs:{quoted})" if plain else ""


def latest_versions(papers: DataFrame) -> DataFrame:
    """One row for each preprint, whatever its version suffix: the row that comes first."""
    base = F.regexp_replace("id", r"v\d+$", "")
    return papers.withColumn("base_id", base).groupBy("base_id").agg(F.min_by(F.struct(*papers.columns), "paper_row").alias("x")).select("x.*")
