"""The read side: filters, facets, marks and lists of a reader."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.config import CATEGORIES

RANGES = (6, 12, 24)
PAGE = 24


def searched(df: DataFrame, columns: tuple[str, ...], arrays: tuple[str, ...] = ()) -> Column:
    """All searched fields of an item as one lower-cased text; fields that the table lacks are left out."""
    plain = [F.coalesce(F.col(c), F.lit("")) for c in columns if c in df.columns]
    listed = [F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ") for c in arrays if c in df.columns]
    return F.lower(F.concat_ws(" ", *plain, *listed))


def view(df: DataFrame, haystack: Column, words: list[str] | None = None, mine: list[str] | None = None, query: str = "", category: str | None = None, source: str | None = None, hours: int | None = None, generated: Column | None = None) -> DataFrame:
    """Rows that pass all of a view's conditions: any of the watchwords, any of the reader's own words, the query, a category, a source, a range of hours before ``generated``."""
    any_of = lambda those: F.exists(F.array(*(F.lit(w.lower()) for w in those)), lambda w: F.contains(haystack, w)) if those else F.lit(False)
    kept = df
    for those in (words, mine):
        kept = kept if those is None else kept.where(any_of(those))
    kept = kept.where(F.contains(haystack, F.lit(query.lower()))) if query else kept
    kept = kept.where(F.col("category") == category) if category else kept
    kept = kept.where(F.col("source") == source) if source else kept
    if hours is not None:
        if hours not in RANGES:
            raise ValueError(f"a range is one of {RANGES} hours")
        kept = kept.where(F.col("published_at") >= generated - F.make_dt_interval(hours=F.lit(hours)))
    return kept


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = PAGE) -> DataFrame:
    """The rows that a reader sees after asking for more ``number - 1`` times."""
    return df.orderBy(*order).limit(number * size)


def facets(df: DataFrame, facet: Column, by_count: bool = False) -> DataFrame:
    """Facets with their counts in the order shown: by count, or the fixed categories first and then the others."""
    g = df.groupBy(facet.alias("facet")).agg(F.count("*").alias("n")).where("facet != ''")
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("facet")).cast("int")
    first = -F.col("n") if by_count else F.when(place > 0, place).otherwise(len(CATEGORIES) + 1)
    return g.withColumn("ord", F.struct(first.cast("long").alias("a"), "facet"))


def terms(query: str, own: tuple[str, ...] = (), most: int = 28) -> list[str]:
    """The words to mark: at most eight of the query and the reader's own, each once without regard to case, the longest first."""
    every = [*query.split()[:8], *(" ".join(w.split()) for w in own)]
    return sorted({w.lower(): w for w in reversed(every) if w}.values(), key=lambda w: (-len(w), [x.lower() for x in every].index(w.lower())))[:most]


def marked(c: Column, words: list[str]) -> Column:
    """The text, made safe for HTML, with every occurrence of the words in marks."""
    safe = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    if not words:
        return safe
    escaped = [w.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;") for w in words]
    return F.regexp_replace(safe, "(?iu)(" + "|".join(re.escape(w) if w.isascii() else w for w in escaped) + ")", "<mark>$1</mark>")


def item_key(stored: Column, day: Column, item: Column) -> Column:
    """A stored key, else the edition and the id."""
    return F.coalesce(F.when(stored != "", stored), F.concat(F.coalesce(day.cast("string"), F.lit("unknown")), F.lit("::"), F.coalesce(item, F.lit(""))))


def toggled(marks: DataFrame, changes: DataFrame) -> DataFrame:
    """Bookmarks (user, key, at, snapshot) after changes of the same form: a mark that is set again goes, a new one comes with its copy of the item. Of several changes an odd number counts."""
    odd = changes.groupBy("user", "key").agg(F.count("*").alias("n"), F.max("at").alias("at"), F.max_by("snapshot", "at").alias("snapshot")).where("n % 2 = 1").drop("n")
    kept = marks.join(odd.select("user", "key"), ["user", "key"], "left_anti")
    return kept.unionByName(odd.join(marks.select("user", "key"), ["user", "key"], "left_anti"))


def migrated(legacy: DataFrame, items: DataFrame) -> DataFrame:
    """Marks that know an id only (user, id), with the newest edition's copy of the item; those that fit nothing stay as they are."""
    newest = items.groupBy("id").agg(F.max_by(F.struct("edition_date", "title"), "edition_date").alias("x")).select("id", "x.*")
    return legacy.join(newest, "id", "left").select("user", item_key(F.lit(""), F.col("edition_date"), F.col("id")).alias("key"), F.col("title").alias("snapshot"))


def word_list(words: DataFrame, most: int = 20, length: int = 40) -> DataFrame:
    """``words``: user, word, at. Each reader's words, trimmed and cut, each once without regard to case (as first entered), the first ``most``."""
    from tidewire.operators.selection import first_per_key

    w = words.select("user", F.substring(F.regexp_replace("word", r"(?U)^\s+|\s+$", ""), 1, length).alias("word"), "at").where("word != ''")
    once = w.groupBy("user", F.lower("word").alias("k")).agg(F.min_by("word", "at").alias("word"), F.min("at").alias("at"))
    return first_per_key(once, ["user"], [F.asc("at"), F.asc("k")], most).select("user", "word", "place")
