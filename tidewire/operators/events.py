"""What is known of an event: its identifier, evidence, expectations, dossier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.config import FORECAST_SIGNALS, LIMITS, OTHER_SIGNALS, OUTLOOK, OUTLOOK_UNLINKED
from tidewire.functions import dates, text, web

NONE = F.array


def strings() -> Column:
    return F.array().cast("array<string>")


def event_ids(items: DataFrame, links: DataFrame, known: DataFrame, least: int = LIMITS.same_story_score) -> DataFrame:
    """``items``: row, id. ``links``: row, prev_id, prev_event, prev_day, points, same_story. ``known``: id, event. Gives row, event_id.

    An event is taken over on strong evidence only: 100 points for an id that is known already, a link's points and 20
    more for the same story; the most points win, then the greater identifier. Else the earliest direct predecessor's id
    names a new event, else the item's own.
    """
    direct = items.join(known, "id").select("row", F.lit(100).alias("points"), "event")
    strong = links.where(F.col("same_story") | (F.col("points") >= least)).join(known.select(F.col("id").alias("prev_id"), F.col("event").alias("by_id")), "prev_id", "left")
    event = F.coalesce(F.when(F.col("prev_event") != "", F.col("prev_event")), F.col("by_id"))
    linked = strong.select("row", (F.col("points") + F.when(F.col("same_story"), 20).otherwise(0)).alias("points"), event.alias("event")).where("event IS NOT NULL")
    best = direct.union(linked).groupBy("row").agg(F.max(F.struct("points", "event")).alias("x")).select("row", F.col("x.event").alias("taken"))
    before = links.where("same_story AND prev_id IS NOT NULL").groupBy("row").agg(F.min_by("prev_id", F.struct("prev_day", "prev_id")).alias("before"))
    named = items.join(best, "row", "left").join(before, "row", "left")
    return named.select("row", F.coalesce("taken", web.event_id(text.squeeze(F.coalesce("before", "id", F.lit(""))))).alias("event_id"))


def evidence_matrix(df: DataFrame) -> DataFrame:
    """``df``: title, summary, corroboration, groups, facts (arrays), related (array of title, summary, day; a few each).

    Adds ``claims``, ``disputes`` (earlier rows that share two words and differ in denial) and ``overall``.
    """
    groups = F.array_distinct(F.filter(F.coalesce("groups", strings()), lambda g: text.squeeze(g) != ""))
    n = F.greatest(F.lit(1), F.coalesce("corroboration", F.lit(1)))
    status = F.when(n >= 2, "multi-source-context").otherwise("single-source")
    claims = F.slice(F.transform(F.filter(F.coalesce("facts", strings()), lambda f: text.squeeze(f) != ""), lambda f: F.struct(F.substring(f, 1, 160).alias("text"), status.alias("status"), F.slice(groups, 1, 6).alias("groups"))), 1, 3)
    said = lambda t, s: F.concat_ws(" ", F.coalesce(t, F.lit("")), F.coalesce(s, F.lit("")))
    own = said(F.col("title"), F.col("summary"))
    df = df.withColumns({"own_words": text.history_tokens(own), "own_denial": text.denial(own)})
    other = lambda r: F.col("own_denial") != text.denial(said(r["title"], r["summary"]))
    shared = lambda r: F.size(F.array_intersect("own_words", text.history_tokens(said(r["title"], r["summary"])))) >= 2
    disputes = F.slice(F.filter("related", lambda r: other(r) & shared(r)), 1, 2)
    df = df.withColumns({"groups": F.slice(groups, 1, 8), "claims": claims, "disputes": F.coalesce(disputes, F.slice("related", 1, 0)), "independent": n})
    return df.withColumn("overall", F.when(F.size("disputes") > 0, "contested").when(n >= 2, "multi-source").otherwise("single-source")).drop("own_words", "own_denial")


def forecasts(df: DataFrame) -> DataFrame:
    """``df``: row, event, item, category, day, linked. Up to two expectations an item, with stable ids, a due date and what would verify them."""
    entry = lambda x: F.struct(*(F.lit(v).alias(n) for n, v in zip(("horizon", "statement", "confidence"), x)))
    outlook = F.when(F.col("linked"), F.array(*map(entry, OUTLOOK))).otherwise(F.array(*map(entry, OUTLOOK_UNLINKED)))
    e = df.withColumn("x", F.explode(F.slice(outlook, 1, 2)))
    key = F.concat_ws("|", "event", "x.horizon", text.normalized_title(F.col("x.statement")))
    signals = F.array(*map(F.lit, OTHER_SIGNALS))
    for name, those in FORECAST_SIGNALS.items():
        signals = F.when(F.col("category") == name, F.array(*map(F.lit, those))).otherwise(signals)
    return e.select(
        F.concat(F.lit("pred-"), F.substring(F.sha1(key), 1, 12)).alias("forecast"), "event", "x.horizon", "x.statement", "x.confidence", F.lit("open").alias("status"), F.col("day").alias("created"),
        dates.due_date(F.col("day").cast("string"), F.col("x.horizon")).alias("due"), signals.alias("signals"), F.array(F.col("item")).alias("evidence"),
    )


def dossiers(items: DataFrame, links: DataFrame) -> DataFrame:
    """``items``: row, id, event, day, independent. ``links``: row, prev_id, prev_day. What is published of each item's event: earlier rows and this one, the last eight."""
    related = links.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("prev_day").alias("day"), F.col("prev_id").alias("id")))).alias("related"))  # a few links each
    none = F.array().cast("array<struct<day:date,id:string>>")
    whole = F.array_append(F.coalesce("related", none), F.struct("day", "id"))
    df = items.join(related, "row", "left").withColumn("timeline", whole)
    return df.select("row", "event", F.when(F.size("timeline") > 1, "tracking").otherwise("new").alias("status"), F.array_min(F.transform("timeline", lambda x: x["day"])).alias("first_seen"), F.col("day").alias("last_seen"), F.size("timeline").alias("n_updates"), F.reverse(F.slice(F.reverse("timeline"), 1, 8)).alias("timeline"), "independent")
