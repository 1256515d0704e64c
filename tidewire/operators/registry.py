"""State that is carried from batch to batch: event records, ledgers, recovery of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.config import LIMITS
from tidewire.operators.selection import first_per_key


def last(items: Column, n: int) -> Column:
    """The last ``n`` elements; shorter arrays stay whole."""
    return F.when(F.size(items) <= n, items).otherwise(F.slice(items, -n, n))


def ordered_union(old: Column, new: Column, n: int) -> Column:
    """Old then new elements, each once at its first place, the last ``n`` of them."""
    return last(F.array_distinct(F.concat(old, new)), n)


def _in_order(items: DataFrame, column: str, n: int) -> DataFrame:
    """Per event the distinct values of ``column`` by their first occurrence, the last ``n`` of them.

    Cut to the cap by rank before they are collected, so a hot event makes no large array.
    """
    first = items.where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).groupBy("event", column).agg(F.min("ord").alias("ord"))
    few = first_per_key(first, ["event"], [F.desc("ord")], n)
    return few.groupBy("event").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", column))), lambda x: x[column]).alias(f"{column}s"))


def batch_records(items: DataFrame) -> DataFrame:
    """``items``: event, day, item, grp, title, category, summary, score, ts. One record for each event of a batch.

    Within an edition the best item comes first, so the last one, which names the record, is its lowest. All parts are
    partitioned by event, and their joins need no further shuffle of them.
    """
    ts = F.coalesce("ts", F.lit("1970-01-01").cast("timestamp_ntz"))
    df = items.withColumns({"score": F.coalesce("score", F.lit(0)), "ts": ts})
    df = df.withColumn("ord", F.struct("day", (-F.col("score")).alias("low"), (-F.unix_micros(ts.cast("timestamp"))).alias("late"), "item", "row"))
    newest = F.max_by(F.struct("title", "category", "summary", "score"), "ord")
    spans = df.groupBy("event").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), newest.alias("x")).select("event", "first_seen", "last_seen", "x.*")
    line = df.where("item IS NOT NULL").groupBy("event", "day", "item").agg(F.max("ts").alias("at"))
    line = first_per_key(line, ["event"], [F.desc("day"), F.desc("at"), F.desc("item")], LIMITS.timeline)
    line = line.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("day", "at", "item"))).alias("timeline"))
    out = spans.join(line, "event", "left").join(_in_order(df, "item", LIMITS.news_ids), "event", "left").join(_in_order(df, "grp", LIMITS.source_groups), "event", "left").join(_in_order(df, "day", LIMITS.retention_days), "event", "left")
    none = F.array().cast("array<string>")
    return out.select("event", "first_seen", "last_seen", "title", "category", "summary", "score", F.coalesce("timeline", F.array().cast("array<struct<day:date,at:timestamp_ntz,item:string>>")).alias("timeline"), F.coalesce("items", none).alias("items"), F.coalesce("grps", none).alias("groups"), F.coalesce("days", F.array().cast("array<date>")).alias("editions"))


def upsert(state: DataFrame, batch: DataFrame, today: Column, retention: int = LIMITS.retention_days) -> DataFrame:
    """Merge a batch's records into the state: spans widen, arrays grow up to their caps, the batch's title, category,
    summary and score win, records not seen for ``retention`` days go. One shuffle by event for each side."""
    s = state.where(F.col("last_seen") >= F.date_sub(today, retention)).select(*(F.col(c).alias(f"s_{c}") if c != "event" else F.col(c) for c in state.columns))
    m = s.join(batch, "event", "full_outer")
    both = lambda c, n: ordered_union(F.coalesce(f"s_{c}", F.slice(c, 1, 0)), F.coalesce(c, F.slice(f"s_{c}", 1, 0)), n)
    new = lambda c: F.when(F.col("last_seen").isNotNull(), F.col(c)).otherwise(F.col(f"s_{c}")).alias(c)
    out = m.select(
        "event", F.least("s_first_seen", "first_seen").alias("first_seen"), F.greatest("s_last_seen", "last_seen").alias("last_seen"), *map(new, ("title", "category", "summary", "score")),
        last(F.array_sort(both("timeline", 1 << 20)), LIMITS.timeline).alias("timeline"), both("items", LIMITS.news_ids).alias("items"), both("groups", LIMITS.source_groups).alias("groups"), both("editions", retention).alias("editions"),
    )
    return out.where(F.col("last_seen") >= F.date_sub(today, retention)).withColumn("status", F.when((F.col("first_seen") < F.col("last_seen")) | (F.size("timeline") > 1), "tracking").otherwise("new"))


def weekly(records: DataFrame, papers: DataFrame, week_start: Column, n: int = LIMITS.weekly_limit) -> DataFrame:
    """The week's best ``n`` events by score, updates, groups and papers, each with its trend. ``papers``: event, n_papers."""
    inside = records.where((F.col("last_seen") >= week_start) & (F.col("last_seen") <= F.date_add(week_start, 6))).join(papers, "event", "left")
    updates, groups, links = F.size("timeline"), F.greatest(F.lit(1), F.size("groups")), F.coalesce("n_papers", F.lit(0))
    points = F.col("score") + F.least(F.lit(12), updates * 2) + F.least(F.lit(10), groups * 2) + F.least(F.lit(8), links * 2)
    trend = F.when(F.col("first_seen") >= week_start, "本周新出现").when(updates >= 3, "持续演化").otherwise("继续发展")
    df = inside.withColumns({"points": points.cast("int"), "trend": trend, "n_updates": updates, "n_papers": links.cast("int")})
    return first_per_key(df.withColumn("week", week_start), ["week"], [F.desc("points"), F.desc("last_seen"), F.asc("event")], n)


def ledger(entries: DataFrame, edition: Column) -> DataFrame:
    """``entries``: forecast, event, created, due, statement, status, evidence (array), seq. The latest entry of each forecast
    wins; what it rests on comes from all of them, the last twelve ids by their first place; open ones fall due with the
    edition, a status that has been resolved stays; the newest twelve of an event remain."""
    one = entries.groupBy("forecast").agg(F.max_by(F.struct("event", "created", "due", "statement", "status"), "seq").alias("x")).select("forecast", "x.*")
    ids = entries.select("forecast", "seq", F.posexplode("evidence").alias("pos", "id")).groupBy("forecast", "id").agg(F.min(F.struct("seq", "pos")).alias("ord"))
    ids = first_per_key(ids, ["forecast"], [F.desc("ord")], LIMITS.evidence_ids)
    ids = ids.groupBy("forecast").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("evidence"))
    waiting = F.coalesce("status", F.lit("open")).isin("open", "due")
    one = one.withColumn("status", F.when(waiting, F.when(F.col("due") <= edition, "due").otherwise("open")).otherwise(F.col("status"))).join(ids, "forecast", "left")
    return first_per_key(one, ["event"], [F.desc("created"), F.asc("forecast")], LIMITS.forecasts).drop("place")


def backfill(rows: DataFrame, ts: Column, now: Column, wanted: int, windows: tuple[int, ...] = (LIMITS.lookback_hours, *LIMITS.backfill_hours)) -> DataFrame:
    """Rows of the shortest window that holds ``wanted`` rows, or of the longest, with the window that first holds each
    (what a longer window adds comes after the fresh rows). The windows are counted in one pass."""
    age = (F.unix_micros(now) - F.unix_micros(ts)) / 3.6e9
    inside = rows.withColumn("age", age).where((F.col("age") <= max(windows)) & (F.col("age") >= -LIMITS.future_hours))
    counts = inside.agg(*(F.count_if(F.col("age") <= h).alias(f"h{h}") for h in windows))
    pick = F.lit(max(windows))
    for h in sorted(windows, reverse=True):
        pick = F.when(F.col(f"h{h}") >= wanted, h).otherwise(pick)
    own = F.lit(max(windows))
    for h in sorted(windows, reverse=True):
        own = F.when(F.col("age") <= h, h).otherwise(own)
    return inside.join(F.broadcast(counts.select(pick.alias("hours"))), F.col("age") <= F.col("hours")).withColumn("window", own).drop("age")


def recovered(fresh: DataFrame, cache: DataFrame, cache_age: Column, most_hours: int = 8) -> DataFrame:
    """Fresh rows and what a cache (young enough, and not of the future) adds to them, by id; each with its origin."""
    young = cache.where(cache_age.between(-LIMITS.future_hours, most_hours)).join(fresh.select("id"), "id", "left_anti")
    return fresh.withColumn("origin", F.lit("fresh")).unionByName(young.withColumn("origin", F.lit("cache")))


def last_good(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The current rows, or where there are none the previous ones, marked as stale. One count of one row decides."""
    some = current.limit(1).agg((F.count("*") > 0).alias("some"))
    keep = lambda df, want, mark: df.join(F.broadcast(some), F.col("some") == F.lit(want)).drop("some").withColumn("stale", F.lit(mark))
    return keep(current, True, False).unionByName(keep(previous, False, True))
