"""Rows that tell of the same event, and links of items with their history and with papers.

Pairs are looked for within a day and the next only, each day in a task that holds its titles (``functions.titles``), so
what is shuffled is the titles twice, whatever their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.config import ENABLED_CATEGORIES, ENABLING_AREAS, LIMITS, MISSION_AREAS, NEWS_RESEARCH_AREAS
from tidewire.functions import similarity, text, titles
from tidewire.operators.selection import first_per_key
from tidewire.shared import written

RATIO, RATIO_LENGTH = 0.9, 24
#: Titles of a day and the next that one task holds.
BLOCK = 65536


def titled(rows: DataFrame) -> DataFrame:
    """``rows``: row, ts, title. What the title rules need; rows without a time meet none."""
    return rows.where("ts IS NOT NULL").select(F.col("row").cast("long").alias("row"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("title", F.lit("")).alias("title"))


def tokens_tell(t_a: Column, t_b: Column, acr_a: Column, acr_b: Column) -> Column:
    """Four shared tokens and half of the smaller title, or three, 35 % and an acronym of both among them."""
    shared = F.array_intersect(t_a, t_b)
    n, share = F.size(shared), F.size(shared) / F.greatest(F.lit(1), F.least(F.size(t_a), F.size(t_b)))
    acronym = F.size(F.array_intersect(F.array_intersect(shared, acr_a), acr_b)) > 0
    return F.coalesce(((n >= 4) & (share >= 0.5)) | ((n >= 3) & (share >= 0.35) & acronym), F.lit(False))


def pairs_near_in_time(rows: DataFrame, hours: int, words: bool, ratio: bool) -> DataFrame:
    """Pairs (row_a < row_b) of ``titled`` rows at most ``hours`` (of a day at most) apart that the rules asked for tell of, each once.

    The titles travel, not what they are looked up by: every row goes to its day's task and, as a guest, to the task of the
    day before; two guests meet elsewhere. A day with more than ``BLOCK`` rows and guests is cut into blocks, and every two
    blocks make a task, so a task's memory is bounded.
    """
    day = F.floor(F.col("at") / F.lit(86_400_000_000)).cast("int")
    each = rows.select("*", F.inline(F.array(F.struct(day.alias("bucket"), F.lit(False).alias("guest")), F.struct((day - 1).alias("bucket"), F.lit(True).alias("guest")))))
    blocks = each.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")).where("n > 1")  # a row for each crowded day
    each = each.join(F.broadcast(blocks), "bucket", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    each = each.withColumn("own", F.pmod(F.xxhash64("row"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    tasks = each.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "guest", (F.col("own") < F.col("other")).alias("left"), "row", "at", "title")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes, but much work on each
    sent = tasks.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return sent.mapInArrow(titles.pairs_of_tasks(hours, words, (RATIO, RATIO_LENGTH) if ratio else None), "row_a long, row_b long")


def pairs_by_words(rows: DataFrame, hours: int = LIMITS.lookback_hours) -> DataFrame:
    """Pairs of ``titled`` rows near in time with equal normalised titles, or whose tokens tell of one event."""
    return pairs_near_in_time(rows, hours, True, False)


def pairs_by_ratio(rows: DataFrame, hours: int = LIMITS.lookback_hours) -> DataFrame:
    """Pairs of ``titled`` rows near in time whose long normalised titles have a sequence ratio of 0.9 and more; the later row of a pass (the older) stands first, as the order matters."""
    return pairs_near_in_time(rows, hours, False, True)


def same_event_pairs(rows: DataFrame, hours: int = LIMITS.lookback_hours) -> DataFrame:
    """``rows``: row, ts, title. All pairs that tell of the same event by any of the four rules."""
    return pairs_near_in_time(titled(rows), hours, True, True)


def hashed(tokens: Column) -> Column:
    """Tokens as numbers, whose sets intersect far faster than those of strings."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all shuffle partitions: few bytes a row, but much work on each, which splits by size would leave to few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are costly and used more than once: behind a generator, which no filter is pushed through, each is computed once a row."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def joined_reason(lead: str, shared: Column, n: int) -> Column:
    return F.when(F.size(shared) > 0, F.concat(F.lit(lead), F.array_join(F.slice(F.array_sort(shared), 1, n), "、")))


def history_links(report: DataFrame, archive: DataFrame, least: int = LIMITS.history_min_score, n_links: int = LIMITS.history_links) -> DataFrame:
    """The best ``n`` earlier items of every item of a report, with points, label and reasons.

    Both sides: row, id, day, title, summary, category, tags. The report has a fixed number of items (a top list), so it
    is broadcast, and the archive is read once, without a shuffle of it.
    """

    def side(df: DataFrame) -> DataFrame:
        t = df.select("row", "id", "day", text.strip(F.coalesce("category", F.lit(""))).alias("cat"), text.clean_text(F.col("title")).alias("title"), text.clean_text(F.col("summary")).alias("body"), "tags")
        lower = F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda w: F.lower(text.squeeze(w))), lambda w: w != ""))
        t = t.withColumns({"tt": text.history_tokens(F.col("title")), "tb": text.history_tokens(F.col("body")), "tags": lower, "norm": text.normalized_title(F.col("title")), "tokens": text.title_tokens(F.col("title")), "acr": text.acronyms(F.col("title"))})
        return t.withColumns({"ht": hashed(F.col("tt")), "ha": hashed(F.array_union("tt", "tb"))}).drop("tb", "title", "body")

    # The archive's tokens are made once; only what the join needs is read back.
    sides = {"a": side(report), "b": written(side(archive), "archive-tokens")}
    as_ = lambda x, *names: sides[x].select(*(F.col(c).alias(f"{c}_{x}") for c in names))
    few = ("row", "id", "day", "cat", "tags", "norm", "tokens", "acr", "ht", "ha")
    day, c = F.col("day_a"), lambda name: (F.col(f"{name}_a"), F.col(f"{name}_b"))
    pairs = spread(as_("b", *few), "row_b").join(F.broadcast(as_("a", *few)), (F.col("day_b") < day) & (F.col("day_b") >= F.date_sub(day, LIMITS.history_days)) & F.col("id_b").isNotNull() & ~F.col("id_a").eqNullSafe(F.col("id_b")))
    n = {k: F.size(F.array_intersect(*c(k))) for k in ("ht", "ha", "tags")}
    share = lambda k: text.overlap(F.col(f"n_{k}"), *(F.size(x) for x in c(k)))
    words = (F.col("norm_a") == F.col("norm_b")) | tokens_tell(*c("tokens"), *c("acr"))
    long = (F.length("norm_a") > RATIO_LENGTH) & (F.length("norm_b") > RATIO_LENGTH)
    grams = [similarity.grams(x) for x in c("norm")]
    maybe = long & ~F.col("words") & (2 * F.least(F.length("norm_a"), F.length("norm_b")) >= F.lit(RATIO) * (F.length("norm_a") + F.length("norm_b")))
    pairs = once(pairs, **{f"n_{k}": v for k, v in n.items()}, words=words)
    # Without the same event a pair can reach the least only by its own points, and no more than 18 come with it.
    same = F.col("cat_a") == F.col("cat_b")
    plain = F.lit(55) * share("ht") + F.lit(27) * share("ha") + F.lit(10) * share("tags") + F.when(same, 5).otherwise(0)
    pairs = pairs.withColumns({"plain": plain, "same": same}).where(F.col("plain") + 18.5 >= least)
    maybe = F.when(maybe, F.when(similarity.may_be_close(*c("norm"), *grams, RATIO), F.lit(True)))
    pairs = pairs.withColumn("direct", F.col("words") | similarity.ratio_at_least(F.when(maybe, F.col("norm_a")), F.when(maybe, F.col("norm_b")), RATIO))
    lexical = (F.col("n_ht") >= 2) | (F.col("n_ha") >= 3) | (share("ht") >= 0.28) | (share("ha") >= 0.2)
    points = F.bround(F.col("plain") + F.when(F.col("direct"), 18).otherwise(0)).cast("int")
    scored = pairs.where(lexical | F.col("direct")).select("row_a", "row_b", "day_b", "same", "direct", F.greatest(F.lit(0), F.least(F.lit(100), points)).alias("points")).where(F.col("points") >= least)
    best = first_per_key(scored, ["row_a"], [F.desc("points"), F.desc("day_b"), F.asc("row_b")], n_links)
    said = best.join(as_("a", "row", "tt", "tags", "cat"), "row_a").join(as_("b", "row", "tt", "tags"), "row_b")
    why = F.slice(F.array_compact(F.array(
        F.when(F.col("direct"), F.lit("标题结构显示为同一事件的后续报道")), joined_reason("标题共享关键词：", F.array_intersect(*c("tt")), 4), joined_reason("共同标签：", F.array_intersect(*c("tags")), 3),
        F.when(F.col("same"), F.concat(F.lit("同属"), F.when(F.col("cat_a") != "", F.col("cat_a")).otherwise("同一主题"))),
    )), 1, 3)
    return said.select("row_a", "row_b", "day_b", "points", "place", "direct", why.alias("reasons"), F.when(F.col("direct"), "同一事件后续").otherwise("相关主题演进").alias("label"))


def relation(category: Column, area: Column) -> Column:
    enabling = category.isin(*ENABLED_CATEGORIES) & area.isin(*ENABLING_AREAS)
    return F.when(enabling, "潜在使能技术").when((category == "航空航天") & area.isin(*MISSION_AREAS), "科学与任务背景").otherwise("同主题研究")


def area_match(category: Column, area: Column, areas: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(False)
    for name, those in areas.items():
        out = F.when(category == name, area.isin(*those)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def paper_links(news: DataFrame, papers: DataFrame, areas: dict[str, tuple[str, ...]] = NEWS_RESEARCH_AREAS, least: int = LIMITS.link_min_score, n_links: int = LIMITS.link_limit) -> DataFrame:
    """The best ``n`` papers of every item among those of the same edition.

    ``news``: row, day, title, summary, category, tags. ``papers``: row, day, title, abstract, tags, keywords, area, score;
    an edition has a fixed number of papers (a top list), so the join by day grows with the items alone.
    """
    lower = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda w: F.lower(text.squeeze(w))), lambda w: w != ""))
    words = lambda *cols: text.history_tokens(F.concat_ws(" ", *(F.coalesce(x, F.lit("")) for x in cols)))
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    clean = lambda df, *cols: df.withColumns({c: text.clean_text(F.col(c)) for c in cols})
    a = clean(news, "title", "summary").select(F.col("row").alias("row_a"), "day", text.strip(F.coalesce("category", F.lit(""))).alias("cat"), words("title").alias("tt_a"), words("summary", listed("tags")).alias("tb_a"), lower("tags").alias("tags_a"))
    b = clean(papers, "title", "abstract").select(F.col("row").alias("row_b"), "day", "area", F.col("score").alias("paper_score"), words("title").alias("tt_b"), words("abstract", listed("tags"), listed("keywords")).alias("tb_b"), lower("keywords").alias("keys_b"))
    a, b = (written(df.withColumns({f"ta_{x}": F.array_union(f"tt_{x}", f"tb_{x}"), f"ht_{x}": hashed(F.col(f"tt_{x}"))}).withColumn(f"ha_{x}", hashed(F.col(f"ta_{x}"))).drop(f"tb_{x}"), "tokens") for df, x in ((a, "a"), (b, "b")))
    pairs = spread(a.select("row_a", "day", "cat", "tags_a", "ht_a", "ha_a"), "row_a").join(b.select("row_b", "day", "area", "paper_score", "keys_b", "ht_b", "ha_b"), "day")
    n = lambda k: F.size(F.array_intersect(f"{k}_a", f"{k}_b"))
    counted = once(pairs, st=n("ht"), sa=n("ha"), n_hits=F.size(F.array_intersect("tags_a", "keys_b")), **{f"n_{k}_{x}": F.size(f"{k}_{x}") for k in ("ht", "ha") for x in "ab"})
    match = area_match(F.col("cat"), F.col("area"), areas)
    t, whole = (text.overlap(F.col(s), F.col(f"n_{k}_a"), F.col(f"n_{k}_b")) for s, k in (("st", "ht"), ("sa", "ha")))
    points = F.bround(F.lit(48) * t + F.lit(28) * whole + F.when(match, 14).otherwise(0) + F.least(F.lit(12), F.col("n_hits") * 6)).cast("int")
    lexical = (F.col("st") >= 1) | (F.col("sa") >= 2) | (F.col("n_hits") > 0)
    scored = counted.select("row_a", "row_b", "cat", "area", "paper_score", F.when(lexical, F.greatest(F.lit(0), F.least(F.lit(100), points))).alias("points"))
    best = first_per_key(scored.where(F.col("points") >= least), ["row_a"], [F.desc("points"), F.desc("paper_score"), F.asc("row_b")], n_links)
    said = best.join(a.select("row_a", "tt_a", "ta_a"), "row_a").join(b.select("row_b", "tt_b", "ta_b").dropDuplicates(["row_b"]), "row_b")
    shared = F.coalesce(joined_reason("标题共同线索：", F.array_intersect("tt_a", "tt_b"), 4), joined_reason("摘要共同线索：", F.array_intersect("ta_a", "ta_b"), 4))
    why = F.array_compact(F.array(shared, F.when(match, F.concat(F.lit("新闻主题与"), "area", F.lit("研究方向对应")))))
    return said.select("row_a", "row_b", "points", "place", relation(F.col("cat"), F.col("area")).alias("relation"), why.alias("reasons"))


def reverse_links(links: DataFrame, when: DataFrame, n: int = LIMITS.link_limit) -> DataFrame:
    """Of every paper the best ``n`` of the items that it was linked to; ``when``: row_a, published_at."""
    return first_per_key(links.drop("place").join(when, "row_a"), ["row_b"], [F.desc("points"), F.desc_nulls_last("published_at"), F.asc("row_a")], n)
