"""Zero-filled daily counts, median and median deviation, robust anomaly signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.config import CATEGORIES, LIMITS
from tidewire.functions import text


def daily_grid(events: DataFrame) -> DataFrame:
    """``events``: day, dim. Every observed day with every dimension, zero where nothing happened."""
    counts = events.groupBy("day", "dim").agg(F.count("*").alias("n"))
    # Days are few (one row a day), so the product is as large as the result and no larger.
    days = counts.select("day").distinct().agg(F.collect_list("day").alias("days"))
    dims = counts.select("dim").distinct()
    grid = dims.join(F.broadcast(days)).select("dim", F.explode("days").alias("day"))
    return grid.join(counts, ["day", "dim"], "left").select("day", "dim", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def median_mad(grid: DataFrame) -> DataFrame:
    """Per dimension: days, median, and median of the distances from it."""
    med = grid.groupBy("dim").agg(F.median("n").alias("med"), F.count("*").alias("observed"))
    mad = grid.join(med, "dim").groupBy("dim").agg(F.median(F.abs(F.col("n") - F.col("med"))).alias("mad"))
    return med.join(mad, "dim")


def dimensions(items: DataFrame) -> DataFrame:
    """``items``: day, category, tags, grp. One row for each of an item's dimensions: its category as written, and its tags, without regard to case."""
    tags = F.array_distinct(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(text.squeeze(t))))
    of = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("dimension"), n.alias("needle")))
    both = F.concat(of("category", F.array(text.strip(F.coalesce("category", F.lit(""))))), of("entity", tags))
    return items.select("day", "grp", F.explode(both).alias("x")).select("day", "grp", "x.*").where("needle != ''")


def signals(items: DataFrame, today: Column, min_observed: int = LIMITS.min_observed) -> DataFrame:
    """Categories, and of today's tags the first forty by name, whose count today stands out of the observed days before, days without any included.

    All signals with ``place`` in the order of publication; ``published`` marks the first eight.
    """
    names = items.where(F.col("day") == today).select(F.explode("tags").alias("t")).select(text.squeeze(F.col("t")).alias("name")).where("name != ''").distinct().orderBy("name").limit(LIMITS.signal_tags)
    spark = items.sparkSession
    wanted = names.select(F.lit("entity").alias("dimension"), "name").union(spark.createDataFrame([("category", c) for c in CATEGORIES], "dimension string, name string"))
    wanted = wanted.withColumn("needle", F.when(F.col("dimension") == "entity", F.lower("name")).otherwise(F.col("name")))  # at most 46 rows
    each = dimensions(items).join(F.broadcast(wanted), ["dimension", "needle"])
    key = ["dimension", "name"]
    past = lambda df: df.where((F.col("day") < today) & (F.col("day") >= F.date_sub(today, LIMITS.baseline_days)))
    now = each.where(F.col("day") == today).groupBy(*key).agg(F.count("*").alias("current_count"), F.count_distinct(F.when(F.col("grp") != "", F.col("grp"))).alias("groups"))
    now = now.where((F.col("current_count") >= LIMITS.min_count) & (F.col("groups") >= LIMITS.min_groups))
    days = past(items).select("day").distinct().agg(F.count("*").alias("days"))
    counts = past(each).groupBy(*key, "day").agg(F.count("*").cast("double").alias("n"))
    # One array of at most ``baseline_days`` counts a dimension, filled with zeros for the days without any.
    series = now.join(counts.groupBy(*key).agg(F.collect_list("n").alias("ns")), key, "left").join(F.broadcast(days))
    ns = F.coalesce("ns", F.array().cast("array<double>"))
    full = F.array_sort(F.concat(ns, F.array_repeat(F.lit(0.0), (F.col("days") - F.size(ns)).cast("int"))))
    series = series.where(F.col("days") >= min_observed).withColumn("full", full).withColumn("med", _median("full"))
    series = series.withColumn("dist", F.array_sort(F.transform("full", lambda x: F.abs(x - F.col("med"))))).withColumn("mad", _median("dist"))
    c = F.col("current_count")
    series = series.withColumn("ratio", c / F.greatest(F.lit(0.5), "med")).withColumn("deviation", (c - F.col("med")) / F.greatest(F.lit(1.0), 1.4826 * F.col("mad")))
    kept = series.where((F.col("ratio") >= 1.8) & (c - F.col("med") >= 1.5) & (F.col("deviation") >= 1.5))
    kept = kept.withColumn("severity", F.when((F.col("ratio") >= 3) & (F.col("deviation") >= 3), "high").otherwise("elevated"))
    from pyspark.sql import Window as W

    order = W.orderBy(F.desc(F.col("severity") == "high"), F.desc(F.bround("deviation", 1)), F.desc(F.bround("ratio", 1)), "dimension", "name")  # at most 46 rows
    return kept.withColumn("place", F.row_number().over(order)).withColumn("published", F.col("place") <= LIMITS.signals)


def _median(name: str) -> Column:
    n = F.size(name)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(F.col(name), low) + F.get(F.col(name), high)) / 2
