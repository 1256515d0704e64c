"""Top-k under quotas and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every key. Spark cuts each partition to n rows a key before the shuffle."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def capped_per_key(df: DataFrame, key: str, order: list[Column], cap: int, limit: int) -> DataFrame:
    """``limit`` rows in ``order`` with at most ``cap`` of a key, filled up from the rest where rows are lacking.

    Rows within their cap come first, then the others, both in order; so one ranking and one bounded sort do.
    """
    # No key can fill more than ``limit`` places; the filter lets Spark cut hot keys before the shuffle.
    placed = df.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= limit)
    return placed.withColumn("over", F.col("place") > cap).orderBy("over", *order).limit(limit)


def greedy_two_caps(df: DataFrame, order: list[Column], pool: int, n: int, cap_a: int, cap_b: int) -> DataFrame:
    """``n`` of the first ``pool`` rows, greedily under two caps at once, then without the first, then without both.

    ``df``: key_a, key_b, row. The caps act on each other, so no two independent rankings give this; the pool is a
    fixed small number, so the fold runs over one array.
    """
    first = df.orderBy(*order).limit(pool).withColumn("ord", F.row_number().over(W.orderBy(*order)))
    rows = first.agg(F.array_sort(F.collect_list(F.struct("ord", "row", "key_a", "key_b"))).alias("rows"))
    empty = F.array().cast("array<struct<ord:int,row:bigint,key_a:string,key_b:string,pass:int>>")

    def step(k: int, with_a: bool, with_b: bool):
        def f(acc: Column, x: Column) -> Column:
            free = F.size(acc) < n
            new = ~F.exists(acc, lambda y: y["ord"] == x["ord"])
            a = F.size(F.filter(acc, lambda y: y["key_a"].eqNullSafe(x["key_a"]))) < cap_a if with_a else F.lit(True)
            b = F.size(F.filter(acc, lambda y: y["key_b"].eqNullSafe(x["key_b"]))) < cap_b if with_b else F.lit(True)
            item = F.struct(x["ord"].cast("int").alias("ord"), x["row"].cast("bigint").alias("row"), x["key_a"].alias("key_a"), x["key_b"].alias("key_b"), F.lit(k).alias("pass"))
            return F.when(free & new & a & b, F.array_append(acc, item)).otherwise(acc)

        return f

    acc = empty
    out = rows.withColumn("acc0", acc)
    for k, (with_a, with_b) in enumerate(((True, True), (False, True), (False, False))):
        out = out.withColumn(f"acc{k + 1}", F.aggregate("rows", F.col(f"acc{k}"), step(k, with_a, with_b)))
    return out.select(F.explode("acc3").alias("x")).select("x.row", "x.key_a", "x.key_b", F.col("x.pass").alias("relaxed"))


def spotlight(df: DataFrame, pool: int, n: int) -> DataFrame:
    """The leader, then again and again the row that brings most news: a new event, a new category, a new source, then score, then time.

    ``df``: ord, row, event, category, source, score, ts; at most ``pool`` rows are looked at.
    """
    rows = df.orderBy("ord").limit(pool).agg(F.array_sort(F.collect_list(F.struct("ord", "row", "event", "category", "source", "score", "ts"))).alias("rows"))

    def rank(x: Column, acc: Column) -> Column:
        fresh = lambda name, points: F.when(F.exists(acc, lambda y: y[name].eqNullSafe(x[name])), 0).otherwise(points)
        return F.struct(fresh("event", 40).alias("a"), fresh("category", 24).alias("b"), fresh("source", 14).alias("c"), x["score"].alias("d"), x["ts"].alias("e"), (-x["ord"]).alias("f"), x.alias("x"))

    def pick(acc: Column, i: Column) -> Column:
        left = F.filter("rows", lambda x: ~F.exists(acc, lambda y: y["ord"] == x["ord"]))
        best = F.array_max(F.transform(left, lambda x: rank(x, acc)))
        return F.when(F.size(left) > 0, F.array_append(acc, best["x"])).otherwise(acc)

    picked = rows.where(F.size("rows") > 0).withColumn("acc", F.aggregate(F.sequence(F.lit(2), F.lit(n)), F.slice("rows", 1, 1), pick))
    return picked.select(F.posexplode("acc").alias("pos", "x")).select((F.col("pos") + 1).cast("int").alias("place"), "x.row")
