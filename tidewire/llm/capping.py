"""Problem 5: no contributor above its allowance in an edition, by radix selection.

A row's order is encoded as ten or more order-preserving bytes (score, time,
row key; smaller is better). For every contributor over its allowance the
cutoff is fixed digit by digit: rows are counted per contributor and byte, the
byte where the running count passes what is left of the allowance becomes the
next digit, better rows are kept, worse ones dropped, and only the rows with
that very byte are looked at again. What is sent to the tasks is one digit per
contributor over its allowance, of which there are at most 1 / share in an
edition (or a quarter of the rows of an edition of under 60), so it stays a
join with a shuffle-free side only while that count is small.

Defined results: rows with a blank source belong to nobody and are neither
counted nor dropped; a missing score or time comes last; redelivered rows
count each; rows equal in every byte (a row key given twice) stay together; an empty table gives an empty result; only the columns named are
read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewire.llm.topn import ENDS
from tidewire.shared import written

LEAST, SHARE = 3, 0.05


def contributor_key(c: Column) -> Column:
    """Lower-cased, blanks at the ends removed, blanks inside as one space."""
    inner = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), ENDS, ""), r"(?U)[\s\x{200B}-\x{200D}\x{2060}\x{FEFF}]+", " ")
    return F.lower(inner)


def known_names(sources: DataFrame) -> DataFrame:
    """Every written form of a source, once, with the source's number."""
    names = F.concat(F.array("source", "domain"), F.coalesce("aliases", F.array().cast("array<string>")))
    return sources.select("source_id", F.explode(names).alias("name")).select(contributor_key(F.col("name")).alias("name"), "source_id").where("name != ''").groupBy("name").agg(F.min("source_id").alias("source_id"))


def order_bytes(score: Column, published: Column, row: Column) -> Column:
    """The order as a hexadecimal string of fixed length: score descending, time descending, row ascending, missing last."""
    down = lambda x, bits: F.lpad(F.lower(F.hex(F.lit((1 << bits) - 1) - x)), bits // 4, "0")
    s = F.when(score.isNull(), F.lit("f" * 10)).otherwise(F.concat(F.lit("00"), down(score.cast("long") + F.lit(1 << 31), 32)))
    micros = F.unix_micros(published.cast("timestamp")) + F.lit(1 << 60)
    t = F.when(published.isNull(), F.lit("f" * 18)).otherwise(F.concat(F.lit("00"), F.lpad(F.lower(F.hex(F.lit((1 << 62) - 1) - micros)), 16, "0")))
    r = F.lpad(F.lower(F.hex(row.cast("long") + F.lit(1 << 62))), 16, "0")
    return F.concat(s, t, r)


def over_allowance(rows: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """``rows`` has part, who, row, code; gives the rows beyond the allowance of ``who`` in ``part``."""
    counts = rows.groupBy("part", "who").agg(F.count("*").alias("m"), F.min("code").alias("lo"), F.max("code").alias("hi"))
    per_part = counts.groupBy("part").agg(F.sum("m").alias("r"))
    cap = F.greatest(F.lit(least).cast("long"), F.floor(F.col("r") * F.lit(share) + F.lit(1e-9)))
    over = counts.join(per_part, "part").select("part", "who", cap.alias("left"), "m", "lo", "hi").where("m > left")
    active = written(rows.join(over.select("part", "who", "left"), ["part", "who"]), "radix")
    length = active.agg(F.max(F.length("code"))).first()[0]
    if length is None:
        return active.select("row")
    # Bytes that are equal in all rows decide nothing; their places are passed over.
    spread = active.agg(*[F.min(F.substring("code", i + 1, 2)).alias(f"a{i}") for i in range(0, length, 2)], *[F.max(F.substring("code", i + 1, 2)).alias(f"z{i}") for i in range(0, length, 2)]).first()
    dropped = []
    for i in (i for i in range(0, length, 2) if spread[f"a{i}"] != spread[f"z{i}"]):
        digit = F.substring("code", i + 1, 2)
        tally = active.groupBy("part", "who", "left", digit.alias("digit")).agg(F.count("*").alias("m"))
        before = F.sum("m").over(W.partitionBy("part", "who").orderBy("digit").rowsBetween(W.unboundedPreceding, -1))
        at = tally.withColumn("before", F.coalesce(before, F.lit(0)))
        cut = at.where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("m") > F.col("left"))).select("part", "who", F.col("digit").alias("cut"), (F.col("left") - F.col("before")).alias("rest"))
        met = active.join(cut, ["part", "who"])
        step = written(met.where(digit >= F.col("cut")).select("part", "who", "row", "code", F.col("rest").alias("left"), ((digit > F.col("cut")) | (F.col("rest") == 0)).alias("worse")), "radix")
        dropped.append(step.where("worse").select("row"))
        active = step.where("not worse").drop("worse")
        if active.isEmpty():
            break
    out = dropped[0]
    for d in dropped[1:]:
        out = out.union(d)
    return out


def coded(items: DataFrame, sources: DataFrame) -> DataFrame:
    own = items.select(F.col("item_row").alias("row"), F.coalesce(F.col("edition_date").cast("string"), F.lit("")).alias("part"), contributor_key(F.col("source")).alias("name"), order_bytes(F.col("score"), F.col("published_at"), F.col("item_row")).alias("code")).where("name != ''")
    who = F.coalesce(F.concat(F.lit("#"), F.col("source_id")), F.concat(F.lit("="), F.col("name")))
    return own.join(known_names(sources), "name", "left").select("part", who.alias("who"), "row", "code")


def found(spark: SparkSession, sf: str) -> DataFrame:
    items, sources = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("edition_items", "sources"))
    return over_allowance(coded(items, sources)).select(F.col("row").alias("item_row"))


_BLANK = r"[\s\p{Z}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{85}]+"


def _clean(column: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({column}, ''), '{_BLANK}', ' ', 'g')))"


SQL = f"""
WITH names AS (
  SELECT name, min(source_id) AS source_id FROM (
    SELECT source_id, {_clean('n')} AS name
    FROM (SELECT source_id, unnest(list_concat([source, domain], coalesce(aliases, []))) AS n FROM sources)
  ) WHERE name <> '' GROUP BY name
), own AS (
  SELECT item_row, edition_date, score, published_at, {_clean('source')} AS name FROM edition_items
), who AS (
  SELECT o.*, coalesce('#' || n.source_id, '=' || o.name) AS who FROM own o LEFT JOIN names n ON o.name = n.name WHERE o.name <> ''
), ranked AS (
  SELECT item_row, row_number() OVER (PARTITION BY edition_date, who ORDER BY score DESC NULLS LAST, published_at DESC NULLS LAST, item_row) AS place,
    count(*) OVER (PARTITION BY edition_date) AS r
  FROM who
)
SELECT item_row FROM ranked WHERE place > greatest(3, CAST(floor(r * 0.05 + 1e-9) AS BIGINT))
"""
