"""Problem 2: the first N items of every group, by a secondary sort.

Rows are sorted by group and order inside every scan partition and a streaming
pass emits each group's first N there, holding the ids of one group's N rows
and no more; a hot group leaves a scan task with N rows at most. What is left
is hash-partitioned by group, sorted, and passed through the same stream.

Defined results: rows without a score or with a blank category are not taken;
a missing or blank country is the given default; a null id equals no other;
ties are settled by published_at (missing last) and the row key; repeated ids
count once, at their first place; an empty table gives an empty result; a
column of the input with a name used here does not clash, since only the
columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N = 3
NO_COUNTRY = "国际"
#: Blanks of any kind at the ends: Unicode white space and the invisible ones that it leaves out.
ENDS = r"(?U)^[\s\x{200B}-\x{200D}\x{2060}\x{FEFF}]+|[\s\x{200B}-\x{200D}\x{2060}\x{FEFF}]+$"


def folded(c: Column) -> Column:
    """Lower-cased, without blanks of any kind at the ends; null as empty."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), ENDS, ""))


def _first_n(n: int):
    """Rows arrive sorted by (g1, g2, g3) and order; of equal ids the first counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, taken = None, set(), 0
        for b in batches:
            size = b.num_rows
            if not size:
                continue
            keys = [b.column(i) for i in range(3)]
            change = np.zeros(size, bool)
            change[0] = True
            for k in keys:
                if size > 1:
                    change[1:] |= np.asarray(pa.compute.not_equal(k.slice(1), k.slice(0, size - 1)))
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], size)
            own, keep = b.column(3), []
            for s, e in zip(starts.tolist(), ends.tolist()):
                g = tuple(k[s].as_py() for k in keys)
                if g != group:
                    group, ids, taken = g, set(), 0
                for i in range(s, e):
                    if taken == n:
                        break
                    x = own[i].as_py()
                    if x is None or x not in ids:
                        ids.add(x)
                        taken += 1
                        keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return run


def first_of_groups(df: DataFrame, n: int = N) -> DataFrame:
    """``df`` has g1, g2, g3 (not null), id, score, published_at, row; the first ``n`` rows of every group stay."""
    order = [F.desc("score"), F.desc_nulls_last("published_at"), F.asc("row")]
    schema = df.schema
    local = df.sortWithinPartitions("g1", "g2", "g3", *order).mapInArrow(_first_n(n), schema)
    return local.repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", *order).mapInArrow(_first_n(n), schema)


def ranked_input(items: DataFrame) -> DataFrame:
    category, country = folded(F.col("category")), folded(F.col("country"))
    return items.where(F.col("score").isNotNull()).select(
        F.coalesce(F.col("edition_date").cast("string"), F.lit("")).alias("g1"),
        category.alias("g2"),
        F.when(country == "", F.lit(NO_COUNTRY)).otherwise(country).alias("g3"),
        "id", "score", "published_at", F.col("item_row").alias("row"),
    ).where("g2 != ''")


def found(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/edition_items.parquet")
    return first_of_groups(ranked_input(items)).select(F.col("row").alias("item_row"))


SQL = r"""
WITH clean AS (
  SELECT item_row, edition_date, id, score, published_at,
    lower(regexp_replace(coalesce(category, ''), '^[\s\p{Z}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{85}]+|[\s\p{Z}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{85}]+$', '', 'g')) AS cat,
    lower(regexp_replace(coalesce(country, ''), '^[\s\p{Z}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{85}]+|[\s\p{Z}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{85}]+$', '', 'g')) AS land
  FROM edition_items WHERE score IS NOT NULL
), once AS (
  SELECT *, CASE WHEN land = '' THEN '国际' ELSE land END AS place,
    row_number() OVER (PARTITION BY edition_date, cat, CASE WHEN land = '' THEN '国际' ELSE land END, coalesce(id, CAST(item_row AS VARCHAR) || ' no id')
      ORDER BY score DESC, published_at DESC NULLS LAST, item_row) AS of_id
  FROM clean WHERE cat <> ''
), ranked AS (
  SELECT item_row, row_number() OVER (PARTITION BY edition_date, cat, place ORDER BY score DESC, published_at DESC NULLS LAST, item_row) AS place_no
  FROM once WHERE of_id = 1
)
SELECT item_row FROM ranked WHERE place_no <= 3
"""
