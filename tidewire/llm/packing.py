"""Problem 6: texts packed into containers of fixed capacity, by minimum bin slack.

A text's size is its number of tokens under a public tokenizer. A text longer
than a container is divided into full containers and a rest; nothing else is
ever divided. The remaining sizes are packed in shards of bounded size: each
shard keeps a multiset of remaining lengths and fills one container after
another from a window of it, the longest remaining item first. A bitset holds
every total that a choice from the window can reach (one shift-or for each
item, counts split into binary parts); the reachable total closest to the
capacity is traced back to how many items of each length it takes. Only a
shard's last container can stand much below capacity, and such leftovers are
few: one for each shard and capacity.

Shards are cut by hash into about ``SHARD_TOKENS`` tokens (at least
``SHARD_CONTAINERS`` containers of each capacity), so no task holds more than a
shard. Defined results: null and empty texts have no tokens and are not packed;
equal sizes are taken by document key, so the result is the same on every run;
copies are packed each; an empty table or no limits give an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.shared import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_TOKENS, SHARD_CONTAINERS, WINDOW = 4_000_000, 200, 64

@lru_cache(1)
def encoder(path: str):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).open("rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Each text's length in tokens. The vocabulary file is sent to the executors, so it need only be where the driver is."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sizes(Path(tokenizer).name), "doc_id long, n_tokens long").where("n_tokens > 0")


def best_fill(window: list[tuple[int, int]], room: int) -> tuple[int, dict[int, int]]:
    """The largest reachable total up to ``room`` from (length, count) pairs, and how many of each length it takes."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length, count in window:
        if length > room:
            continue
        k, left = 1, min(count, room // length)
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    at, taken = total, defaultdict(int)
    for length, take, before in reversed(steps):
        if before >> at & 1:
            continue
        taken[length] += take
        at -= length * take
    return total, dict(taken)


def fill(lengths: dict[int, int], capacity: int, window: int = WINDOW) -> Iterator[dict[int, int]]:
    """Containers as counts of each length, until nothing is left. ``lengths``: how many items have each length, none above capacity."""
    left = dict(lengths)
    order = sorted(left, reverse=True)
    while order:
        first = order[0]
        room = capacity - first
        left[first] -= 1
        fits = [x for x in order if x <= room and left[x] > 0]
        # A window of the longest that fit, and of short ones for the last tokens.
        part = fits if len(fits) <= window else fits[: window // 2] + fits[-(window - window // 2) :]
        _, taken = best_fill([(x, left[x]) for x in part], room) if part else (0, {})
        for x, n in taken.items():
            left[x] -= n
        taken[first] = taken.get(first, 0) + 1
        order = [x for x in order if left[x] > 0]
        yield taken


def pack_shard(items: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """One shard: doc_id, n_tokens in; doc_id, part, container, slot, start_token, n_tokens out. Containers count from 0."""
    items = items.sort_values(["n_tokens", "doc_id"])
    by_length: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rows, container = [], 0
    for doc, n in zip(items["doc_id"].tolist(), items["n_tokens"].tolist()):
        full, rest = divmod(n, capacity)
        for p in range(full):
            rows.append((doc, p, container, 0, p * capacity, capacity))
            container += 1
        if rest:
            by_length[rest].append((doc, full, full * capacity))
    for taken in fill({k: len(v) for k, v in by_length.items()}, capacity):
        slot = 0
        for length in sorted(taken, reverse=True):
            for _ in range(taken[length]):
                doc, part, start = by_length[length].pop()
                rows.append((doc, part, container, slot, start, length))
                slot += 1
        container += 1
    return pd.DataFrame(rows, columns=["doc_id", "part", "container", "slot", "start_token", "n_tokens"])


def pack(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """``sizes``: doc_id, n_tokens. One row for each text (or part) and limit: its container and place in it."""
    caps = [(r["limit_id"], r["capacity_tokens"]) for r in limits.where("capacity_tokens > 0").select("limit_id", "capacity_tokens").toArrow().to_pylist()]
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    plan = [(i, c, max(1, round(total / max(SHARD_TOKENS, SHARD_CONTAINERS * c)))) for i, c in caps]
    shards = F.array(*[F.struct(F.lit(i).alias("limit_id"), F.lit(c).alias("capacity"), F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(n)).alias("shard")) for i, c, n in plan])
    schema = "limit_id int, shard long, doc_id long, part long, container long, slot long, start_token long, n_tokens long"
    if not plan:
        return sizes.sparkSession.createDataFrame([], schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        out = pack_shard(pdf[["doc_id", "n_tokens"]], int(first["capacity"]))
        out.insert(0, "shard", first["shard"])
        out.insert(0, "limit_id", np.int32(first["limit_id"]))
        return out

    each = sizes.select("doc_id", "n_tokens", F.explode(shards).alias("s")).select("doc_id", "n_tokens", "s.*")
    return each.groupBy("limit_id", "shard").applyInPandas(run, schema)


def packed(spark: SparkSession, sf: str, tokenizer: str = TOKENIZER) -> DataFrame:
    docs, limits = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pack_limits"))
    return pack(written(token_counts(docs, tokenizer), "sizes"), limits)


def utilisation(spark: SparkSession, sf: str) -> DataFrame:
    """For every limit: containers, tokens, and the share of room that is used."""
    limits = spark.read.parquet(f"{sf}/pack_limits.parquet")
    out = packed(spark, sf).groupBy("limit_id").agg(F.count_distinct("shard", "container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return out.join(limits.select("limit_id", "capacity_tokens"), "limit_id").select("limit_id", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("used_share"))
