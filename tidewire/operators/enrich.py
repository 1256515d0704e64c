"""Model operators: a model may score or word rows, and never makes, drops or links them.

A request takes a batch of rows and answers by their place; what it answers is checked before it is used. The default
scorer is deterministic and needs no network, so all of this runs and is tested offline.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Request = Callable[[list[dict]], dict[str, dict]]


def parse_object(value: str) -> dict:
    """The one JSON object of an answer, with or without a fence around it."""
    inner = re.fullmatch(r"\s*```(?:json)?\s*(.*?)\s*```\s*", value, re.S | re.I)
    found = json.loads(inner[1] if inner else value)
    if not isinstance(found, dict):
        raise ValueError("an answer must be one JSON object")
    return found


def place(value: object, most: int) -> int | None:
    """A place from 1 to ``most``, or none: no truth values, no fractions."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return None
    try:
        n = float(value)
    except ValueError:
        return None
    return int(n) if n == int(n) and 1 <= n <= most else None


def answered(batch: list[dict], answer: dict) -> dict[str, dict]:
    """The records of an answer (``items``, each with its ``index``) by the ids of the batch; wrong and second places are left out."""
    out: dict[str, dict] = {}
    for record in answer.get("items", []) if isinstance(answer.get("items"), list) else []:
        at = place(record.get("index"), len(batch)) if isinstance(record, dict) else None
        if at and batch[at - 1]["id"] not in out:
            out[batch[at - 1]["id"]] = record
    return out


def in_batches(rows: list[dict], request: Request, size: int = 5, rounds: int = 2, failures: int = 2) -> tuple[dict[str, dict], dict]:
    """Answers by id, and what happened.

    Rows without an answer are asked for again, in two halves each time, ``rounds`` deep; after ``failures`` requests in a
    row that bring nothing no more are made. A stack of batches still to ask keeps the order of halves.
    """
    done: dict[str, dict] = {}
    stats = {"requested": len(rows), "requests": 0, "retries": 0, "errors": 0, "empty": 0}
    in_a_row = 0
    waiting = [(rows[i : i + size], 0) for i in range(0, len(rows), size)][::-1]
    while waiting and in_a_row < failures:
        batch, depth = waiting.pop()
        stats["requests"] += 1
        stats["retries"] += depth > 0
        try:
            got = {k: v for k, v in request(batch).items() if k in {r["id"] for r in batch}}
            stats["empty"] += not got
        except Exception:  # noqa: BLE001  (whatever a provider raises counts as a failure)
            got = {}
            stats["errors"] += 1
        in_a_row = 0 if got else in_a_row + 1
        done |= got
        left = [r for r in batch if r["id"] not in got]
        if left and depth < rounds:
            half = (len(left) + 1) // 2
            waiting += [(part, depth + 1) for part in (left[half:], left[:half]) if part]
    missing = stats["requested"] - len(done)
    reason = "not_needed" if not rows else "provider_circuit_breaker" if missing and in_a_row >= failures else "partial_after_retry" if missing else "complete_after_retry" if stats["retries"] else "complete_first_pass"
    return done, stats | {"completed": len(done), "missing": missing, "reason": reason}


def rule_scorer(batch: list[dict]) -> dict[str, dict]:
    """A stand-in for a model: by length of text and words in capitals, always the same."""
    return {r["id"]: {"score": min(100, 40 + len(r["text"].split()) % 31 + 5 * len(re.findall(r"\b[A-Z]{2,}\b", r["text"])))} for r in batch}


def model_scores(rows: DataFrame, request: Request = rule_scorer, size: int = 5, rounds: int = 2) -> DataFrame:
    """``rows``: id, text. One row for each with model_score (null where no answer came); batches are made within a partition, so a task asks for its own rows only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found, _ = in_batches(f.to_dict("records"), request, size, rounds)
            yield pd.DataFrame({"id": f["id"], "model_score": pd.array([found.get(i, {}).get("score") for i in f["id"]], dtype="Int32")})

    return rows.select(F.col("id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "id string, model_score int")


def batch_counts(rows: DataFrame) -> DataFrame:
    """How complete an enrichment is: asked for, answered, missing."""
    return rows.agg(F.count("*").alias("requested"), F.count("model_score").alias("completed"), F.count_if(F.col("model_score").isNull()).alias("missing"))


def untranslated(rows: DataFrame, done: DataFrame) -> DataFrame:
    """What has not been worded yet."""
    return rows.join(done.select("id").distinct(), "id", "left_anti")


def reusable(previous: DataFrame, current: DataFrame, provider: str, model: str) -> DataFrame:
    """``previous``: id, title, summary, original_title, provider, model. What an earlier run worded and still holds: the same provider and model, an unchanged original title."""
    kept = previous.where((F.col("provider") == provider) & (F.col("model") == model) & (F.trim("title") != "") & (F.trim("summary") != ""))
    now = current.select("id", F.col("title").alias("now_title"))
    return kept.join(now, "id").where(F.col("original_title") == F.col("now_title")).drop("now_title")


def merged_featured(stream: DataFrame, daily: DataFrame, fields: tuple[str, ...], worded: tuple[str, ...]) -> DataFrame:
    """Stream items with what the daily report says of them: ``fields`` always, ``worded`` only where the report's wording is a
    translation or the stream's is none; and whether they are in the report."""
    d = daily.select("id", F.lit(True).alias("top"), F.col("provider").alias("d_provider"), *(F.col(c).alias(f"d_{c}") for c in (*fields, *worded)))
    m = stream.join(d, "id", "left")
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    take = F.col("top").isNotNull() & (some("d_provider") | ~some("provider"))
    own = [c for c in stream.columns if c not in (*fields, *worded)]
    pick = lambda when, c: F.when(when, F.col(f"d_{c}")).otherwise(F.col(c)).alias(c)
    return m.select(*own, *(pick(F.col("top").isNotNull(), c) for c in fields), *(pick(take, c) for c in worded), F.coalesce("top", F.lit(False)).alias("is_top_story"))


def provider(settings: dict, keys: dict[str, str]) -> str | None:
    """Which provider to ask: the one named, else the first that has a key; none where nothing is set up."""
    wanted = str(settings.get("ai_provider", "auto")).lower()
    names = list(keys) if wanted == "auto" else [wanted] if wanted in keys else []
    return next((n for n in names if keys.get(n)), None)


def fused_order(score: Column, model: Column, rule: Column, published: Column, key: Column) -> list[Column]:
    return [F.desc(score), F.desc(F.coalesce(model, F.lit(-1))), F.desc(rule), F.desc_nulls_last(published), F.desc(key)]
