"""Problem 7: held-out passages inside documents, by greedy string tiling.

Passages and texts become streams of units: words (runs of letters or digits)
for most items, single characters for items in Chinese. Karp-Rabin hashes of
every window of a passage are held against those of every window of a text;
equal windows are the seeds. Seeds on one diagonal join into maximal matches,
and the longest match that overlaps nothing marked yet is marked until none of
the least length is left. A document holds an item when a marked match has the
least length; the share of the passage that is marked tells reordered passages.

Case, punctuation, markup, entities, blanks, line layout and invisible
characters are ignored; hyphens part words; apostrophes inside a word vanish.

The items are a stated query set, taken in blocks of bounded size; each block
makes one pass over all documents, without a shuffle. Defined results: null and
empty texts and passages, and passages shorter than the least match, give
nothing; copies of a document or item each count; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import textops as X

WORDS, CHARS = 12, 20
BLOCK_ITEMS = 5_000
INLINE_TAG = re.compile(r"</?(?:b|i|u|em|strong|span|a|mark|small|sub|sup|font)(?:\s[^<>]*)?/?>", re.I)
TAG = re.compile(r"<(?:!--.*?--|[/!?]?[a-zA-Z][^<>]*)>", re.S)
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
APOSTROPHE = re.compile(r"(?<=\w)['’ʼ](?=\w)")
WIDE = {i: i - 0xFEE0 for i in range(0xFF01, 0xFF5F)}


def plain(text: str | None) -> str:
    """Lower-cased, without markup, entities, invisible characters and wide forms."""
    if not text:
        return ""
    for _ in range(2):  # markup may stand behind entities
        if "<" in text:
            text = TAG.sub(" ", INLINE_TAG.sub("", text))
        if "&" not in text:
            break
        text = html.unescape(text)
    if not text.isascii():
        text = INVISIBLE.sub("", text).translate(WIDE)
    if "'" in text or "’" in text or "ʼ" in text:
        text = APOSTROPHE.sub("", text)
    return text.lower()


#: The base of the rolling hash, and its inverse, as powers.
BASE = 0x9E3779B97F4A7C15


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _windows(values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` units within one row, and their first units.

    Rolled: with running sums of the units over falling powers of the base, each window's polynomial is the difference of
    two sums, raised to its place; the work does not depend on the window's length.
    """
    if len(values) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(values) - n + 1
    size = 1 << len(values).bit_length()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(pow(BASE, -1, 1 << 64), size)[: len(values)], dtype=np.uint64)])
    total = (sums[n:] - sums[:m]) * _powers(BASE, size)[n - 1 : n - 1 + m]
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return X.mix(total[at]), at


def units(texts: list[str], chars: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashed units of all texts in order, and each unit's text."""
    arr, first = X.codes(texts)
    cls = X.char_classes()[arr]
    if chars:
        at = np.flatnonzero(cls != X.OTHER)
        return X.mix(arr[at]), np.searchsorted(first, at, "right") - 1
    starts, _, words = X.word_hashes(arr, cls == X.WORD)
    return words, np.searchsorted(first, starts, "right") - 1


class Index:
    """The windows of a block of items, for one kind of unit."""

    def __init__(self, ids: list[int], passages: list[str], chars: bool, least: int):
        self.ids, self.chars, self.least = ids, chars, least
        self.units, rows = units(passages, chars) if passages else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.first = np.searchsorted(rows, np.arange(len(ids) + 1))
        hashes, at = _windows(self.units, rows, least)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.item = hashes[order], at[order], rows[at[order]]

    def seeds(self, texts: list[str]) -> Iterator[tuple[int, int, list[tuple[int, int]], np.ndarray]]:
        """For every text and item with equal windows: text, item, pairs of first units (in text, in item), all units."""
        values, rows = units(texts, self.chars)
        hashes, at = _windows(values, rows, self.least)
        if not len(hashes) or not len(self.hashes):
            return
        lo = np.searchsorted(self.hashes, hashes, "left")
        hit = np.flatnonzero(self.hashes[np.minimum(lo, len(self.hashes) - 1)] == hashes)
        found = defaultdict(list)
        hi = np.searchsorted(self.hashes, hashes[hit], "right")
        for w, a, b in zip(at[hit].tolist(), lo[hit].tolist(), hi.tolist()):
            for k in range(a, b):
                found[int(rows[w]), int(self.item[k])].append((w, int(self.at[k])))
        for (row, item), pairs in found.items():
            yield row, item, pairs, values


def tiles(pairs: list[tuple[int, int]], least: int, text: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
    """The marked matches (first unit in text, in item, length): longest first, nothing marked twice."""
    runs: list[list[int]] = []
    for w, k in sorted(pairs, key=lambda p: (p[0] - p[1], p[0])):
        if runs and w - k == runs[-1][0] - runs[-1][1] and w <= runs[-1][0] + runs[-1][2]:
            runs[-1][2] = w - runs[-1][0] + least
        else:
            runs.append([w, k, least])
    done_text, done_item, out = set(), set(), []
    queue = [tuple(r) for r in runs if np.array_equal(text[r[0] : r[0] + r[2]], item[r[1] : r[1] + r[2]])]
    while queue:
        queue.sort(key=lambda r: (-r[2], r[0], r[1]))
        w, k, n = queue.pop(0)
        free = [w + i not in done_text and k + i not in done_item for i in range(n)]
        if all(free):
            done_text.update(range(w, w + n))
            done_item.update(range(k, k + n))
            out.append((w, k, n))
            continue
        start = None
        for i in range(n + 1):
            if i < n and free[i]:
                start = i if start is None else start
            elif start is not None:
                if i - start >= least:
                    queue.append((w + start, k + start, i - start))
                start = None
    return out


def _tiled(indexes: list[Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, out = b.column(0).to_pylist(), []
            texts = [plain(t) for t in b.column(1).to_pylist()]
            for lo, hi in X.chunks(np.fromiter(map(len, texts), np.int64, len(texts))):
                part = texts[lo:hi]
                for ix in indexes:
                    if ix.chars and all(t.isascii() for t in part):
                        continue
                    for row, item, pairs, values in ix.seeds(part):
                        marked = tiles(pairs, ix.least, values, ix.units)
                        if marked:
                            size = int(ix.first[item + 1] - ix.first[item])
                            out.append((docs[lo + row], ix.ids[item], len(marked), max(t[2] for t in marked), sum(t[2] for t in marked), size))
            names = ["doc_id", "item_id", "n_tiles", "longest", "marked", "item_units"]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(names)})

    return run


def is_chinese(lang: str | None, passage: str) -> bool:
    if lang and lang.strip():
        return lang.strip().lower().startswith("zh")
    cls = X.char_classes()[np.frombuffer(passage.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return (cls == X.HAN).sum() * 2 > (cls != X.OTHER).sum()


def tiled(docs: DataFrame, items: DataFrame, words: int = WORDS, chars: int = CHARS, block: int = BLOCK_ITEMS) -> DataFrame:
    """One row for each document and item with a marked match: their number, the longest, all marked units, the item's units."""
    source, out = docs.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL"), None
    blocks = max(1, -(-items.count() // block))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select("item_id", "lang", "passage").toArrow().to_pylist()
        kinds: dict[bool, tuple[list[int], list[str]]] = {False: ([], []), True: ([], [])}
        for r in part:
            p = plain(r["passage"])
            ids, passages = kinds[is_chinese(r["lang"], p)]
            ids.append(r["item_id"])
            passages.append(p)
        indexes = [Index(*kinds[c], c, chars if c else words) for c in (False, True)]
        made = source.mapInArrow(_tiled(indexes), "doc_id long, item_id long, n_tiles long, longest long, marked long, item_units long")
        out = made if out is None else out.union(made)
    return out


def found(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "eval_items"))
    return tiled(docs, items).select("doc_id", "item_id")


#: For passages in another order: shorter matches, and the share of the passage that they must cover.
SHORT_WORDS, SHORT_CHARS, COVERED = 5, 8, 0.5


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold at least half of a passage in shorter pieces, in any order, with the share covered."""
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "eval_items"))
    t = tiled(docs, items, SHORT_WORDS, SHORT_CHARS)
    return t.where(F.col("marked") >= F.col("item_units") * COVERED).select("doc_id", "item_id", "n_tiles", "longest", (F.col("marked") / F.col("item_units")).alias("covered"))
