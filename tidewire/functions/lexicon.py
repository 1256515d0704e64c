"""Which of many words occur in a text, found in one scan."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = re.compile("[㐀-鿿]")


def trie(words: set[str]) -> str:
    """A pattern for any of the words that shares their beginnings and tries the longest first."""
    by_first: dict[str, set[str]] = {}
    for w in words - {""}:
        by_first.setdefault(w[0], set()).add(w[1:])
    if not by_first:
        return ""
    body = "|".join(("\\" + c if re.match(r"[^\w\s]", c) else c) + trie(rest) for c, rest in sorted(by_first.items()))
    return f"(?:{body})?" if "" in words else f"(?:{body})" if len(by_first) > 1 else body


def _within(words: set[str], whole: bool) -> dict[str, list[str]]:
    """For each word the other ones with which it begins; ``whole``: only up to a boundary."""
    starts = lambda w, v: v != w and w.startswith(v) and not (whole and re.match("[a-z0-9]", w[len(v)]))
    return {w: found for w in words if (found := sorted(v for v in words if starts(w, v)))}


def occurring(text: Column, words: tuple[str, ...]) -> Column:
    """The distinct ``words`` (lower case) in lower-cased ``text``: Han words anywhere, others between characters that are no letters or digits.

    Every place is looked at without moving on, so words inside or across others are seen; at one place the longest is
    taken, and the words it begins with are added.
    """
    plain = {w.strip() for w in words} - {""}
    han = {w for w in plain if HAN.search(w)}
    latin = plain - han
    parts = []
    if latin:
        parts.append(F.regexp_extract_all(text, F.lit(f"(?<![a-z0-9])(?=({trie(latin)})(?![a-z0-9]))"), 1))
    if han:
        parts.append(F.regexp_extract_all(text, F.lit(f"(?=({trie(han)}))"), 1))
    found = F.concat(*parts) if parts else F.array().cast("array<string>")
    within = _within(latin, True) | _within(han, False)
    if within:
        more = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in within.items() for x in pair))
        none = F.array().cast("array<string>")
        found = F.concat(found, F.flatten(F.transform(F.filter(found, lambda w: F.map_contains_key(more, w)), lambda w: F.coalesce(F.try_element_at(more, w), none))))
    return F.array_distinct(found)


def among(found: Column, words: tuple[str, ...]) -> Column:
    """Those of ``words`` that are in the array ``found``, in the order of ``words``."""
    return F.array_intersect(F.array(*map(F.lit, dict.fromkeys(words))), found)
