"""Cleaning, tokens, lexicon matches. All built-in expressions but entity decoding."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewire.config import CATEGORIES, DENIAL_MARKERS, HISTORY_STOPWORDS, TITLE_ALIASES, TITLE_STOPWORDS


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Character entities decoded once; only texts with an ampersand are touched."""
    has = s.str.contains("&", regex=False, na=False)
    if not has.any():
        return s
    out = s.copy()
    out[has] = [html.unescape(x) for x in s[has]]
    return out


def squeeze(c: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clip(c: Column, limit: int) -> Column:
    """At most ``limit`` characters; a cut text loses trailing stops and ends in an ellipsis."""
    cut = F.concat(F.regexp_replace(F.substring(c, 1, limit - 1), r"[ ,.;，。；]+$", ""), F.lit("…"))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def clean_text(c: Column, limit: int = 0) -> Column:
    """Decoded, without scripts, styles, tags, double blanks and the usual feed footer; null as empty."""
    x = unescape(F.coalesce(c, F.lit("")))
    x = F.regexp_replace(x, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", " ")
    x = squeeze(F.regexp_replace(x, r"<[^>]+>", " "))
    x = F.regexp_replace(x, r"(?i)\s*The post .* appeared first on .*$", "")
    return clip(x, limit) if limit else x


def normalized_title(c: Column) -> Column:
    """Lower case, only Latin letters, digits and common Han characters."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "")


def _strings(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def title_tokens(c: Column) -> Column:
    """Distinct tokens of a title: Latin words and Han runs of two and more, lower-cased, aliased, without stop words."""
    raw = F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z][A-Za-z0-9-]*|[\x{3400}-\x{9fff}]{2,})"), 1), F.lower)
    alias = F.create_map(*(F.lit(x) for pair in TITLE_ALIASES.items() for x in pair))
    kept = F.array_except(raw, _strings(TITLE_STOPWORDS))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda t: F.coalesce(F.try_element_at(alias, t), t))))


def acronyms(c: Column) -> Column:
    """Tokens of three and more capitals, digits and hyphens, lower-cased."""
    raw = F.regexp_extract_all(c, F.lit(r"([A-Za-z][A-Za-z0-9-]*)"), 1)
    return F.array_sort(F.array_distinct(F.transform(F.filter(raw, lambda t: t.rlike("^[A-Z][A-Z0-9-]{2,}$")), F.lower)))


def history_tokens(c: Column) -> Column:
    """Tokens of mixed text: Latin words of three letters and more, numbers, short Han runs whole and all Han pairs."""
    low = F.lower(c)
    stop = _strings(HISTORY_STOPWORDS)
    latin = F.array_except(F.regexp_extract_all(low, F.lit(r"([a-z][a-z0-9-]{2,}|\d+(?:\.\d+)?)"), 1), stop)
    runs = F.array_except(F.regexp_extract_all(low, F.lit(r"([\x{3400}-\x{9fff}]{2,})"), 1), stop)
    short = F.filter(runs, lambda r: F.length(r) <= 4)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_sort(F.array_distinct(F.concat(latin, short, pairs)))


def overlap(shared: Column, na: Column, nb: Column) -> Column:
    """Shared tokens as a share of the smaller set."""
    return F.when((na > 0) & (nb > 0), shared / F.least(na, nb)).otherwise(F.lit(0.0))


def keyword_matches(text: Column, word: str) -> Column:
    """``word`` in lower-cased ``text``: Han words anywhere, others between characters that are no letters or digits."""
    if not word.strip():
        return F.lit(False)
    if any("㐀" <= ch <= "鿿" for ch in word):
        return F.contains(text, F.lit(word))
    return text.rlike(rf"(?<![a-z0-9])\Q{word}\E(?![a-z0-9])")


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur."""
    return sum((keyword_matches(text, w).cast("int") for w in words), F.lit(0))


def hit_words(text: Column, words: tuple[str, ...]) -> Column:
    """The words that occur, in the order given."""
    return F.array_compact(F.array(*(F.when(keyword_matches(text, w), F.lit(w)) for w in words)))


def denial(text: Column) -> Column:
    """Whether a mark of denial stands anywhere in the lower-cased text."""
    return F.lower(text).rlike("|".join(rf"\Q{w}\E" for w in DENIAL_MARKERS))


def category_hits(text: Column) -> list[tuple[str, Column]]:
    return [(name, hits(text, words)) for name, (_, words) in CATEGORIES.items()]
