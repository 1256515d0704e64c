"""Character similarity of pairs; Python, so only for pairs that cheaper tests leave."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidewire.functions import text


def close(a: str, b: str, least: float) -> bool:
    """Whether the sequence ratio of ``a`` and ``b``, in this order, reaches ``least``; the cheap upper bounds come first."""
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


def ratio_at_least(a: Column, b: Column, least: float) -> Column:
    """``close`` for columns; null in either gives false without work."""

    @F.pandas_udf(BooleanType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([p is not None and q is not None and close(p, q, least) for p, q in zip(x, y)], dtype=bool)

    return run(a, b)


def grams(c: Column, n: int = 3) -> Column:
    """The distinct runs of ``n`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (n - 1))), lambda i: F.substring(c, i, F.lit(n))))


def may_be_close(a: Column, b: Column, grams_a: Column, grams_b: Column, least: float) -> Column:
    """False only where the ratio cannot reach ``least``: by length, and by the trigrams that so few changes can destroy."""
    changes = F.floor((F.length(a) + F.length(b)) * F.lit(1 - least) + 1e-9)
    return (2 * F.least(F.length(a), F.length(b)) >= F.lit(least) * (F.length(a) + F.length(b))) & (F.size(F.array_intersect(grams_a, grams_b)) >= F.size(grams_a) - 3 * changes)


def syndicated(desc_a: Column, desc_b: Column, wire: Column, title_a: Column, title_b: Column) -> Column:
    """Whether two descriptions are one text that was passed on; with a wire service behind either, equal titles tell too."""
    clean = lambda c: F.lower(c)
    long = (F.length(desc_a) >= 80) & (F.length(desc_b) >= 80)
    by_text = ratio_at_least(F.when(long, F.substring(clean(desc_a), 1, 700)), F.when(long, F.substring(clean(desc_b), 1, 700)), 0.88)
    na, nb = text.normalized_title(title_a), text.normalized_title(title_b)
    titled = wire & (F.least(F.length(na), F.length(nb)) >= 24)
    return by_text | ratio_at_least(F.when(titled, na), F.when(titled, nb), 0.94)
