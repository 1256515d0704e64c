"""Token sets of whole batches of texts, computed with array operations.

A token is a lower-cased run of letters or digits; a run of Han characters
counts as its pairs of adjacent characters (a single Han character has none).
Tokens stand as hashes. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

OTHER, WORD, HAN = 0, 1, 2
#: Characters handled at once; keeps the arrays of a batch small.
CHUNK_CHARS = 1_500_000
#: Ranges of the Han script: marks, extension A, unified, compatibility, supplements.
HAN_RANGES = ((0x3005, 0x3005), (0x3007, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
_MULT = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    table = np.fromiter((chr(i).isalnum() for i in range(0x110000)), np.uint8, 0x110000)
    for lo, hi in HAN_RANGES:
        table[lo : hi + 1] = HAN
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(8)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _MULT, np.uint64))


def chunks(lengths: np.ndarray, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Spans of rows whose texts have at most ``limit`` characters together (or one row)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts, each text ended by a line feed, and the texts' first positions."""
    arr = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return arr, np.concatenate([[0], np.cumsum(lens)[:-1]])


def word_hashes(arr: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every run of ``is_word``."""
    edge = np.diff(np.concatenate([[0], is_word.view(np.int8), [0]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    runs = ends - starts
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    place = np.arange(int(runs.sum())) - np.repeat(first, runs)
    power = _powers(1 << int(max(6, int(runs.max()).bit_length())))
    values = (arr[is_word].astype(np.uint64) + np.uint64(7)) * power[place]
    return starts, ends, mix(np.add.reduceat(values, first) + runs.astype(np.uint64))


def token_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' distinct tokens as sorted 32-bit hashes, one after another, and offsets of len(texts) + 1."""
    low = [t.lower() if t else "" for t in texts]
    parts, counts = [np.zeros(0, np.uint32)], np.zeros(len(low), np.int64)
    for a, b in chunks(np.fromiter(map(len, low), np.int64, len(low))):
        arr, first = codes(low[a:b])
        cls = char_classes()[arr]
        starts, _, words = word_hashes(arr, cls == WORD)
        han = cls == HAN
        pairs = np.flatnonzero(han[:-1] & han[1:])
        both = mix((arr[pairs].astype(np.uint64) << np.uint64(32)) | arr[pairs + 1].astype(np.uint64))
        rows = np.concatenate([np.searchsorted(first, starts, "right"), np.searchsorted(first, pairs, "right")]) - 1
        key = (rows.astype(np.uint64) << np.uint64(32)) | (np.concatenate([words, both]) >> np.uint64(32))
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        counts[a:b] = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=b - a)
        parts.append(key.astype(np.uint32))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums between offsets; empty segments give 0. Wraps like the type does."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[offsets[1:]] - total[offsets[:-1]]


def segment_min(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minima between offsets, of which none may be empty."""
    return np.minimum.reduceat(values, offsets[:-1])


def bands_of_part(bands: np.ndarray, part: int, parts: int) -> np.ndarray:
    return np.maximum(0, bands - part + parts - 1) // parts


def band_keys(tokens: np.ndarray, offsets: np.ndarray, bands: np.ndarray, rows: int, seed: int = 11, part: int = 0, parts: int = 1) -> np.ndarray:
    """64-bit keys of bands of ``rows`` minwise values, by multiply-shift in 32 bits; set by set, so many of each as ``bands`` says.

    The band is part of the key, and a set with fewer bands has the first ones. Of these, every ``parts``-th from ``part`` on
    is made: ``bands_of_part`` of each set. No set may be empty.
    """
    most = int(bands.max(initial=0))
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 2**32, (most, rows), dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, (most, rows), dtype=np.uint32)
    made = bands_of_part(bands, part, parts)
    out = np.empty(int(made.sum()), np.uint64)
    first = np.concatenate([[0], np.cumsum(made)[:-1]])
    use, base, at = np.arange(len(bands)), tokens.astype(np.uint32), offsets
    for i, b in enumerate(range(part, most, parts)):
        if not (bands[use] > b).all():  # the sets that still want a band
            left = bands[use] > b
            base = base[np.repeat(left, np.diff(at))]
            at = np.concatenate([[0], np.cumsum(np.diff(at)[left])])
            use = use[left]
        key = np.full(len(use), b + 1, np.uint64) * _MULT
        for r in range(rows):
            h = base * mult[b, r] + add[b, r]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            key = mix(key + segment_min(h, at).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out[first[use] + i] = key
    return out


def pair_jaccard(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Exact shares of common tokens for pairs of sets, each sorted and distinct."""
    la, lb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    if not len(a):
        return np.zeros(0)
    rows = np.repeat(np.concatenate([np.arange(len(a)), np.arange(len(b))]).astype(np.uint64), np.concatenate([la, lb]))
    key = (rows << np.uint64(32)) | np.concatenate([*a, *b]).astype(np.uint64)
    key.sort()
    same = key[1:][key[1:] == key[:-1]]
    common = np.bincount((same >> np.uint64(32)).astype(np.int64), minlength=len(a))
    return common / np.maximum(1, la + lb - common)
