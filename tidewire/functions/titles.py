"""Pairs of titles that tell of one event, among rows that a task has in memory.

Tokens: two titles that count share three tokens at least. If the rarest of these is in at most ``RARE`` rows here, they
meet on it, else all that they share is frequent, and they meet on the two rarest of it. Characters: the counts of the
characters, each up to eight, stand as bits, of which an unmatched character changes one at most; and parities of bigrams,
of which it changes three at most. No test, nor the bound of shared tokens by parities, loses a pair; what they leave is
decided exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidewire.config import TITLE_ALIASES, TITLE_STOPWORDS
from tidewire.functions import similarity

RARE, WORDS = 32, 4
#: Keys that more rows have than this are paired block by block of so many cells.
SHORT, CELLS = 48, 1 << 20
#: Slots for character counts, frequent letters first; what is not here falls on one of them.
SLOTS = 32
_LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
_STOP = frozenset(TITLE_STOPWORDS)
_RAW, _NORM, _ACRONYM = re.compile("[A-Za-z][A-Za-z0-9-]*|[㐀-鿿]{2,}"), re.compile("[^a-z0-9一-鿿]+"), re.compile("[A-Z][A-Z0-9-]{2,}")
_SLOT = np.arange(1 << 16, dtype=np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(27)
_SLOT[[ord(c) for c in _LETTERS]] = range(26)
_SLOT[ord("0") : ord("9") + 1] = 26 + np.arange(10) % 6


def norm_of(title: str) -> str:
    """``text.normalized_title``."""
    return _NORM.sub("", title.lower())


def tokens_of(title: str) -> dict[str, bool]:
    """``text.title_tokens``, and of each whether ``text.acronyms`` has it."""
    raw = _RAW.findall(title)
    caps = {t.lower() for t in raw if t.isupper() and _ACRONYM.fullmatch(t)}
    return {t: t in caps for t in [TITLE_ALIASES.get(t, t) for t in map(str.lower, raw) if t not in _STOP]}


def tell(n: np.ndarray, least: np.ndarray, acronym: np.ndarray) -> np.ndarray:
    """``linkage.tokens_tell`` for numbers: shared tokens, tokens of the smaller title, and whether an acronym is shared."""
    share = n / np.maximum(1, least)
    return ((n >= 4) & (share >= 0.5)) | ((n >= 3) & (share >= 0.35) & acronym)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class Titles:
    """Rows of one task. ``left`` and ``right`` mark what is held against what (both everywhere: all against all)."""

    def __init__(self, row: np.ndarray, at: np.ndarray, guest: np.ndarray, side: np.ndarray, titles: list[str], hours: int):
        self.row, self.at, self.guest, self.side, self.titles = row, at, guest, side, titles
        self.most = hours * 3_600_000_000
        self.norm = [norm_of(t) for t in titles]

    def allowed(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Near in time, not both guests, and of two sides if there are two."""
        return (np.abs(self.at[i] - self.at[j]) <= self.most) & ~(self.guest[i] & self.guest[j]) & ((self.side[i] != self.side[j]) | (self.side[i] < 0)) & (self.row[i] != self.row[j])

    def runs(self, own: np.ndarray, key: np.ndarray, ok) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows with one key that ``ok`` leaves; a pair with several keys comes as often."""
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(key)))

        def left(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            use = self.allowed(i, j)
            i, j = i[use], j[use]
            use = ok(i, j)
            return i[use], j[use]

        at, d = np.flatnonzero(np.repeat((sizes <= SHORT) & (sizes > 1), sizes)), 0
        while len(at):
            d += 1
            at = at[at + d < len(key)]
            at = at[key[at + d] == key[at]]
            yield left(own[at], own[at + d])
        for s, m in zip(starts[sizes > SHORT], sizes[sizes > SHORT], strict=True):
            step = max(1, CELLS // int(m))
            for a in range(s, s + m, step):
                rows, later = np.arange(a, min(a + step, s + m)), np.arange(a + 1, s + m)
                i, j = np.nonzero(rows[:, None] < later)
                yield left(own[rows[i]], own[later[j]])

    def codes(self, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Each pair once, as one number."""
        n = len(self.row)
        found = [np.unique(np.minimum(i, j) * n + np.maximum(i, j)) for i, j in pairs if len(i)]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def equal(self) -> np.ndarray:
        names: dict[str, int] = {}
        key = np.array([names.setdefault(t, len(names)) for t in self.norm], np.int64)
        return self.codes(self.runs(np.arange(len(key)), key, lambda i, j: np.ones(len(i), bool)))

    def by_tokens(self) -> np.ndarray:
        names: dict[str, int] = {}
        each = [tokens_of(t) for t in self.titles]
        size = np.array([len(t) for t in each], np.int64)
        ids = np.array([names.setdefault(t, len(names)) for row in each for t in row], np.int64)
        caps = np.array([c for row in each for c in row.values()], bool)
        own = np.repeat(np.arange(len(size)), size)
        df = np.bincount(ids, minlength=1)
        by = np.lexsort((ids, df[ids], own))  # rare tokens first, in one order for all
        ids, caps = ids[by], caps[by]
        first = np.cumsum(size) - size
        place = np.arange(len(ids)) - first[own]
        # 256 parities: sets that share n differ in as many tokens as both have less 2 n, and in no more parities.
        bits = np.bincount(own * 256 + ids % 256, minlength=len(size) * 256).reshape(len(size), 256) & 1
        sig = np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)
        shouts = np.bincount(own, weights=caps, minlength=len(size)) > 0

        def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            differ = sum(differing(sig[i, w], sig[j, w]) for w in range(WORDS))
            return tell((size[i] + size[j] - differ) // 2, np.minimum(size[i], size[j]), shouts[i] & shouts[j])

        rare = (df[ids] <= RARE) & (df[ids] > 1) & (place < size[own] - 2)
        often = np.flatnonzero(df[ids] > RARE)  # stands behind what is rare, so it is one run of each row
        left, right, at, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], often, 0
        while len(at):
            d += 1
            at = at[place[at] + d < size[own[at]] - 1]
            left.append(at)
            right.append(at + d)
        p, q = np.concatenate(left), np.concatenate(right)
        pairs = [*self.runs(own[rare], ids[rare], may), *self.runs(own[p], ids[p] * len(names) + ids[q], may)]
        i, j = np.divmod(self.codes(pairs), max(1, len(size)))
        sure, step = [np.zeros(0, bool)], max(1, CELLS // max(1, int(size.max(initial=0)) ** 2))
        for a in range(0, len(i), step):
            x, y = i[a : a + step], j[a : a + step]
            n, shared = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
            for k in range(int(size[x].max())):
                use = np.flatnonzero(size[x] > k)
                mine = first[x[use]] + k
                for m in range(int(size[y[use]].max(initial=0))):
                    inside = m < size[y[use]]
                    theirs = (first[y[use]] + m)[inside]
                    hit = ids[mine[inside]] == ids[theirs]
                    n[use[inside]] += hit
                    shared[use[inside]] |= hit & caps[mine[inside]] & caps[theirs]
            sure.append(tell(n, np.minimum(size[x], size[y]), shared))
        return (i * len(size) + j)[np.concatenate(sure)]

    def by_ratio(self, least: float, longer: int, known: np.ndarray) -> np.ndarray:
        """Pairs of long titles whose sequence ratio, the older first, reaches ``least``; of the ``known`` nothing is asked."""
        n = np.array([len(t) for t in self.norm], np.int64)
        long = np.flatnonzero(n > longer)
        long = long[np.argsort(n[long], kind="stable")]
        sig, grams = np.zeros((2, len(n), WORDS), np.uint64)
        sig[long], grams[long] = self.signatures(long, n[long])
        changes = lambda i, j: (n[i] + n[j]) * (1 - least) + 1e-9
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def tiles(a: np.ndarray, b: np.ndarray, itself: bool) -> None:
            """``a`` against ``b``, both sorted by length; both may differ in so many characters only."""
            step, width = 256, 1024
            low, high = (np.searchsorted(n[b], x, y) for x, y in ((np.ceil(n[a] * (least / (2 - least)) - 1e-9), "left"), (np.floor(n[a] * ((2 - least) / least) + 1e-9), "right")))
            for s in range(0, len(a), step):
                rows = a[s : s + step]
                last = s + len(rows) - 1
                x0, x1 = sig[rows, 0, None], sig[rows, 1, None]
                for c in range(s if itself else int(low[s]), int(high[last]), width):
                    cols = b[c : min(c + width, int(high[last]))]
                    near = np.bitwise_count(x0 ^ sig[cols, 0])
                    near += np.bitwise_count(x1 ^ sig[cols, 1])
                    i, j = np.divmod(np.flatnonzero(near <= int(changes(rows[-1], cols[-1]))), len(cols))
                    if itself:
                        ok = i + s < j + c
                        i, j = i[ok], j[ok]
                    i, j = rows[i], cols[j]
                    for words, of in ((sig, 1), (grams, 3)):
                        ok = sum(differing(words[i, w], words[j, w]) for w in range(WORDS)) <= of * np.floor(changes(i, j))
                        i, j = i[ok], j[ok]
                    ok = self.allowed(i, j)
                    found.append((i[ok], j[ok]))

        if (self.side >= 0).any():
            tiles(long[self.side[long] == 1], long[self.side[long] == 0], False)
        else:
            home = long[~self.guest[long]]
            tiles(home, home, True)
            tiles(home, long[self.guest[long]], False)
        codes = np.setdiff1d(self.codes(found), known, assume_unique=True)
        return codes[[self.close(*divmod(int(c), len(self.row)), least) for c in codes]] if len(codes) else codes

    def signatures(self, use: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows in ``use`` with lengths ``n`` the counts of characters, each up to eight as so many bits, and 256 parities of bigrams.

        An inserted or deleted character changes one bit of the first at most, and three of the second.
        """
        code = np.frombuffer("".join(self.norm[k] for k in use).encode("utf-16-le"), np.uint16)
        own = np.repeat(np.arange(len(use)), n)
        counts = np.bincount(own * SLOTS + _SLOT[code], minlength=len(use) * SLOTS).reshape(len(use), SLOTS)
        two = (code[:-1].astype(np.uint32) << np.uint32(16) | code[1:]) * np.uint32(0x9E3779B1) >> np.uint32(24)
        two = (own[:-1] * 256 + two)[own[:-1] == own[1:]]
        parities = np.bincount(two, minlength=len(use) * 256).reshape(len(use), 256) & 1
        return ((1 << np.minimum(counts, 8)) - 1).astype(np.uint8).view(np.uint64), np.packbits(parities.astype(np.uint8), axis=1).view(np.uint64)

    def close(self, i: int, j: int, least: float) -> bool:
        x, y = (i, j) if (self.at[i], -self.row[i]) < (self.at[j], -self.row[j]) else (j, i)
        a, b = self.norm[x], self.norm[y]
        return a == b or similarity.close(a, b, least)


def pairs_of_tasks(hours: int, words: bool, ratio: tuple[float, int] | None):
    """Rows arrive sorted by task (bucket, i, j), with guest, left, row, at and title; pairs by words, by ratio (least, longer than), or either."""

    def pairs(i: int, j: int, cols: list[np.ndarray], titles: list[str]) -> pa.RecordBatch:
        guest, left, row, at = cols
        t = Titles(row, at, guest, np.full(len(row), -1) if i == j else left.astype(np.int64), titles, hours)
        found = np.union1d(t.equal(), t.by_tokens()) if words else np.zeros(0, np.int64)
        if ratio:
            found = np.union1d(found, t.by_ratio(*ratio, found))
        a, b = (row[k] for k in np.divmod(found, max(1, len(row))))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["row_a", "row_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def whole() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            return pairs(now[1], now[2], [t.column(c).to_numpy() for c in ("guest", "left", "row", "at")], t.column("title").to_pylist())

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("bucket", "i", "j")]) if b.num_rows else np.zeros((3, 0))
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])) if b.num_rows else []
            for s, e in zip(starts, [*starts[1:], b.num_rows]):
                key = tuple(int(x) for x in keys[:, s])
                if key != now and held:
                    yield whole()
                    held = []
                now = key
                held.append(b.slice(s, e - s))
        if held:
            yield whole()

    return run
