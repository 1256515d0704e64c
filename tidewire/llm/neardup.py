"""Problem 1: groups of near-duplicate texts.

Texts are compared as token sets (see ``textops``). Rows with equal sets fall
into one class first, so copies never meet pairwise. With all tokens in one
order, rare ones first, two alike sets share a token among the first 40 % (and
one) of each. Where the first token they share is in at most ``RARE`` sets,
they meet on it: without loss, and a token's bucket is bounded whatever the
table's size. Else everything they share is frequent, so their frequent parts
alone are at least as alike as the whole sets: they meet on minwise bands over
these parts. A family of any size makes its own common tokens frequent, so
its members' frequent parts are nearly equal and meet almost surely.

What is known of the tokens' counts is a table of fixed size: tokens that fall
into one slot count together. A rare token that looks frequent costs nothing
but speed, as any split of the tokens keeps both rules true.

Within a bucket a pair goes on if its sizes leave room for the overlap needed
and if their folded fingerprints (each bit the parity of its tokens' number; 192
bits with rare tokens, 128 with bands) differ in no more bits than alike sets
may differ in tokens; neither test loses a pair. Every class has a pivot
table: its Hamming distances, in a 512-bit fingerprint, to fixed reference
fingerprints. A pair whose largest coordinate difference exceeds what the
threshold allows is discarded without loss; survivors are verified exactly,
and groups are closed under likeness.

Hot buckets (more than ``HOT`` classes) leave the stream. They are split into
blocks; each class is held against its block's smallest class and these
against the smallest of all, which joins a family with linear work. Then every
class outside a bucket's largest group is held against all classes of the
bucket that are in another group, block by block, so no link is lost. Buckets
that a sample shows to hold ``MEGA`` of all classes never go through one task.

Defined results: null and empty texts, and texts without a token, belong to no
group; equal rows group together; an empty table gives an empty result; ties
cannot occur, as the smallest key names a group; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import textops as X
from tidewire.shared import scratch_path, shuffles_freed, written

THRESHOLD = 0.6
#: A token in more sets than this is frequent; a rare token's bucket holds no more classes.
RARE = 256
#: Minwise values of a band over a set's frequent part; the chance with which an alike pair must share a band; bands at most.
ROWS, SURE, BANDS = 4, 0.99, 34
#: Slots of the table of token counts: what is sent to the tasks is this large at most, whatever the input.
SLOTS = 1 << 21
FINGERPRINT_BITS, PIVOTS = 512, 32
#: Bits of the fingerprint that travels with a rare token, and with a band.
RARE_BITS, BAND_BITS = 192, 128
#: Classes of a bucket above which it is hot; of a block of it.
HOT, BLOCK = 2048, 1024
#: One class in so many is looked at to find the buckets that hold this share of all; there are at most BANDS / MEGA of them.
SAMPLE, MEGA = 16, 0.001
#: The keys are made, shuffled and paired in so many parts, one after another, so that disk holds one part's postings.
PARTS = 2


@lru_cache(2)
def pivots(n: int = PIVOTS, bits: int = FINGERPRINT_BITS) -> np.ndarray:
    """The reference fingerprints, as +1 (bit clear) and -1 (bit set)."""
    return np.random.default_rng(29).choice(np.array([1, -1], np.int16), (bits, n)).astype(np.float32)


def pivot_table(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hamming distances of every set's fingerprint to the pivots, less the distance of the empty set, as int8.

    Setting a bit that a pivot has set lowers the distance by one, any other raises it by one. Clipping to int8
    only lowers differences.
    """
    n = len(offsets) - 1
    out = np.empty((n, PIVOTS), np.int8)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    bit = (tokens >> np.uint32(7)) % np.uint32(FINGERPRINT_BITS)
    for a in range(0, n, 4096):
        b = min(n, a + 4096)
        own = slice(offsets[a], offsets[b])
        marks = np.zeros((b - a, FINGERPRINT_BITS), np.float32)
        marks[rows[own] - a, bit[own]] = 1
        out[a:b] = np.clip(marks @ pivots(), -128, 127)
    return out


def allowed_difference(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """The most tokens in which two sets of these sizes can differ and still share ``threshold`` of all."""
    return (na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-6


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(values)
    at = (offsets * data.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())


def _flat(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column without nulls, one after another, and their offsets."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(dtype).itemsize
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype, count=(at[-1] - at[0]) // size, offset=int(at[0])) if len(column) and at[-1] > at[0] else np.zeros(0, dtype)
    return flat, (at - at[0]) // size


def class_hash(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return X.mix(X.segment_sum(X.mix(tokens.astype(np.uint64) + np.uint64(1)), offsets) + np.diff(offsets).astype(np.uint64)).view(np.int64)


def _tokens_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The token sets of a batch of space, row, text; sets of different spaces have no token in common."""
    tokens, offsets = X.token_sets(b.column(2).to_pylist())
    space = np.repeat(b.column(0).to_numpy(), np.diff(offsets)).astype(np.uint32)
    return tokens ^ (space * np.uint32(0x9E3779B9)), offsets


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens, offsets = _tokens_of(b)
        some = pa.array(np.diff(offsets) > 0)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(some), b.column(1).filter(some), pa.array(class_hash(tokens, offsets)).filter(some)], ["space", "row", "cls"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens, offsets = _tokens_of(b)
        cls = class_hash(tokens, offsets)
        new = np.zeros(len(cls), bool)  # a copy's set is sent once a batch
        new[np.unique(cls, return_index=True)[1]] = True
        new &= np.diff(offsets) > 0
        keep = np.repeat(new, np.diff(offsets))
        tokens, sizes = tokens[keep], np.diff(offsets)[new]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        piv = pivot_table(tokens, offsets)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cls[new]), pa.array(sizes.astype(np.int32)), _binary(piv.ravel(), np.arange(len(sizes) + 1) * PIVOTS), _binary(tokens, offsets)],
            ["cls", "n", "piv", "toks"],
        )


def slot(tokens: np.ndarray) -> np.ndarray:
    return tokens & np.uint32(SLOTS - 1)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        t, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(c.astype(np.int64))], ["slot", "df"])

    for b in batches:
        held.append(slot(_flat(b.column(0), np.uint32)[0]))
        size += len(held[-1])
        if size > 4_000_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def token_counts(sets: DataFrame) -> np.ndarray:
    """In how many sets each slot's tokens are, up to 65,535; of fixed size, whatever the input's."""
    df = sets.select("toks").mapInArrow(_slot_counts, "slot long, df long").groupBy("slot").agg(F.least(F.sum("df"), F.lit(65535)).alias("df"))
    rows = df.where("df > 1").select(F.col("slot").cast("int").alias("slot"), F.col("df").cast("int").alias("df")).toArrow()
    counts = np.ones(SLOTS, np.uint16)
    counts[rows.column("slot").to_numpy()] = rows.column("df").to_numpy()
    return counts


def most_partner(n: np.ndarray, place: np.ndarray, threshold: float) -> np.ndarray:
    """The largest size of an alike set whose first token in common stands at this place of a set of size ``n``."""
    return np.floor((n - place) * ((1 + threshold) / threshold) - n + 1e-6).astype(np.int64)


def folded(tokens: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """The sets' fingerprints as 64-bit words: a bit is the parity of the number of tokens that fall on it, so a token of difference changes one bit at most."""
    n = len(offsets) - 1
    own = np.repeat(np.arange(n), np.diff(offsets))
    marks = np.bincount(own * bits + ((tokens >> np.uint32(7)) % np.uint32(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(marks.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def bands_needed(share: np.ndarray, threshold: float, rows: int = ROWS) -> np.ndarray:
    """How many bands a set needs whose frequent part is this share of it, so that it meets any alike set with chance SURE.

    Of a set of size 1, with a frequent part of ``share``, an alike set shares o between ``threshold`` and ``share`` and
    has at most o (1 + t) / t - 1 tokens; so the parts are alike to at least o / (share - 1 + o / t), which is least at
    o = share. The fewer bands of two sets are enough for both, as either bound holds for the pair.
    """
    least = share / (share - 1 + share / threshold)
    return np.minimum(BANDS, np.ceil(np.log(1 - SURE) / np.log(1 - np.minimum(least, 0.999) ** rows))).astype(np.int64)


def keys_of(tokens: np.ndarray, offsets: np.ndarray, counts: np.ndarray, threshold: float, rare: int = RARE, rows: int = ROWS, least: int = 2, *, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, key, largest partner's size, and whether the key is a band, for every key of every set that falls into this part.

    A token that is in fewer than ``least`` sets makes no key: within one table nothing can meet there.
    """
    sizes = np.diff(offsets)
    own = np.repeat(np.arange(len(sizes)), sizes)
    df = counts[slot(tokens)]
    by = np.argsort((own.astype(np.uint64) << np.uint64(37)) | (np.minimum(df, rare + 1).astype(np.uint64) << np.uint64(21)) | slot(tokens).astype(np.uint64), kind="stable")
    place = np.arange(len(tokens)) - offsets[:-1][own]
    need = np.ceil(threshold * sizes - 1e-6).astype(np.int64)
    df, first = df[by], tokens[by]
    keep = (place <= (sizes - need)[own]) & (df <= rare) & (df >= least) & (first % np.uint32(parts) == part)
    one = own[keep], first[keep].astype(np.int64), most_partner(sizes[own[keep]], place[keep], threshold)
    frequent = df > rare
    nf = X.segment_sum(frequent.astype(np.int64), offsets)
    whole = np.flatnonzero((nf >= need) & (nf > 0))
    if not len(whole):
        return *one, np.zeros(len(one[0]), bool)
    chosen = np.zeros(len(sizes), bool)
    chosen[whole] = True
    bands = bands_needed(nf[whole] / sizes[whole], threshold, rows)
    keys = X.band_keys(first[frequent & chosen[own]], np.concatenate([[0], np.cumsum(nf[whole])]), bands, rows, part=part, parts=parts)
    bands = X.bands_of_part(bands, part, parts)
    most = np.floor(nf[whole] * ((1 + threshold) / threshold) - sizes[whole] + 1e-6).astype(np.int64)
    two = np.repeat(whole, bands), keys.view(np.int64), np.repeat(most, bands)
    return *(np.concatenate(c) for c in zip(one, two, strict=True)), np.repeat([False, True], [len(one[0]), len(two[0])])


POSTINGS = "key long, cls long, room long, b0 long, b1 long, b2 long"
WORDS = ("b0", "b1", "b2")
_FIELDS = ("cls", "room", *WORDS)


def _posted(row: np.ndarray, key: np.ndarray, cls: np.ndarray, n: np.ndarray, most: np.ndarray, band: np.ndarray, tokens: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """``room`` holds a set's size and the largest size of a partner, so that rows sort by size. Words that a band does not need are 0."""
    room = (n[row] << 32) | np.maximum(most, 0)
    bits = np.zeros((len(row), len(WORDS)), np.int64)
    bits[~band] = folded(tokens, offsets, RARE_BITS)[row[~band]]
    bits[band, : BAND_BITS // 64] = folded(tokens, offsets, BAND_BITS)[row[band]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (key, cls[row], room, *bits.T.copy())], ["key", *_FIELDS])


NO_KEYS = np.zeros(0, np.int64)


def _postings(counts: np.ndarray, threshold: float, wanted: str = "rest", mega: np.ndarray = NO_KEYS, least: int = 2, part: int = 0, parts: int = 1):
    """``wanted``: "rest" (all keys but those in ``mega``), "mega" (those only), "rare" and "bands" (rare tokens or bands only), "band keys" (no more than the keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tokens, offsets = _flat(b.column(1), np.uint32)
            row, key, most, band = keys_of(tokens, offsets, counts, threshold, least=least, part=part, parts=parts)
            if wanted == "band keys":
                yield pa.RecordBatch.from_arrays([pa.array(key[band])], ["key"])
                continue
            if len(mega) or wanted != "rest":
                inside = band & np.isin(key, mega) if wanted in ("rest", "mega") else band
                use = inside if wanted in ("mega", "bands") else ~inside
                row, key, most, band = row[use], key[use], most[use], band[use]
            yield _posted(row, key, b.column(0).to_numpy(), np.diff(offsets), most, band, tokens, offsets)

    return run


def near(n: np.ndarray, words: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the fingerprints of rows i and j differ in no more bits than alike sets may differ in tokens."""
    # Viewed as unsigned: of signed numbers it is the absolute value whose bits are counted.
    differ = sum(np.bitwise_count((w[i] ^ w[j]).view(np.uint64)).astype(np.int32) for w in words)
    return differ <= allowed_difference(n[i], n[j], threshold)


#: Runs up to this length are paired together, longer ones row block by row block of this many cells.
SHORT, CELLS = 48, 1 << 18
FOUND = "a long, b long, key long, room long, b0 long, b1 long, b2 long"
_FOUND = [x.split()[0] for x in FOUND.split(", ")]


def _pairs_of_runs(threshold: float, hot: int):
    """Rows arrive sorted by key and size. All pairs (a < b) of a key that size and fingerprint allow; the rows of a key with more than ``hot`` as they are, b null."""

    def passed_on(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, cls, *rest = cols
        return pa.RecordBatch.from_arrays([pa.array(cls), pa.nulls(len(cls), pa.int64()), pa.array(key), *(pa.array(c) for c in rest)], _FOUND)

    def pairs(key, cls, room, *words) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        n, most = room >> 32, room & 0xFFFFFFFF
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            ok = near(n, words, i, j, threshold)
            left.append(cls[i[ok]])
            right.append(cls[j[ok]])

        at, d = np.flatnonzero(np.repeat(sizes <= SHORT, sizes)), 0
        while len(at):
            d += 1
            at = at[at + d < len(key)]
            at = at[key[at + d] == key[at]]
            i = at[(n[at + d] <= most[at]) & (n[at] <= most[at + d])]
            keep(i, i + d)
        for s, m in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
            step = max(1, CELLS // int(m))
            for a in range(s, s + m, step):
                rows, later = np.arange(a, min(a + step, s + m)), np.arange(a + 1, s + m)
                i, j = np.nonzero((n[later] <= most[rows, None]) & (n[rows, None] <= most[later]) & (rows[:, None] < later))
                keep(rows[i], later[j])
        a, b = np.concatenate(left), np.concatenate(right)
        if len(a):
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) < 1 << 20 else np.stack([np.minimum(a, b), np.maximum(a, b)])
            none = pa.nulls(both.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), *[none] * (len(_FOUND) - 2)], _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the last run, as far as it has come
        size, flowing = 0, None  # the key of a hot run that is being passed on
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy() for c in b.columns]
            if flowing is not None:
                k = int(np.searchsorted(cols[0], flowing, "right")) if cols[0][0] == flowing else 0
                if k:
                    yield passed_on([c[:k] for c in cols])
                    cols = [c[k:] for c in cols]
                if not len(cols[0]):
                    continue
                flowing = None
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if held and held[0][0][0] == cols[0][0]:
                if not last:
                    held.append(cols)
                    size += len(cols[0])
                    if size > hot:
                        flowing = cols[0][0]
                        yield from (passed_on(c) for c in held)
                        held, size = [], 0
                    continue
            whole = [np.concatenate(c) for c in zip(*held, [c[:last] for c in cols], strict=True)]
            starts = np.flatnonzero(np.concatenate([[True], whole[0][1:] != whole[0][:-1]])) if len(whole[0]) else np.zeros(0, int)
            sizes = np.diff(np.append(starts, len(whole[0])))
            large = np.repeat(sizes > hot, sizes)
            if large.any():
                yield passed_on([c[large] for c in whole])
                whole = [c[~large] for c in whole]
            yield from pairs(*whole)
            held, size = [[c[last:].copy() for c in cols]], len(cols[0]) - last
            if size > hot:
                flowing = cols[0][-1]
                yield from (passed_on(c) for c in held)
                held, size = [], 0
        if held:
            yield from pairs(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _alike(threshold: float):
    """a, b, and size, pivot table and tokens of each: the pairs that pass the pivot tables and are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.table(b)
            if not len(t):
                continue
            piv_a, piv_b = (_flat(t.column(c).combine_chunks(), np.int8)[0].reshape(-1, PIVOTS).astype(np.int16) for c in ("piv_a", "piv_b"))
            na, nb = (t.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
            t = t.filter(pa.array(np.abs(piv_a - piv_b).max(axis=1) <= allowed_difference(na, nb, threshold))).select(["a", "b", "toks_a", "toks_b"])
            yield from verified(t, threshold)

    return run


def verified(t: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    if len(t):
        fa, oa = _flat(t.column("toks_a").combine_chunks(), np.uint32)
        fb, ob = _flat(t.column("toks_b").combine_chunks(), np.uint32)
        alike = X.pair_jaccard(np.split(fa, oa[1:-1]), np.split(fb, ob[1:-1])) >= threshold - 1e-9
        yield from t.select(["a", "b"]).filter(pa.array(alike)).to_batches()


def table_of_sets(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``texts``: space, row, text. Each row's class, and one set with its pivot table for each class, bucketed by class in the shared folder."""
    spark = texts.sparkSession
    members = written(texts.mapInArrow(_classes, "space int, row long, cls long"), "members")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = texts.mapInArrow(_sets, "cls long, n int, piv binary, toks binary").repartition(parts, "cls").dropDuplicates(["cls"])
    return members, bucketed(sets, "cls", parts, "sets")


def bucketed(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """A table bucketed by ``key``, so that later joins on it move only their other side."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    # Rows that come partitioned by the key are not moved again.
    df.repartition(parts, key).write.bucketBy(parts, key).format("parquet").option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def alike_pairs(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Candidate pairs (a, b) of classes that pass the pivot tables and are alike."""
    of = lambda x: sets.select(F.col("cls").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "piv", "toks"))).hint("merge")
    # The one shuffle by a serves both the distinct and the join.
    both = pairs.repartition("a").distinct().join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", "n_a", "n_b", "piv_a", "piv_b", "toks_a", "toks_b").mapInArrow(_alike(threshold), "a long, b long")


def mega_keys(sets: DataFrame, counts: np.ndarray, threshold: float) -> np.ndarray:
    """Band keys that hold MEGA of all classes and make a hot bucket, by a sample of the classes; at most BANDS / MEGA of them."""
    sample = sets.where(F.pmod(F.col("cls"), F.lit(SAMPLE)) == 0)
    n = sample.count()
    keys = sample.select("cls", "toks").mapInArrow(_postings(counts, threshold, "band keys"), "key long").groupBy("key").count()
    rows = keys.where(F.col("count") >= max(HOT / SAMPLE, MEGA * n)).select("key").toArrow()
    return np.sort(rows.column("key").to_numpy())


def room(which: str, side: str = "") -> F.Column:
    c = F.col(f"room{side}")
    return F.shiftright(c, 32) if which == "n" else c.bitwiseAND(F.lit(0xFFFFFFFF))


def near_columns(threshold: float, x: str = "_a", y: str = "_b") -> F.Column:
    """``near`` and the test of sizes as a column, for rows of postings side by side."""
    differ = sum((F.bit_count(F.col(f"{w}{x}").bitwiseXOR(F.col(f"{w}{y}"))) for w in WORDS), F.lit(0))
    most = (room("n", x) + room("n", y)) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return (differ <= most) & (room("n", x) <= room("most", y)) & (room("n", y) <= room("most", x))


def _sided(df: DataFrame, x: str, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{c}_{x}") for c in _FIELDS))


def _as_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).where("a < b")


def star_pairs(hot: DataFrame, threshold: float) -> DataFrame:
    """``hot``: key, block, and a posting's fields. Each class with its block's smallest, and these with the smallest of the key."""
    least = F.min(F.struct("room", "cls", *WORDS))
    block = hot.groupBy("key", "block").agg(least.alias("x")).select("key", "block", "x.*")
    top = block.groupBy("key").agg(least.alias("x")).select("key", "x.*")
    star = _sided(hot, "a", "key", "block").join(_sided(block, "b", "key", "block"), ["key", "block"])
    heads = _sided(block, "a", "key").join(_sided(top, "b", "key"), "key")
    return _as_pairs(star.where(near_columns(threshold))).union(_as_pairs(heads.where(near_columns(threshold))))


def _pairs_of_cells(threshold: float):
    """Rows arrive sorted by key, cell and side: 0 (left), 1 (right) and 2 (right, of the key's largest group). The pairs of left and right of a cell that are in different groups and that size and fingerprint allow."""

    def pairs(side, grp, cls, room, *words) -> Iterator[np.ndarray]:
        n, most = room >> 32, room & 0xFFFFFFFF
        lefts, right = int(np.searchsorted(side, 1)), np.arange(np.searchsorted(side, 1), len(side))
        step = max(1, CELLS // max(1, len(right)))
        for s in range(0, lefts if len(right) else 0, step):
            rows = np.arange(s, min(s + step, lefts))[:, None]
            # Two classes outside the main group meet twice, one of these times is enough.
            i, j = np.nonzero((n[right] <= most[rows]) & (n[rows] <= most[right]) & (grp[rows] != grp[right]) & ((cls[rows] < cls[right]) | (side[right] == 2)))
            i, j = i + s, right[j]
            ok = near(n, words, i, j, threshold)
            a, b = cls[i[ok]], cls[j[ok]]
            yield np.stack([np.minimum(a, b), np.maximum(a, b)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the last cell, as far as it has come
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy() for c in b.columns]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            last += int(np.searchsorted(cols[1][last:], cols[1][-1]))
            if held and not last and held[0][0][0] == cols[0][0] and held[0][1][0] == cols[1][0]:
                held.append([c.copy() for c in cols])
                continue
            yield from of_cells([np.concatenate(c) for c in zip(*held, [c[:last] for c in cols], strict=True)])
            held = [[c[last:].copy() for c in cols]]
        if held:
            yield from of_cells([np.concatenate(c) for c in zip(*held, strict=True)])

    def of_cells(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, cell, *rest = cols
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])) if len(key) else []
        for s, e in zip(starts, [*starts[1:], len(key)]):
            for both in pairs(*(c[s:e] for c in rest)):
                if both.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return run


def crossing_pairs(hot: DataFrame, label: DataFrame, threshold: float) -> DataFrame:
    """Every pair of a hot key whose classes are in different groups, held against each other in blocks.

    The classes outside a key's largest group, in blocks of their own, meet all blocks of the key.
    """
    named = hot.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    sizes = named.groupBy("key", "grp").agg(F.count("*").alias("m"))
    main = sizes.groupBy("key").agg(F.max_by("grp", "m").alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"))
    main = main.where("most < all").select("key", "main", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("others"))
    rows = named.join(main, "key")
    spread = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(n))
    cell = lambda i, j: (F.shiftleft(i, 32) + j).alias("cell")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    left = rows.where("grp != main").select("*", spread("others", 1).alias("i"), each("blocks").alias("j"), F.lit(0).alias("side"))
    right = rows.select("*", spread("blocks", 2).alias("j"), each("others").alias("i"), (F.lit(1) + (F.col("grp") == F.col("main")).cast("int")).alias("side"))
    both = reduce(DataFrame.union, (x.select("key", cell(F.col("i"), F.col("j")), "side", "grp", *_FIELDS) for x in (left, right)))
    return both.repartition("key", "cell").sortWithinPartitions("key", "cell", "side").mapInArrow(_pairs_of_cells(threshold), "a long, b long")


def groups_of_classes(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``node`` and ``grp`` of every class that is linked to another."""
    counts = token_counts(sets)
    mega = mega_keys(sets, counts, threshold)
    pick = lambda wanted, *of: sets.select("cls", "toks").mapInArrow(_postings(counts, threshold, wanted, mega, 2, *of), POSTINGS)
    by_key = (pick("rest", part, PARTS).repartition("key").sortWithinPartitions("key", "room") for part in range(PARTS))
    shared = reduce(DataFrame.union, [written(p.mapInArrow(_pairs_of_runs(threshold, HOT), FOUND), "candidates") for p in by_key])
    hot = shared.where("b IS NULL").select("key", F.col("a").alias("cls"), *_FIELDS[1:])
    if len(mega):
        hot = hot.union(pick("mega").select("key", *_FIELDS))
    edges = written(alike_pairs(shared.where("b IS NOT NULL").select("a", "b"), sets, threshold), "links")
    if not len(mega) and hot.isEmpty():
        return components(edges)
    sizes = hot.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    hot = written(hot.join(sizes, "key").select("key", F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block"), *_FIELDS), "hot")
    star = written(alike_pairs(star_pairs(hot, threshold), sets, threshold), "links")
    label = components(edges.union(star))
    crossing = written(alike_pairs(crossing_pairs(hot, label, threshold), sets, threshold), "links")
    return label if crossing.isEmpty() else components(reduce(DataFrame.union, (edges, star, crossing)))


def components(edges: DataFrame) -> DataFrame:
    """Each linked node's group, named by the group's smallest node: smallest neighbour, then jumps over labels, until nothing changes."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other"), "edges")
    label = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("grp")), "labels")
    while True:
        names = label.select(F.col("node").alias("other"), F.col("grp").alias("next"))
        step = both.join(names, "other").groupBy("node").agg(F.min("next").alias("next"))
        step = label.join(step, "node").select("node", "grp", F.least("grp", "next").alias("next"))
        jump = label.select(F.col("node").alias("next"), F.col("grp").alias("jump"))
        new = written(step.join(jump, "next").select("node", "grp", F.least("next", "jump").alias("new")), "labels")
        if new.where("new < grp").isEmpty():
            return label
        label = new.select("node", F.col("new").alias("grp"))


def groups_of_texts(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``texts``: space, row, text. ``space``, ``row`` and ``grp`` of every row that has a near-duplicate or copy in its space."""
    with shuffles_freed(texts.sparkSession):
        members, sets = table_of_sets(texts)
        label = groups_of_classes(sets, threshold)
    copies = members.groupBy("cls").agg(F.count("*").alias("m"))
    wanted = copies.where("m > 1").select("cls").union(label.select("node")).distinct()
    of = members.join(wanted, "cls", "left_semi").join(label.withColumnRenamed("node", "cls"), "cls", "left")
    return of.select("space", "row", F.coalesce("grp", "cls").alias("grp"))


def groups(df: DataFrame, key: str, text: F.Column, threshold: float = THRESHOLD) -> DataFrame:
    """``row`` and ``grp`` of every row of one table that has a near-duplicate or copy, one row for each."""
    return groups_of_texts(df.select(F.lit(0).alias("space"), F.col(key).cast("long").alias("row"), text.alias("text")), threshold).select("row", "grp")


def group_pairs(grouped: DataFrame, *also: str) -> DataFrame:
    """Every pair of one group, smaller key first; the form the result's definition asks for.

    A group's rows are cut into blocks, and each block meets all rows, so no task emits a whole group's pairs.
    """
    blocks = grouped.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = grouped.join(blocks, "grp")
    a = rows.select("grp", *also, F.col("row").alias("row_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    b = rows.select("grp", F.col("row").alias("row_b"), F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"))
    return a.join(b, ["grp", "block"]).where("row_a < row_b").select(*also, "row_a", "row_b")


RECORD_SETS = ("edition_items", "articles")


def record_texts(spark: SparkSession, sf: str) -> DataFrame:
    items, arts = spark.read.parquet(f"{sf}/edition_items.parquet"), spark.read.parquet(f"{sf}/articles.parquet")
    both = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")))
    of = lambda df, space, key, text: df.select(F.lit(space).alias("space"), F.col(key).cast("long").alias("row"), text.alias("text"))
    return of(items, 0, "item_row", both).union(of(arts, 1, "article_row", F.col("description")))


def record_set() -> F.Column:
    return F.element_at(F.array(*map(F.lit, RECORD_SETS)), F.col("space") + 1).alias("record_set")


def found(spark: SparkSession, sf: str) -> DataFrame:
    return group_pairs(groups_of_texts(record_texts(spark, sf)), "space").select(record_set(), "row_a", "row_b")


def classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each row with a near-duplicate: its group's smallest row and the group's size."""
    g = groups_of_texts(record_texts(spark, sf))
    of = g.groupBy("grp").agg(F.min("row").alias("first_row"), F.count("*").alias("group_size"))
    return g.join(of, "grp").select(record_set(), F.col("row").alias("row_key"), "first_row", "group_size")
