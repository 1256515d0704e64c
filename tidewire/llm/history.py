"""Problem 4: new batches held against everything accepted, without reading the history's texts again.

A store in the shared folder keeps, for every accepted text class (texts with
the same tokens), keys with signatures (see ``neardup``: rare tokens, and
minwise bands over frequent parts, each with the set's size, the largest size
of a partner and a folded fingerprint), its token set, and the accepted ids.
Each table lies in directories by hash prefix; a probe opens only those that
the batch's keys fall into. A small batch is sent to the store's files, a
larger one meets them in a shuffle. What passes sizes and fingerprints is
verified exactly on the sets. The store has a stable path: manifests name its
segments, so any later session opens it, at any version, and appends to it.

Of frequent parts that are equal only the smallest class has bands: what is
alike to another by its frequent part alone, is alike to the smallest too.

Within a batch the same keys give the links between its rows; rows are then
decided in their order: a row is a repeat if it is linked to an accepted row,
else it is accepted itself. That is done for all rows at once, in rounds: what
has no earlier undecided neighbour is accepted, its neighbours are repeats. In
a hot bucket of a batch only the first ``LEADERS`` classes meet all others at
first; a class whose links are not all known waits, unless it turns out to be
a repeat, for the next pass over what is still open.

The order of the tokens is fixed with the store and may be any, so drift of
the counts loses nothing. ``compact`` counts anew and merges the segments.

Defined results: a null or blank id equals nothing, a title without tokens is
like nothing, and a row with neither is accepted; copies within a batch repeat
their first; equal order cannot occur, as rows have unique numbers (of equal
numbers the smaller class comes first); an empty history accepts all first
rows; an empty batch changes nothing; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm import neardup as N
from tidewire.llm import textops as X
from tidewire.llm.neardup import _binary, _flat, class_hash, verified
from tidewire.llm.topn import ENDS
from tidewire.shared import shared_dir, written

THRESHOLD = 0.6
#: A batch with no more keys than this is broadcast to the store's files; a larger one is shuffled with them.
SENT = 20_000
#: First classes of a hot bucket that meet all its others in one pass.
LEADERS = 64
#: Segments above which an append compacts the store.
SEGMENTS = 16

SETS = "row long, nid string, cls long, toks binary"
TABLES = {"sets": ("cls", "cls long, toks binary"), "ids": ("nid", "nid string"), "keys": ("key", N.POSTINGS)}


def normal_id(c: Column) -> Column:
    x = F.lower(F.regexp_replace(c, ENDS, ""))
    return F.when(x != "", x)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, nid, title -> row, nid, cls, toks; a title without tokens has neither class nor tokens."""
    for b in batches:
        tokens, offsets = X.token_sets(b.column(2).to_pylist())
        none = np.diff(offsets) == 0
        cls = pa.array(class_hash(tokens, offsets), mask=none)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cls, _binary(tokens, offsets)], ["row", "nid", "cls", "toks"])


def _frequent_parts(counts: np.ndarray):
    """cls, toks -> a hash of the frequent part, the set's size, cls: sets whose frequent part alone can make them alike to another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, offsets = _flat(b.column(1), np.uint32)
            n, frequent = np.diff(offsets), counts[N.slot(tokens)] > N.RARE
            nf = X.segment_sum(frequent.astype(np.int64), offsets)
            some = pa.array(nf >= np.maximum(1, np.ceil(THRESHOLD * n - 1e-6)))
            part = class_hash(tokens[frequent], np.concatenate([[0], np.cumsum(nf)]))
            yield pa.RecordBatch.from_arrays([pa.array(part).filter(some), pa.array(n).filter(some), b.column(0).filter(some)], ["part", "n", "cls"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from verified(pa.table(b), THRESHOLD)


def verify(pairs: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs (a of ``own``, b of ``other``) that are alike."""
    of = lambda df, x: df.select(F.col("cls").alias(x), F.col("toks").alias(f"toks_{x}"))
    both = pairs.distinct().join(of(own, "a"), "a").join(of(other, "b"), "b").select("a", "b", "toks_a", "toks_b")
    return both.mapInArrow(_verified, "a long, b long")


def _classes(rows: DataFrame) -> DataFrame:
    return rows.where("cls IS NOT NULL").select("cls", "toks").dropDuplicates(["cls"])


class AcceptedStore:
    """What has been accepted so far, as a folder of segments and manifests."""

    def __init__(self, spark: SparkSession, path: str, version: int, parts: int, segments: list[str]):
        self.spark, self.path, self.version, self.parts, self.segments = spark, path.rstrip("/"), version, parts, segments
        self._counts: np.ndarray | None = None

    # Files that Spark does not write go through its file system too, so any shared folder will do.
    @staticmethod
    def _fs(spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    @classmethod
    def _versions(cls, spark: SparkSession, path: str) -> list[int]:
        fs, p = cls._fs(spark, path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removeprefix("manifest-").removesuffix(".json")) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        return bool(cls._versions(spark, path))

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> AcceptedStore:
        """The store at ``path``, at its newest version or at an older one. Reads no texts and no keys."""
        path = path.rstrip("/")
        version = cls._versions(spark, path)[-1] if version is None else version
        said = json.loads(spark.sparkContext.wholeTextFiles(f"{path}/manifest-{version:06d}.json").values().first())
        return cls(spark, path, version, said["parts"], said["segments"])

    @classmethod
    def found(cls, spark: SparkSession, path: str, rows: DataFrame) -> AcceptedStore:
        """Accept a whole history: row, nid, title. Its texts are read this once."""
        store = cls(spark, path, -1, int(spark.conf.get("spark.sql.shuffle.partitions")), [])
        store._extend(rows.mapInArrow(_sets, SETS), None)
        return store

    def _commit(self) -> None:
        """The manifest comes last and whole, so a store that can be opened is complete."""
        self.version += 1
        text = json.dumps({"parts": self.parts, "segments": self.segments})
        fs, p = self._fs(self.spark, f"{self.path}/manifest-{self.version:06d}.json")
        fs, temp = self._fs(self.spark, f"{self.path}/_manifest-{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(temp, p)

    def _part(self, key: str) -> Column:
        return F.pmod(F.hash(key), F.lit(self.parts)).alias("part")

    def _write(self, df: DataFrame, segment: str, what: str) -> None:
        key, _ = TABLES[what]
        # Spark's hash partitions are these very parts, so a task writes one of them.
        df = df.repartition(self.parts, key).withColumn("part", self._part(key)).sortWithinPartitions("part", key)
        df.write.partitionBy("part").option("compression", "zstd").parquet(f"{self.path}/{what}/segment={segment}")

    def _read(self, what: str, parts: list[int] | None = None, segments: list[str] | None = None) -> DataFrame:
        key, schema = TABLES[what]
        root = f"{self.path}/{what}"
        df = self.spark.read.schema(f"{schema}, segment string, part int").option("basePath", root).parquet(*(f"{root}/segment={s}" for s in segments or self.segments))
        return (df if parts is None else df.where(F.col("part").isin(parts))).drop("segment", "part")

    def counts(self) -> np.ndarray:
        """How common each slot's tokens were when the store was founded or compacted; a table of fixed size."""
        if self._counts is None:
            rows = self.spark.read.parquet(f"{self.path}/counts/{self.segments[0]}").toArrow()
            self._counts = np.ones(N.SLOTS, np.uint16)
            self._counts[rows.column("slot").to_numpy()] = rows.column("df").to_numpy()
        return self._counts

    def _extend(self, rows: DataFrame, counts: np.ndarray | None) -> None:
        """Accept ``rows`` (row, nid, cls, toks) as one more segment; without ``counts`` it is the first, and they are made."""
        segment = f"s{uuid.uuid4().hex}"
        self._write(_classes(rows), segment, "sets")
        self._write(rows.where("nid IS NOT NULL").select("nid").distinct(), segment, "ids")
        sets = self._read("sets", segments=[segment])
        if counts is None:
            counts = N.token_counts(sets)
            slots = np.flatnonzero(counts > 1)
            self.spark.createDataFrame(pa.table({"slot": slots.astype(np.int32), "df": counts[slots].astype(np.int32)})).coalesce(1).write.parquet(f"{self.path}/counts/{segment}")
            self._counts = counts
        first = sets.mapInArrow(_frequent_parts(counts), "part long, n long, cls long").groupBy("part").agg(F.min(F.struct("n", "cls")).alias("x")).select("x.cls")
        post = lambda df, wanted: df.select("cls", "toks").mapInArrow(N._postings(counts, THRESHOLD, wanted, least=1), N.POSTINGS)
        self._write(post(sets, "rare").union(post(sets.join(first, "cls", "left_semi"), "bands")), segment, "keys")
        self.segments = [*self.segments, segment]
        self._commit()

    def append(self, rows: DataFrame) -> None:
        """Accept rows of a batch: row, nid, cls, toks."""
        self._extend(rows, self.counts())
        if len(self.segments) > SEGMENTS:
            self.compact()

    def compact(self) -> None:
        """One segment of all, with the tokens counted anew. The old segments stay for who has opened an older version."""
        sets = self._read("sets").dropDuplicates(["cls"]).select(F.lit(None).cast("long").alias("row"), F.lit(None).cast("string").alias("nid"), "cls", "toks")
        ids = self._read("ids").distinct().select(F.lit(None).cast("long").alias("row"), "nid", F.lit(None).cast("long").alias("cls"), F.lit(None).cast("binary").alias("toks"))
        rows = written(sets.union(ids), "compacted")
        self.segments = []
        self._extend(rows, None)

    def _matching(self, what: str, wanted: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """The store's rows that ``wanted`` can meet: of the directories its keys fall into; and ``wanted``, broadcast if it is small."""
        key, _ = TABLES[what]
        if n > SENT:
            return self._read(what), wanted
        parts = [r["part"] for r in wanted.select(self._part(key)).distinct().toArrow().to_pylist()]  # of a fixed number of parts
        return self._read(what, parts), F.broadcast(wanted)

    def probe(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch (row, nid, title) as row, nid, cls, toks, repeat."""
        rows = written(batch.mapInArrow(_sets, SETS), "batch")
        own = written(_classes(rows), "batch-sets")
        mine = written(own.mapInArrow(N._postings(self.counts(), THRESHOLD, least=1), N.POSTINGS), "batch-keys")
        store, mine = self._matching("keys", mine, mine.count())
        both = N._sided(mine, "a", "key").join(N._sided(store, "b", "key"), "key").where(N.near_columns(THRESHOLD))
        pairs = written(both.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct(), "pairs")
        n = pairs.count()
        sets, few = self._matching("sets", pairs.select(F.col("b").alias("cls")).distinct(), n)
        alike = verify(pairs, own, sets.join(few, "cls", "left_semi")).select("a")
        known = alike.distinct().select(F.col("a").alias("cls"), F.lit(True).alias("by_title"))
        nids = written(rows.where("nid IS NOT NULL").select("nid").distinct(), "batch-ids")
        ids, nids = self._matching("ids", nids, nids.count())
        seen = nids.join(ids.distinct(), "nid").distinct().select("nid", F.lit(True).alias("by_id"))
        no = F.lit(False)
        held = rows.drop("toks").join(known, "cls", "left").join(seen, "nid", "left").select("row", "nid", "cls", (F.coalesce("by_title", no) | F.coalesce("by_id", no)).alias("known"))
        fresh = written(held.where("NOT known").select("row", "nid", "cls"), "fresh")
        accepted = first_of_alike(fresh, own)
        return rows.join(accepted.select("row", F.lit(True).alias("ok")), "row", "left").select("row", "nid", "cls", "toks", F.col("ok").isNull().alias("repeat"))


def first_of_alike(rows: DataFrame, own: DataFrame) -> DataFrame:
    """The rows (row, nid, cls) that no earlier accepted one equals in id or is alike to; ``own`` has the classes' sets."""
    accepted = [rows.where("nid IS NULL AND cls IS NULL").select("row")]
    # Of rows with the same class and id only the first can be accepted: what rejects it, rejects them.
    nodes = written(rows.where("nid IS NOT NULL OR cls IS NOT NULL").groupBy("nid", "cls").agg(F.min("row").alias("row")), "undecided")
    while True:
        first = nodes.where("cls IS NOT NULL").groupBy("cls").agg(F.min("row").alias("row"))
        sets = written(own.join(first, "cls").select("cls", "toks", "row"), "open-sets")
        counts = N.token_counts(sets)
        by_key = sets.select("cls", "toks").mapInArrow(N._postings(counts, THRESHOLD), N.POSTINGS).repartition("key").sortWithinPartitions("key", "room")
        shared = written(by_key.mapInArrow(N._pairs_of_runs(THRESHOLD, N.HOT), N.FOUND), "candidates")
        pairs = shared.where("b IS NOT NULL").select("a", "b")
        hot = shared.where("b IS NULL").select("key", F.col("a").alias("cls"), *N._FIELDS[1:])
        waiting = None
        if not hot.isEmpty():
            # Spark cuts each partition to LEADERS rows a key before the shuffle.
            place = F.row_number().over(W.partitionBy("key").orderBy("row"))
            lead = written(hot.join(sets.select("cls", "row"), "cls").withColumn("place", place).where(F.col("place") <= LEADERS).drop("place", "row"), "leaders")
            star = N._sided(hot, "a", "key").join(N._sided(lead, "b", "key"), "key").where(N.near_columns(THRESHOLD))
            pairs = pairs.union(N._as_pairs(star))
            waiting = written(hot.select("key", "cls").join(lead, ["key", "cls"], "left_anti").select("cls").distinct(), "waiting")
        links = written(verify(pairs, own, own), "links")
        took, nodes = first_of_linked(nodes, links, waiting)
        accepted.append(took)
        if nodes is None:
            return reduce(DataFrame.union, accepted)


def first_of_linked(nodes: DataFrame, links: DataFrame, waiting: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The nodes (row, nid, cls) that no earlier accepted one equals in id or class or is linked to (links a, b of classes).

    Classes in ``waiting`` may have links that are not known yet and are not accepted. What stays undecided comes second.
    """
    both = links.select("a", "b").union(links.select("b", "a")).toDF("cls", "other")
    held = F.lit(False).alias("held")
    undecided = nodes.select("row", "nid", "cls", held) if waiting is None else nodes.join(waiting.withColumn("held", F.lit(True)), "cls", "left").select("row", "nid", "cls", F.coalesce("held", F.lit(False)).alias("held"))
    accepted = []
    while True:
        by_cls = undecided.where("cls IS NOT NULL").groupBy("cls").agg(F.min("row").alias("first_cls"))
        by_id = undecided.where("nid IS NOT NULL").groupBy("nid").agg(F.min("row").alias("first_id"))
        linked = both.join(by_cls.withColumnRenamed("cls", "other"), "other").groupBy("cls").agg(F.min("first_cls").alias("first_link"))
        seen = undecided.join(by_cls, "cls", "left").join(by_id, "nid", "left").join(linked, "cls", "left")
        first = F.least(F.coalesce("first_cls", "row"), F.coalesce("first_id", "row"), F.coalesce("first_link", "row"))
        now = written(seen.select("row", "nid", "cls", "held", (~F.col("held") & (F.col("row") <= first)).alias("ok")), "undecided")
        took, open_ = now.where("ok"), now.where("NOT ok").select("row", "nid", "cls", "held")
        accepted.append(took.select("row"))
        if open_.isEmpty():
            return reduce(DataFrame.union, accepted), None
        if waiting is not None and took.isEmpty():
            return reduce(DataFrame.union, accepted), open_.drop("held")
        gone = took.where("cls IS NOT NULL").select("cls").union(both.join(took.select(F.col("cls").alias("other")), "other", "left_semi").select("cls")).distinct()
        undecided = written(open_.join(gone, "cls", "left_anti").join(took.where("nid IS NOT NULL").select("nid").distinct(), "nid", "left_anti"), "undecided")


def store_path(spark: SparkSession, rows: DataFrame) -> str:
    """A path in the shared folder that stands for the files of ``rows``: a changed file gives another."""
    files = []
    for name in sorted(rows.inputFiles()):
        fs, p = AcceptedStore._fs(spark, name)
        status = fs.getFileStatus(p)
        files.append([name, status.getLen(), status.getModificationTime()])
    return f"{shared_dir(spark)}/accepted-{hashlib.sha1(json.dumps(files).encode()).hexdigest()[:16]}"


def found(spark: SparkSession, sf: str) -> DataFrame:
    """All batches against the items: the store is founded where there is none yet, and read at its first version.

    ``batch_row`` rises with ``batch_no``, so the batches' rows in their order are one sequence, which is decided in one
    pass; the accepted rows are appended as the store's next version.
    """
    items, incoming = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("edition_items", "incoming_items"))
    of = lambda df, key: df.select(F.col(key).cast("long").alias("row"), normal_id(F.col("id")).alias("nid"), "title")
    path = store_path(spark, items)
    store = AcceptedStore.open(spark, path, 0) if AcceptedStore.exists(spark, path) else AcceptedStore.found(spark, path, of(items, "item_row"))
    held = written(store.probe(of(incoming, "batch_row")), "probed")
    store.append(held.where("NOT repeat").select("row", "nid", "cls", "toks"))
    return held.where("repeat").select(F.col("row").alias("batch_row"))
