"""The operators of the training-data problems against brute force on small tables, and their edge cases."""

import datetime as dt
import itertools
import random
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire import shared
from tidewire.llm import capping, history, leakage, neardup, packing, pii, topn, truncation
from tidewire.llm import textops as X

WORDS = [f"w{i}" for i in range(300)]


def tokens(t):
    out = set()
    for run in re.findall(r"[^\W_]+", (t or "").lower()):
        for part in re.findall(r"[㐀-鿿]+|[^㐀-鿿]+", run):
            out |= {part[i : i + 2] for i in range(len(part) - 1)} if "㐀" <= part[0] <= "鿿" else {part}
    return out


def alike(a, b, share=0.6):
    a, b = tokens(a), tokens(b)
    return bool(a) and bool(b) and len(a & b) >= share * len(a | b)


def closed(texts):
    lead = {i: i for i in texts}

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if alike(texts[a], texts[b]):
            lead[root(b)] = root(a)
    return {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if root(a) == root(b)}


def test_token_sets_equal_a_plain_tokenizer():
    texts = ["Hello hello, World-55!", None, "", "中文字 AI芯片x9", "a_b c", "é É", "x" * 5000, "字", "…!?"]
    flat, offsets = X.token_sets(texts)
    assert [int(n) for n in np.diff(offsets)] == [len(tokens(t)) for t in texts]
    one, _ = X.token_sets(["hello"])
    assert one[0] in flat[offsets[0] : offsets[1]]


def edited(rng, n):
    texts, k = {}, 0
    for _ in range(n):
        base = [rng.choice(WORDS) for _ in range(30)]
        for _ in range(rng.choice([1, 1, 2, 3])):
            words = base[:]
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts[k] = " ".join(words)
            k += 1
    return texts


def test_near_duplicates(spark):
    texts = edited(random.Random(1), 40) | {900: None, 901: "", 902: "!!", 903: "same text here", 904: "Same, text here"}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "id long, text string, row string")
    got = {(r[0], r[1]) for r in neardup.group_pairs(neardup.groups(df, "id", F.col("text"))).collect()}
    want = closed({k: t or "" for k, t in texts.items()})
    assert got <= want and len(got) >= 0.97 * len(want) and (903, 904) in got


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert neardup.group_pairs(neardup.groups(df, "id", F.col("text"))).count() == 0


def test_pivot_tables_discard_no_alike_pair():
    texts = list(edited(random.Random(2), 60).values())
    flat, offsets = X.token_sets(texts)
    piv, n = neardup.pivot_table(flat, offsets).astype(int), np.diff(offsets)
    for a, b in itertools.combinations(range(len(texts)), 2):
        if alike(texts[a], texts[b]):
            assert np.abs(piv[a] - piv[b]).max() <= neardup.allowed_difference(n[a], n[b], 0.6)


def grouped(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    return {(r[0], r[1]) for r in neardup.group_pairs(neardup.groups(df, "id", F.col("text"))).collect()}


def test_hot_buckets_are_linked_whole(spark, monkeypatch):
    """Each version is like its neighbours only, and every bucket with more than a few classes is hot."""
    monkeypatch.setattr(neardup, "HOT", 6)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    words = [f"c{i}" for i in range(400)]
    texts = {i: " ".join(words[4 * i : 4 * i + 20]) for i in range(60)} | {100 + i: f"{' '.join(words[:12])} {' '.join(f'e{i}x{j}' for j in range(4))}" for i in range(60)}
    assert grouped(spark, texts) == closed(texts)


@pytest.mark.parametrize("mega", [0.001, 0.2])
def test_frequent_tokens_alone_link_a_family(spark, monkeypatch, mega):
    """A third of the rows are versions of one story, with six own words each: only frequent words are shared."""
    monkeypatch.setattr(neardup, "RARE", 8)
    monkeypatch.setattr(neardup, "HOT", 16)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "SAMPLE", 2)
    monkeypatch.setattr(neardup, "MEGA", mega)
    monkeypatch.setattr(neardup.keys_of, "__defaults__", (8, neardup.ROWS, 2))
    rng = random.Random(3)
    story = [f"s{i}" for i in range(26)]
    texts = {i: " ".join(rng.sample(story, 25) + [f"own{i}x{j}" for j in range(6)]) for i in range(120)}
    texts |= {1000 + i: " ".join(f"z{i}x{j}" for j in range(30)) for i in range(240)}
    got = grouped(spark, texts)
    assert got == closed(texts) and len(got) == 120 * 119 // 2


@pytest.mark.parametrize("n", [60, 1000, 5000])
def test_families_of_any_size_come_out_whole(spark, n):
    """The group is whole at every size, with production parameters; twice as many other rows beside it."""
    texts = [(i, " ".join([*(f"s{j}" for j in range(30)), *(f"own{i}x{j}" for j in range(6))])) for i in range(n)]
    texts += [(100_000 + i, " ".join(f"z{i}x{j}" for j in range(30))) for i in range(2 * n)]
    out = neardup.groups(spark.createDataFrame(texts, "id long, text string"), "id", F.col("text")).collect()
    assert len(out) == n and len({r["grp"] for r in out}) == 1 and max(r["row"] for r in out) == n - 1


def test_keys_lose_no_alike_pair():
    """Whatever counts as rare, two alike sets meet on a rare token, or have alike frequent parts, which only bands may miss."""
    texts = list(edited(random.Random(5), 80).values())
    flat, offsets = X.token_sets(texts)
    counts = np.ones(neardup.SLOTS, np.uint16)
    slots, n = np.unique(neardup.slot(flat), return_counts=True)
    counts[slots] = n
    for rare in (4, 1000):
        row, key, most, band = neardup.keys_of(flat, offsets, counts, 0.6, rare=rare)
        keys = [{k: m for k, m in zip(key[(row == i) & ~band], most[(row == i) & ~band])} for i in range(len(texts))]
        sizes, common = np.diff(offsets), [set(flat[a:b][counts[neardup.slot(flat[a:b])] > rare]) for a, b in zip(offsets, offsets[1:])]
        for a, b in itertools.combinations(range(len(texts)), 2):
            if alike(texts[a], texts[b]):
                met = any(sizes[b] <= keys[a][k] and sizes[a] <= keys[b][k] for k in keys[a].keys() & keys[b].keys())
                assert met or len(common[a] & common[b]) >= 0.6 * len(common[a] | common[b])


def test_parts_of_the_keys_are_all_keys():
    """What is shuffled at once is about half of the keys, and the parts together are all of them, each once."""
    flat, offsets = X.token_sets(list(edited(random.Random(6), 80).values()))
    counts = np.ones(neardup.SLOTS, np.uint16)
    slots, n = np.unique(neardup.slot(flat), return_counts=True)
    counts[slots] = n
    for rare in (4, 1000):
        of = lambda **part: sorted(zip(*(c.tolist() for c in neardup.keys_of(flat, offsets, counts, 0.6, rare=rare, **part)), strict=True))
        parts = [of(part=part, parts=neardup.PARTS) for part in range(neardup.PARTS)]
        assert sorted(sum(parts, [])) == of() and max(map(len, parts)) < 0.6 * len(of())


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_cells_of_hot_keys_equal_all_pairs(size, monkeypatch):
    """Left rows meet right rows of their cell in another group, wherever the batches are cut."""
    monkeypatch.setattr(neardup, "CELLS", 8)
    rng = np.random.default_rng(8)
    near = rng.integers(0, 2, 4) * 255  # fingerprints that are equal or far apart
    rows = [(key, cell, int(side), int(rng.integers(3)), int(rng.integers(40)), int(n) << 32 | int(n) * 5 // 3, *[int(rng.choice(near))] * 3) for key in (-3, 5) for cell in (0, 1 << 32, 1 << 32 | 1) for side, n in zip(np.sort(rng.integers(0, 3, 15)), rng.integers(10, 30, 15))]
    rows.append((9, 0, 1, 0, 1, 10 << 32 | 10, 0, 0, 0))  # no left row
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + size])], ["key", "cell", "side", "grp", "cls", "room", "b0", "b1", "b2"]) for a in range(0, len(rows), size)]
    got = sorted((r["a"], r["b"]) for b in neardup._pairs_of_cells(0.6)(iter(batches)) for r in b.to_pylist())
    want = []
    for a, b in itertools.product(rows, rows):
        na, nb = a[5] >> 32, b[5] >> 32
        if a[:2] == b[:2] and a[2] == 0 < b[2] and a[3] != b[3] and (a[4] < b[4] or b[2] == 2) and na <= b[5] & 0xFFFFFFFF and nb <= a[5] & 0xFFFFFFFF:
            if sum((x ^ y).bit_count() for x, y in zip(a[6:], b[6:])) <= (na + nb) * 0.25 + 1e-6:
                want.append((min(a[4], b[4]), max(a[4], b[4])))
    assert got == sorted(want) and want


def test_near_duplicates_leave_no_shuffle_of_tables_behind(spark, monkeypatch):
    """When a table is written, the shuffles of those before it are gone from the disk."""
    disk, seen, write = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), [], neardup.written

    def shuffled():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    def writing(df, name):
        before = shuffled()
        out = write(df, name)
        for _ in range(50):
            if not (left := shuffled() - before):
                break
            time.sleep(0.1)
        seen.append(name)
        assert not left, name
        return out

    monkeypatch.setattr(neardup, "written", writing)
    before = spark.conf.get(shared.FREE_SHUFFLES)
    neardup.groups(spark.createDataFrame(list(edited(random.Random(7), 20).items()), "id long, text string"), "id", F.col("text")).count()
    assert seen.count("candidates") == neardup.PARTS and spark.conf.get(shared.FREE_SHUFFLES) == before


def items(spark, rows):
    return spark.createDataFrame(rows, "item_row long, edition_date date, id string, category string, country string, source string, score int, published_at timestamp")


D, T = dt.date(2026, 7, 30), dt.datetime(2026, 7, 30, 1)


def random_items(rng, n):
    cats, lands, srcs = ["AI", " ai", "　AI ", None, "", "X"], ["A", None, " ", "国际", "a "], ["One", "one ", "O  ne", None, "", "two.example"]
    return [(i, D, rng.choice(["p", "q", "r", None]), rng.choice(cats), rng.choice(lands), rng.choice(srcs), rng.choice([None, 1, 2, 3]), rng.choice([None, T, T + dt.timedelta(1)])) for i in range(n)]


def order(r):
    return (r[6] is None, -(r[6] or 0), r[7] is None, -(r[7].timestamp() if r[7] else 0), r[0])


def test_first_of_groups(spark):
    rows = random_items(random.Random(4), 300)
    groups = {}
    for r in sorted(rows, key=order):
        cat = (r[3] or "").strip().lower()
        if r[6] is None or not cat:
            continue
        g = groups.setdefault((cat, (r[4] or "").strip().lower() or "国际"), [])
        if len(g) < 3 and (r[2] is None or r[2] not in [x[2] for x in g]):
            g.append(r)
    got = topn.first_of_groups(topn.ranked_input(items(spark, rows).repartition(5))).select("row").collect()
    assert sorted(r[0] for r in got) == sorted(r[0] for g in groups.values() for r in g)
    assert topn.first_of_groups(topn.ranked_input(items(spark, []))).count() == 0


def test_capping(spark):
    rows = random_items(random.Random(6), 400)
    sources = spark.createDataFrame([(1, "One", "one.example", ["O ne"]), (2, "Two", "two.example", None)], "source_id int, source string, domain string, aliases array<string>")
    names = {"one": "#1", "one.example": "#1", "o ne": "#1", "two": "#2", "two.example": "#2"}
    own = {}
    for r in sorted(rows, key=order):
        k = " ".join((r[5] or "").lower().split())
        if k:
            own.setdefault(names.get(k, k), []).append(r[0])
    cap = max(3, int(sum(map(len, own.values())) * 0.05))
    got = capping.over_allowance(capping.coded(items(spark, rows), sources)).collect()
    assert sorted(r[0] for r in got) == sorted(i for v in own.values() for i in v[cap:])
    assert capping.over_allowance(capping.coded(items(spark, []), sources)).count() == 0


def test_truncation(spark):
    rng, rows = random.Random(8), []
    ends = ["after the storm", "in early spring", "under new rules"]
    for i in range(400):
        s = f"Crews moved the heavy equipment to the northern harbour {rng.choice(ends)}. Officials expect the ordered parts to arrive {rng.choice(ends)}"
        rows.append(("a", i, s + ("." if i % 4 else "")))
    cut = {1000: "Crews moved the heavy equipment to the", 1001: "Crews moved the heavy equi", 1002: "Crews moved the heavy equipment to the north…", 1003: "Crews moved <a hre", 1004: "Officials expect the ordered [+120 chars]"}
    whole = {1100: "Crews moved the heavy equipment.", 1101: None, 1102: "", 1103: "<p>Crews moved the heavy equipment to the northern harbour after the storm.</p>", 1104: "Is it so?”"}
    df = spark.createDataFrame([*rows, *(("a", k, t) for k, t in {**cut, **whole}.items())], "record_set string, row_key long, text string")
    assert {r["row_key"] for r in truncation.judged(df).where("cut").collect()} == set(cut)
    assert truncation.judged(df.limit(0)).count() == 0


ROWS = "row long, nid string, title string"


def clean(df):
    return df.select("row", history.normal_id(F.col("nid")).alias("nid"), "title")


def sequential(old, new):
    """The repeats among ``new`` as a pass row by row finds them."""
    key = lambda x: x.strip().lower() if x else None
    ids, texts, want = {key(x[1]) for x in old} - {None}, [x[2] for x in old], set()
    for i, nid, t in new:
        nid = key(nid)
        if (nid and nid in ids) or any(alike(t, o) for o in texts):
            want.add(i)
        else:
            texts.append(t)
            ids |= {nid} - {None}
    return want


def new_store(spark, tmp_path, old):
    return history.AcceptedStore.found(spark, f"file://{tmp_path}/store", clean(spark.createDataFrame(old, ROWS)))


def repeats(store, spark, part):
    """The repeats of a batch; the rest is appended."""
    rows = store.probe(clean(spark.createDataFrame(part, ROWS))).select("row", "nid", "cls", "toks", "repeat").collect()
    store.append(spark.createDataFrame([(r["row"], r["nid"], r["cls"], r["toks"]) for r in rows if not r["repeat"]], history.SETS))
    return {r["row"] for r in rows if r["repeat"]}


def titles_of(rng, n):
    titles = [" ".join(rng.sample(WORDS, 9)) for _ in range(n)]

    def near(t):
        w = t.split()
        w[rng.randrange(len(w))] = rng.choice(WORDS)
        return " ".join(w)

    old = [(i, f"id{i}", t) for i, t in enumerate(titles)] + [(900, None, None)]
    new = [(i, rng.choice([f"ID{rng.randrange(90)} ", None, f"n{i % 7}"]), rng.choice([near(rng.choice(titles)), " ".join(rng.sample(WORDS, 9)), None, near(titles[0])])) for i in range(n)]
    return old, new


@pytest.mark.parametrize("sent, segments", [(20_000, 16), (0, 1)])
def test_history(spark, tmp_path, monkeypatch, sent, segments):
    """Broadcast or shuffled, with and without compaction; every batch by a store opened anew."""
    monkeypatch.setattr(history, "SENT", sent)
    monkeypatch.setattr(history, "SEGMENTS", segments)
    old, new = titles_of(random.Random(9), 60)
    path, got = new_store(spark, tmp_path, old).path, set()
    for part in (new[:20], new[20:40], new[40:]):
        got |= repeats(history.AcceptedStore.open(spark, path), spark, part)
    assert got == sequential(old, new)
    first = history.AcceptedStore.open(spark, path, 0).probe(clean(spark.createDataFrame(new, ROWS)))
    assert {r["row"] for r in first.where("repeat").collect()} == got


def test_history_opened_in_another_session(spark, tmp_path):
    """A store founded by one process serves another, which never sees the history's titles."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from tidewire.shared import ship_package; ship_package(s)
from tidewire.llm import history
history.AcceptedStore.found(s, "file://{tmp_path}/store", s.createDataFrame([(1, "a", "one two three four five six")], {ROWS!r}))
"""
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=120)
    store = history.AcceptedStore.open(spark, f"file://{tmp_path}/store")
    assert repeats(store, spark, [(1, None, "one two three four five sex"), (2, "A", None), (3, "b", "quite other words")]) == {1, 2}


def test_history_of_nothing(spark, tmp_path):
    """An empty history accepts all first rows, an empty batch changes nothing."""
    store = history.AcceptedStore.found(spark, f"file://{tmp_path}/store", clean(spark.createDataFrame([], ROWS)))
    assert repeats(store, spark, [(1, "a", "one two three"), (2, "A ", None), (3, None, "one two three"), (4, None, ""), (5, None, None)]) == {2, 3}
    assert store.probe(clean(spark.createDataFrame([], ROWS))).count() == 0 and store.version == 1


def test_history_of_a_much_varied_headline(spark, tmp_path):
    """The incoming titles share only frequent words with the accepted ones and with each other."""
    head = [f"head{i}" for i in range(9)]
    old = [(i, None, " ".join([*head, f"own{i}"])) for i in range(600)]
    new = [(i, None, " ".join([*head, f"fresh{i}"])) for i in range(10)] + [(99, None, "nothing in common with it")]
    assert repeats(new_store(spark, tmp_path, old), spark, new) == set(range(10))


@pytest.mark.parametrize("hot", [1024, 20])
def test_batch_with_a_family(spark, tmp_path, monkeypatch, hot):
    """A third of a batch tells of one thing; in hot buckets only leaders meet all, and the result is a sequential pass's."""
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(history, "LEADERS", 4)
    rng = random.Random(6)
    head = [f"head{i}" for i in range(12)]
    new = [(i, None, " ".join(rng.sample(head, 9) + [f"own{i}"])) for i in range(150)] + [(1000 + i, None, " ".join(rng.sample(WORDS, 9))) for i in range(150)]
    assert repeats(new_store(spark, tmp_path, [(1, None, "no such words")]), spark, new) == sequential([], new)


def test_packing():
    assert packing.best_fill([(5, 2), (3, 3)], 11) == (11, {5: 1, 3: 2})
    rng = random.Random(10)
    df = pd.DataFrame({"doc_id": range(500), "n_tokens": [rng.choice([rng.randrange(1, 60), rng.randrange(1, 700), 512, 1500]) for _ in range(500)]})
    out = packing.pack_shard(df, 512)
    assert out.groupby("container")["n_tokens"].sum().max() <= 512
    assert (out.groupby("doc_id")["n_tokens"].sum() == df.set_index("doc_id")["n_tokens"]).all()
    divided = out[out["part"] > 0]["doc_id"].unique()
    assert set(divided) <= set(df[df["n_tokens"] > 512]["doc_id"])
    assert out["n_tokens"].sum() / out["container"].nunique() / 512 > 0.98
    assert packing.pack_shard(df, 512).equals(out)
    best = max(sum(c) for k in range(4) for c in itertools.combinations([9, 8, 4, 4, 3], k) if sum(c) <= 14)
    assert packing.best_fill([(9, 1), (8, 1), (4, 2), (3, 1)], 14)[0] == best


def test_packing_of_tables(spark):
    sizes = packing.token_counts(spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "word " * 3000)], "doc_id long, text string"))
    limits = spark.createDataFrame([(1, "short", 512), (2, "none", None)], "limit_id int, container_kind string, capacity_tokens int")
    out = packing.pack(sizes, limits).toPandas()
    assert set(out["doc_id"]) == {1, 4} and out.groupby(["shard", "container"])["n_tokens"].sum().max() <= 512
    assert packing.pack(sizes, limits.limit(0)).count() == 0


def test_leakage(spark):
    rng = random.Random(11)
    passage = [rng.choice(WORDS) for _ in range(30)]
    zh = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(40))
    other = lambda n: [rng.choice(["x" + w for w in WORDS]) for _ in range(n)]
    docs = {
        1: " ".join(other(20) + passage[5:17] + other(9)),
        2: " ".join(other(20) + passage[5:16] + other(9)),
        3: "<p>" + "&nbsp;".join(w.upper() for w in passage[:12]) + "</p>",
        4: "前" + "，".join(zh[3:23]) + "后",
        5: zh[3:22],
        6: "\n".join("<b>" + w[0] + "</b>" + w[1:] for w in passage[10:24]),
        7: None,
        8: " ".join(passage[15:] + passage[:15]),
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    it = spark.createDataFrame([(1, "en", " ".join(passage)), (2, "zh", zh), (3, "en", None), (4, None, "short one")], "item_id long, lang string, passage string")
    got = {(r["doc_id"], r["item_id"]): r for r in leakage.tiled(df, it).collect()}
    assert set(got) == {(1, 1), (3, 1), (4, 2), (6, 1), (8, 1)}
    assert got[1, 1]["longest"] == 12 and got[8, 1]["n_tiles"] == 2 and got[8, 1]["marked"] == 30
    assert set((r[0], r[1]) for r in leakage.tiled(df, it, block=1).select("doc_id", "item_id").collect()) == set(got)
    assert leakage.tiled(df, it.limit(0)).count() == 0 and leakage.tiled(df.limit(0), it).count() == 0


def test_tiles_mark_nothing_twice():
    a, b = np.arange(30, dtype=np.uint64), np.concatenate([np.arange(15, 30), np.arange(15)]).astype(np.uint64)
    pairs = [(w, k) for w in range(26) for k in range(26) if (a[w : w + 5] == b[k : k + 5]).all()]
    assert sorted(packing_free(leakage.tiles(pairs, 5, a, b))) == [(0, 15, 15), (15, 0, 15)]


def packing_free(t):
    return [tuple(map(int, x)) for x in t]


PII = {
    "Mail jo.doe+tips@mail.example.net now": [("email", "jo.doe+tips@mail.example.net")],
    "to press [at] post [dot] rowei [dot] test ok": [("email", "press [at] post [dot] rowei [dot] test")],
    "write desk at cosharvu dot invalid, please": [("email", "desk at cosharvu dot invalid")],
    "root@node2 and 55@8 GHz, @flartre_desk": [],
    "Call +44 (0)1632 960 317 or (907) 555-0150.": [("phone", "+44 (0)1632 960 317"), ("phone", "(907) 555-0150")],
    "电话０１０－５５５０４２２７。": [("phone", "０１０－５５５０４２２７")],
    "tax QQ 29 14 97 C. The office": [("identity", "QQ 29 14 97 C")],
    "证件号码是991738 20020110 6922。": [("identity", "991738 20020110 6922")],
    "See ISBN 000-0-7236-5128-0, part 9746-13-007, 2026-07-09": [],
    "at Flat 34, 286 Meibenflarl Drive.": [("address", "Flat 34, 286 Meibenflarl Drive")],
    "at 316 reirorv court on": [("address", "316 reirorv court")],
    "in March 2029, giving Kaehudei a way to": [],
    "at 823, rue de Raeshes, Jaetroskeisstraße 724, 53099 Triatreidrei": [("address", "823, rue de Raeshes"), ("address", "Jaetroskeisstraße 724, 53099 Triatreidrei")],
    "稿件寄往伦西市利森巷683号附4号": [("address", "伦西市利森巷683号")],
}


@pytest.mark.parametrize("t", PII)
def test_forms(t):
    assert [(k, t[a:b]) for a, b, k in pii.protected(pii.same_length(t))] == PII[t]


def test_personal_information(spark):
    rng, rows, want = random.Random(12), [], set()
    for i in range(200):
        given, sur = rng.choice(["Petra", "Omar", "Yuki"]), "Zar" + "".join(rng.choices("abcdeiou", k=6))
        t = f"Ask for {given} {sur} at 907-555-{i:04d}. The Petra probe fell silent."
        rows.append((i, t))
        want |= {(i, "name", t.index(given)), (i, "phone", t.index("907"))}
    rows += [(1000 + i, "The Marine Works plan grew and the Harbour Group agreed.") for i in range(3000)]
    rows += [(900, None), (901, ""), (902, "Dr. Zarexan told the panel.")]
    want.add((902, "name", 4))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["kind"], r["start_at"]) for r in pii.mentions(docs).collect()}
    assert got == want
    assert pii.mentions(docs.limit(0)).count() == 0
