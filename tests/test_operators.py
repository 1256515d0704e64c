"""Folds, rounds, state and readers against plain loops."""

import datetime as dt
import hashlib
import itertools
import json
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidewire.config import CATEGORIES
from tidewire.functions import similarity, text
from tidewire.operators import anomaly, clustering, enrich, events, linkage, registry, reports, scoring, selection, views
from tidewire.plans import link_plans
from tidewire.sources import feeds, files, sinks


def test_two_caps(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.choice("pqrs"), rng.randrange(5)) for i in range(40)]
    df = spark.createDataFrame(rows, "row long, key_a string, key_b string, score int")
    got = [(r["row"], r["relaxed"]) for r in selection.greedy_two_caps(df, [F.desc("score"), F.asc("row")], 36, 10, 2, 1).collect()]
    pool, taken = sorted(rows, key=lambda r: (-r[3], r[0]))[:36], []
    for k, (a, b) in enumerate(((True, True), (False, True), (False, False))):
        for r in pool:
            if len(taken) < 10 and r[0] not in [t[0] for t, _ in taken]:
                ok = (not a or sum(t[1] == r[1] for t, _ in taken) < 2) and (not b or sum(t[2] == r[2] for t, _ in taken) < 1)
                if ok:
                    taken.append((r, k))
    assert got == [(t[0], k) for t, k in taken]


def test_spotlight(spark):
    rows = [(1, 1, "e1", "c1", "s1", 90, 5), (2, 2, "e1", "c2", "s2", 80, 4), (3, 3, "e2", "c1", "s1", 70, 3), (4, 4, "e3", "c3", "s3", 10, 2)]
    df = spark.createDataFrame(rows, "ord int, row long, event string, category string, source string, score int, ts int")
    assert [r["row"] for r in selection.spotlight(df, 36, 3).orderBy("place").collect()] == [1, 4, 3]


def test_capped(spark):
    df = spark.createDataFrame([(i, "a" if i < 8 else "b", -i) for i in range(10)], "row int, k string, s int")
    got = [r["row"] for r in selection.capped_per_key(df, "k", [F.desc("s")], 3, 6).collect()]
    assert got == [0, 1, 2, 8, 9, 3]


def test_leaders_equal_a_sequential_pass(spark):
    rng = random.Random(5)
    edges = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(60)) if a < b}
    lead = {}
    for i in range(40):
        earlier = [j for j in range(i) if lead.get(j) == j and (j, i) in edges]
        lead[i] = earlier[0] if earlier else i
    nodes = spark.range(40).select(F.col("id").alias("row"), F.col("id").alias("ord"))
    got = clustering.leaders(nodes, spark.createDataFrame(sorted(edges), "row_a long, row_b long"))
    assert {r["row"]: r["leader"] for r in got.collect()} == lead


WORDS = ["launch", "Harbor", "NATO", "radar", "treaty", "Orbital", "quantum", "crew", "depot", "signal", "卫星发射", "无人机"]


def norm(t):
    return re.sub(r"[^a-z0-9\u4e00-\u9fff]+", "", t.lower())


def tokens(t):
    stop = {"a", "an", "and", "after", "as", "at", "by", "for", "from", "in", "into", "its", "new", "of", "on", "out", "over", "the", "to", "us", "with", "says", "said"}
    raw = re.findall(r"[A-Za-z][A-Za-z0-9-]*|[\u3400-\u9fff]{2,}", t)
    return {x.lower() for x in raw} - stop, {x.lower() for x in raw if re.fullmatch(r"[A-Z][A-Z0-9-]{2,}", x)}


def same(a, b):
    na, nb = norm(a), norm(b)
    if na == nb:
        return "words"
    (ta, ca), (tb, cb) = tokens(a), tokens(b)
    n = len(ta & tb)
    share = n / min(len(ta), len(tb)) if ta and tb else 0
    if (n >= 4 and share >= 0.5) or (n >= 3 and share >= 0.35 and ta & tb & ca & cb):
        return "words"
    return "ratio" if min(len(na), len(nb)) > 24 and SequenceMatcher(None, na, nb).ratio() >= 0.9 else ""


def articles(rng, n):
    t0, rows = dt.datetime(2026, 7, 20), []
    for i in range(n):
        title = " ".join(rng.choice(WORDS) for _ in range(rng.choice([2, 5, 7, 9])))
        if rows and rng.random() < 0.4:  # one that differs in a few characters, or not at all
            title = list(rng.choice(rows)[2])
            for _ in range(rng.randrange(4)):
                title[rng.randrange(len(title))] = rng.choice("xyz")
            title = "".join(title)
        desc = rng.choice(["", "short", " ".join(rng.choice(WORDS) for _ in range(30)), "LONDON (Reuters) - " + "crews moved to the harbor " * 5])
        rows.append((i, t0 + dt.timedelta(minutes=rng.randrange(4000)), title, desc, rng.choice(["One", "Reuters", "Two"]), rng.choice(["a.example", "b.example", "reuters.com"]), rng.choice([f"http://x/{rng.randrange(n)}", ""])))
    return rows


def test_pairs_of_one_event(spark):
    rows = articles(random.Random(7), 120)
    df = linkage.titled(spark.createDataFrame([r[:3] for r in rows], "row long, ts timestamp, title string"))
    later = lambda a, b: (a, b) if (a[1], -a[0]) < (b[1], -b[0]) else (b, a)
    near = [later(a, b) for a, b in itertools.combinations(rows, 2) if abs(a[1] - b[1]) <= dt.timedelta(hours=24)]
    want = {kind: {tuple(sorted((a[0], b[0]))) for a, b in near if same(a[2], b[2]) == kind} for kind in ("words", "ratio")}
    got = {tuple(r) for r in linkage.pairs_by_words(df).collect()}
    assert got == want["words"] and want["ratio"]
    ratio = {tuple(r) for r in linkage.pairs_by_ratio(df).collect()}
    assert want["ratio"] <= ratio <= want["ratio"] | want["words"]


def shuffled_rows(spark, action):
    """Rows that the action's stages write to shuffles."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    total = lambda: sum(s.shuffleWriteRecords() for s in (sc._jsc.sc().listenerBus().waitUntilEmpty(30_000), jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())))[1])
    store = sc._jsc.sc().statusStore()
    before = total()
    return action(), total() - before


def test_pairs_of_one_event_in_blocks_send_each_title_a_few_times(spark, monkeypatch):
    rows = articles(random.Random(13), 300)
    rows = [(r[0], dt.datetime(2026, 7, 20, 12) if r[0] % 5 == 0 else r[1], r[2]) for r in rows]  # many without a date of their own
    df = spark.createDataFrame(rows, "row long, ts timestamp, title string")
    later = lambda a, b: (a, b) if (a[1], -a[0]) < (b[1], -b[0]) else (b, a)
    near = [later(a, b) for a, b in itertools.combinations(rows, 2) if abs(a[1] - b[1]) <= dt.timedelta(hours=24)]
    want = sorted(tuple(sorted((a[0], b[0]))) for a, b in near if same(a[2], b[2]))
    got, sent = shuffled_rows(spark, lambda: sorted(map(tuple, linkage.same_event_pairs(df).collect())))
    assert got == want and sent <= 2 * len(rows) + 100  # not one row for each word or trigram
    monkeypatch.setattr(linkage, "BLOCK", 70)
    assert sorted(map(tuple, linkage.same_event_pairs(df).collect())) == want


def sequential(rows):
    """Clusters, groups and counts as one pass in the order of time makes them."""
    wire = lambda r, desc: "wire:reuters" if r[5] == "reuters.com" or r[4].lower() == "reuters" or "(Reuters)" in desc else ""
    lead, urls, out = [], {}, {}

    def merge(t, r):
        d, own = t["desc"], r[3]
        passed = len(d) >= 80 and len(own) >= 80 and SequenceMatcher(None, d.lower()[:700], own.lower()[:700]).ratio() >= 0.88
        w = wire(t["row"], d) or wire(r, own)
        a, b = norm(t["row"][2]), norm(r[2])
        passed = passed or bool(w) and min(len(a), len(b)) >= 24 and SequenceMatcher(None, a, b).ratio() >= 0.94
        group = wire(r, own) or "outlet:" + r[5]
        if passed:
            group = w or t["evidence"][0][1]
            group = "syndication:" + hashlib.sha1(a.encode()).hexdigest()[:12] if group.startswith("outlet:") else group
            t["evidence"][0] = (t["evidence"][0][0], group)
        if r[6] and r[6] not in [u for u, _ in t["evidence"]]:
            t["evidence"].append((r[6], group))
        t["desc"] = t["desc"] or own
        t["n"] += 1

    for r in sorted(rows, key=lambda r: (-r[1].timestamp(), r[0])):
        t = urls.get(r[6]) if r[6] else None
        t = t or next((x for x in lead if abs(x["row"][1] - r[1]) <= dt.timedelta(hours=24) and same(r[2], x["row"][2])), None)
        if t:
            merge(t, r)
        else:
            t = {"row": r, "desc": r[3], "n": 1, "evidence": [(r[6], wire(r, r[3]) or "outlet:" + r[5])]}
            lead.append(t)
            if r[6]:
                urls[r[6]] = t
        out[r[0]] = t["row"][0]
    return out, {t["row"][0]: (t["n"], len(t["evidence"]), len({g for _, g in t["evidence"]}), t["desc"]) for t in lead}


def test_clusters_and_their_evidence_equal_a_sequential_pass(spark):
    rows = articles(random.Random(11), 150)
    df = spark.createDataFrame(rows, "row long, ts timestamp, title string, description string, source string, domain string, url string")
    df = df.withColumn("ord", F.struct((-F.unix_micros("ts")).alias("t"), F.col("row").alias("n")))
    lead = clustering.leaders(df.select("row", "ord", "url"), linkage.same_event_pairs(df.select("row", "ts", "title")))
    want, merged = sequential(rows)
    assert {r["row"]: r["leader"] for r in lead.collect()} == want
    got = {r["leader"]: (r["n_members"], r["n_evidence"], r["corroboration"], r["description"]) for r in clustering.merged(clustering.evidence(df.join(lead, "row"))).collect()}
    assert got == merged


def test_only_what_shares_a_cluster_is_merged(spark, sf, monkeypatch):
    lead = {r["row"]: r["leader"] for r in link_plans.leaders(spark, sf).collect()}
    whole = link_plans.title_rows(link_plans.collected_rows(spark, sf)).join(link_plans.leaders(spark, sf), "row")
    want = {tuple(r) for r in clustering.merged(clustering.evidence(whole)).drop("description").collect()}
    seen, evidence = [], clustering.evidence
    monkeypatch.setattr(clustering, "evidence", lambda rows: seen.extend(r["row"] for r in rows.select("row").collect()) or evidence(rows))
    assert {tuple(r) for r in link_plans.merged_evidence(spark, sf).collect()} == want
    shared = {x for k, x in lead.items() if k != x}
    assert sorted(seen) == sorted(k for k, x in lead.items() if x in shared) and 0 < len(seen) < len(lead)


def test_ratio_bounds_lose_none(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh", k=rng.randrange(25, 60))) for _ in range(20)]
    pairs = [(a, "".join(c if rng.random() > 0.06 else rng.choice("xyz") for c in a)) for a in base for _ in range(5)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({"ga": similarity.grams(F.col("a")), "gb": similarity.grams(F.col("b"))})
    for r in df.select("a", "b", similarity.may_be_close(F.col("a"), F.col("b"), F.col("ga"), F.col("gb"), 0.9).alias("may")).collect():
        assert r["may"] or SequenceMatcher(None, r["a"], r["b"]).ratio() < 0.9


def record(spark, e, d, i, g, t, score=1):
    return spark.sql(f"SELECT '{e}' event, DATE '{d}' day, '{i}' item, '{g}' grp, '{t}' title, 'AI' category, '' summary, {score} score, TIMESTAMP_NTZ '{d} 00:00:00' ts, {int(i)} `row`")


def test_registry(spark):
    row = lambda *a: record(spark, *a)
    old = registry.batch_records(row("a", "2026-01-01", "1", "g", "first").union(row("z", "2024-01-01", "9", "g", "gone")))
    new = registry.batch_records(row("a", "2026-01-03", "2", "h", "second").union(row("a", "2026-01-03", "4", "g", "third", 0)).union(row("b", "2026-01-03", "3", "h", "new")))
    got = {r["event"]: r for r in registry.upsert(old, new, F.lit("2026-01-03").cast("date")).collect()}
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert (a["items"], a["groups"], a["title"], a["status"], len(a["timeline"])) == (["1", "2", "4"], ["g", "h"], "third", "tracking", 3)
    assert got["b"]["status"] == "new"
    assert registry.upsert(old.limit(0), new.limit(0), F.lit("2026-01-03").cast("date")).count() == 0


def test_ledger_keeps_what_is_resolved(spark):
    rows = [("p", "e", "2026-01-01", "2026-02-01", "s", "open", ["1", "2"], 1), ("p", "e", "2026-01-02", "2026-02-02", "s", "confirmed", ["2", "3"], 2), ("q", "e", "2026-01-01", "2026-01-05", "s", "open", ["9"], 1), ("r", "e", "2026-01-01", None, "s", None, ["8"], 1)]
    df = spark.createDataFrame(rows, "forecast string, event string, created string, due string, statement string, status string, evidence array<string>, seq int")
    got = {r["forecast"]: (r["status"], r["evidence"]) for r in registry.ledger(df, F.lit("2026-01-05")).collect()}
    assert got == {"p": ("confirmed", ["1", "2", "3"]), "q": ("due", ["9"]), "r": ("open", ["8"])}


def test_anomalies(spark):
    day = lambda n: dt.date(2026, 7, n)
    rows = [(day(n), "AI", ["chip"], "g1") for n in range(1, 10)] + [(day(10), "AI", ["Chip", "new"], g) for g in ("g1", "g2", "g2", "g3")] + [(day(10), "无人系统", [], "g1")]
    df = spark.createDataFrame(rows, "day date, category string, tags array<string>, grp string")
    got = {(r["dimension"], r["name"]): (r["current_count"], r["severity"]) for r in anomaly.signals(df, F.lit(day(10))).collect()}
    assert got == {("category", "AI"): (4, "high"), ("entity", "Chip"): (4, "high"), ("entity", "new"): (4, "high")}
    assert anomaly.signals(df.where("day > '2026-07-05'"), F.lit(day(10))).count() == 0


def test_scores(spark):
    now = F.lit("2026-07-16 00:00:00").cast("timestamp")
    rows = [(1, "Satellite launch", "x" * 90, None, "e.gov", "S"), (2, "Sponsored content on satellite", "", "2026-07-15 12:00:00", "e.com", "S"), (3, "Artemis accords", "", "2026-07-15 12:00:00", "e.com", "S"), (4, "Missile attack podcast", "", "2026-07-15 23:00:00", "x.y.com", "S")]
    df = spark.createDataFrame(rows, "row int, title string, description string, published_at string, domain string, source string").withColumns({"published_at": F.col("published_at").cast("timestamp"), "url": F.lit("http://e/1"), "category": F.lit("")})
    hosts = spark.createDataFrame([(1, "y.com", 14), (0, "com", 11)], "place int, host string, weight int")
    df = scoring.weighted_outlets(scoring.prepared(df, now), hosts.where("host != 'com'"), spark.createDataFrame([("T", 5)], "name string, weight int")).withColumn("corroboration", F.lit(3))
    got = {r["row"]: r for r in scoring.scored(df, now).collect()}
    assert set(got) == {1, 4}
    assert (got[1]["weight"], got[1]["parts"]["date_penalty"], got[1]["parts"]["recency"], got[1]["parts"]["evidence"]) == (18, -7, 8, 3)
    # 15 + 14 + 10 + 20 (19.5, half to even) + 11 (missile 5, attack 6) + 4 + 2 + 8 - 12
    assert (got[4]["raw_score"], got[4]["parts"]["recency"], got[4]["best"]["name"]) == (72, 20, "军事动态")
    assert got[4]["reasons"][-1] == "编辑质量降权 -12"


def test_lexicon_equals_single_searches(spark):
    words = scoring.WORDS
    texts = ["a drone swarm and counter-uas (uas), llm-chip", "nato artemis [sponsored] sponsored content", "无人机群与人工智能大模型", "launches launch; large language model", "robotics' robotic vehicle"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from tidewire.functions import lexicon

    got = [set(r[0]) for r in df.select(lexicon.occurring(F.col("t"), words)).collect()]
    want = [{w for w in words if (w in t if re.search("[㐀-鿿]", w) else re.search(rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])", t))} for t in texts]
    assert got == want


def test_event_ids(spark):
    items = spark.createDataFrame([(1, "n1"), (2, "n2"), (3, "n3")], "row long, id string")
    links = spark.createDataFrame([(1, "o1", "evt-a", dt.date(2026, 1, 1), 50, False), (1, "o2", "evt-b", dt.date(2026, 1, 2), 45, True), (2, "o3", "", dt.date(2026, 1, 1), 90, True), (3, "o4", "evt-c", dt.date(2026, 1, 1), 40, False)], "row long, prev_id string, prev_event string, prev_day date, points int, same_story boolean")
    got = {r["row"]: r["event_id"] for r in events.event_ids(items, links, spark.createDataFrame([("x", "evt-x")], "id string, event string")).collect()}
    sha = lambda x: "evt-" + hashlib.sha1(x.encode()).hexdigest()[:12]
    assert got == {1: "evt-b", 2: sha("o3"), 3: sha("n3")}


def test_denials_are_disputes(spark):
    df = spark.sql("SELECT 'Ministry denies radar breach at depot' title, '' summary, 2 corroboration, array('g', 'g', '') `groups`, array('fact one', '') facts, array(named_struct('day', DATE '2026-01-01', 'title', 'Radar breach at depot confirmed', 'summary', ''), named_struct('day', DATE '2026-01-02', 'title', 'Other', 'summary', '')) related")
    r = events.evidence_matrix(df).first()
    assert (r["overall"], len(r["disputes"]), r["groups"], r["claims"][0]["status"]) == ("contested", 1, ["g"], "multi-source-context")


def test_key_facts():
    said = "Crews moved to the harbor, and officials denied the plan; the budget grew"
    assert reports.distinct_clauses(["Crews moved to the harbor", "crews moved to the harbour", "officials denied the plan", "the budget grew"], "Crews moved to the harbor") == ["officials denied the plan", "the budget grew"]
    assert reports.distinct_clauses([said], said) == []


def test_report_rules(spark):
    rows = [(dt.date(2026, 7, 1), f"i{i}", "t", "s", "AI", "http://a", "evt-0123456789ab", "S", ["s!"] if i == 3 else []) for i in range(9)] + [(dt.date(2026, 7, 1), "i0", "", "s", "X", "ftp://a", "bad", None, None)]
    df = spark.createDataFrame(rows, "edition_date date, id string, title string, summary string, category string, url string, event_id string, source string, key_facts array<string>")
    got = {r["rule"]: r["n"] for r in reports.report_violations(df).collect()}
    assert got == {"repeated id": 1, "missing title": 1, "missing source": 1, "unknown category": 1, "unusable address": 1, "unusable event": 1, "summary repeated as a fact": 1}
    assert CATEGORIES


def test_runs_are_not_repeated(spark):
    row = lambda s, d, n, v: F.struct(F.lit(s).alias("state"), F.lit(d).alias("edition_date"), F.lit(n).alias("n_items"), F.lit(v).alias("schema_version"))
    say = lambda st, force=False, need=0: tuple(spark.range(1).select(reports.needs_run(st, F.lit("d"), F.lit(force), need).alias("x")).first()["x"])
    assert say(row("ok", "d", 10, 9)) == (False, "healthy_edition_exists") and say(row("ok", "d", 10, 8), need=9)[1] == "schema_upgrade_required"
    assert say(row("failed", "d", 10, 9))[0] and say(row("ok", "d", 10, 9), True)[1] == "manual_force_refresh"


def test_batches_ask_again_in_halves():
    rows, asked = [{"id": str(i)} for i in range(4)], []

    def partly(batch):
        asked.append([r["id"] for r in batch])
        return {r["id"]: {} for r in batch if r["id"] != "2" or len(batch) == 1} if len(asked) > 1 else {"0": {}, "1": {}}

    done, said = enrich.in_batches(rows, partly, size=4)
    assert asked == [["0", "1", "2", "3"], ["2"], ["3"]] and len(done) == 4 and said["reason"] == "complete_after_retry"

    def broken(batch):
        raise OSError

    done, said = enrich.in_batches(rows, broken, size=1)
    assert not done and (said["requests"], said["errors"], said["missing"], said["reason"]) == (2, 2, 4, "provider_circuit_breaker")
    assert enrich.in_batches([], broken)[1]["reason"] == "not_needed"


def test_answers():
    assert enrich.parse_object("```json\n{\"a\": 1}\n```") == {"a": 1}
    assert [enrich.place(x, 3) for x in (1, "2", 3.0, 0, 4, 1.5, True, None, "x")] == [1, 2, 3, None, None, None, None, None, None]
    batch = [{"id": "a"}, {"id": "b"}]
    assert enrich.answered(batch, {"items": [{"index": 2, "v": 1}, {"index": 2, "v": 2}, {"index": 3}, 7]}) == {"b": {"index": 2, "v": 1}}
    assert enrich.provider({"ai_provider": "auto"}, {"x": "", "y": "k"}) == "y" and enrich.provider({"ai_provider": "z"}, {"y": "k"}) is None


def test_reader(spark):
    assert views.terms("a bb a", ("cc",)) == ["bb", "cc", "a"]
    df = spark.createDataFrame([("A <b> cc",)], "t string")
    assert df.select(views.marked(F.col("t"), ["cc", "a"])).first()[0] == "<mark>A</mark> &lt;b&gt; <mark>cc</mark>"
    marks = spark.createDataFrame([("u", "k1", 1, "s")], "user string, key string, at int, snapshot string")
    changes = spark.createDataFrame([("u", "k1", 2, "s"), ("u", "k2", 3, "t"), ("u", "k3", 4, "x"), ("u", "k3", 5, "x")], "user string, key string, at int, snapshot string")
    assert [r["key"] for r in views.toggled(marks, changes).collect()] == ["k2"]


def test_last(spark):
    got = spark.sql("SELECT array(1,2,3) a").select(registry.last(F.col("a"), 2).alias("x"), registry.last(F.col("a"), 5).alias("y")).first()
    assert (got["x"], got["y"]) == ([2, 3], [1, 2, 3])


def test_half_even(spark):
    df = spark.createDataFrame([("2.5",), ("3.5",)], "x string").select(F.bround(F.col("x").cast("double")).alias("y"))
    assert [r["y"] for r in df.collect()] == [2.0, 4.0]
    assert spark.range(1).select(scoring.fused(F.lit(None).cast("int"), F.lit(7)).alias("s")).first()["s"] == 7


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<rss xmlns:media="m"><channel><item><title>T &amp;amp; U</title><link>http://a.com/x?utm_source=f</link><description>&lt;p&gt;Body&lt;/p&gt;</description>
      <pubDate>Thu, 30 Jul 2026 17:13:13 +0000</pubDate><media:group><media:thumbnail url="http://i/1.jpg"/></media:group></item><item><title>no address</title></item><item><title> </title><link>http://a.com/y</link></item></channel></rss>""")
    (tmp_path / "b.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="http://b.com/z"/><link rel="alternate" href="http://b.com/y"/><summary>first</summary><content>second</content><updated>bad</updated></entry></feed>')
    (tmp_path / "c.xml").write_text("<broken")
    rows = {r["title"]: r for r in feeds.read_feeds(spark, str(tmp_path), F.lit("2026-07-30 12:00:00").cast("timestamp")).collect()}
    assert set(rows) == {"T & U", "A"}
    assert rows["T & U"]["description"] == "Body" and rows["T & U"]["image"] == "http://i/1.jpg" and not rows["T & U"]["date_estimated"] and rows["T & U"]["url"] == "http://a.com/x"
    assert rows["A"]["date_estimated"] and str(rows["A"]["published_at"]) == "2026-07-29 12:00:00" and rows["A"]["url"] == "http://b.com/y" and rows["A"]["description"] == "first"
    assert feeds.preprint_query('swarm "robotics"') == '(ti:"swarm robotics" OR abs:"swarm robotics")'


def test_preprints(spark, tmp_path):
    entry = lambda i, at: f'<entry><id>http://x/abs/{i}</id><title>T {i}</title><summary>S</summary><published>{at}</published><author><name>N</name></author><category term="cs.AI"/></entry>'
    (tmp_path / "a.xml").write_text(f'<feed xmlns="http://www.w3.org/2005/Atom">{entry("1v2", "2026-07-29T00:00:00Z")}{entry("1v1", "2026-07-28T00:00:00Z")}{entry("2v1", "2026-01-01T00:00:00Z")}</feed>')
    (r,) = feeds.read_preprints(spark, str(tmp_path), F.lit("2026-07-30").cast("timestamp")).collect()
    assert (r["id"], r["title"], r["authors"], r["categories"]) == ("1", "T 1v2", ["N"], ["cs.AI"])


def test_landed_documents(spark, tmp_path):
    now = F.lit("2026-07-30 12:00:00").cast("timestamp")
    (tmp_path / "i").mkdir()
    (tmp_path / "i/a.json").write_text('{"articles": [{"title": "T", "url": "http://a.com/1", "seendate": "20260730T010000Z", "domain": "A.com"}, {"title": "", "url": "http://b"}]}')
    (tmp_path / "i/b.json").write_text("<html>")
    (r,) = files.read_index_hits(spark, str(tmp_path / "i"), now).collect()
    assert (r["domain"], r["country"], r["date_estimated"]) == ("a.com", "国际", False)
    assert files.index_query({"a": "x OR y"})["query"] == "(x OR y)"
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.json").write_text('{"items": [{"title": "P", "url": "http://p/1", "categories": ["cs.RO"], "publishedAt": "bad"}, {"title": "no address"}]}')
    (p,) = files.read_papers(spark, str(tmp_path / "p"), now).collect()
    assert (p["id"], p["research_area"], p["date_estimated"], p["primary_category"]) == ("paper-0", "机器人与无人系统", True, "cs.RO")
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.json").write_text('{"generatedAt": "2026-07-30T11:00:00Z", "items": [{"id": "x", "title": "Z", "originalTitle": "O", "url": "http://c/1", "publishedAt": "2026-07-30T10:00:00Z", "sources": [{"evidenceGroup": "G"}, {"domain": "g"}, {"name": "h"}]}, {"id": "y", "title": "Y", "url": "http://c/2", "publishedAt": "bad"}]}')
    back = files.rehydrated(spark, str(tmp_path / "c"))
    (c,) = files.fresh_cache(back, F.col("generated_at"), now, 8, 24).collect()
    assert (c["title"], c["corroboration"]) == ("O", 2) and files.fresh_cache(back, F.col("generated_at"), F.lit("2026-07-31").cast("timestamp"), 8).count() == 0


def test_settings():
    whole = {"categories": dict.fromkeys(CATEGORIES, {}), "history_max_links": 99, "research": {"arxiv_categories": [{"id": " "}, {"id": "cs.AI"}], "collection_keywords": ["swarm", {"query": "q", "priority": "x", "aliases": ["q", "r"]}, 7]}}
    got = files.load_settings(json.dumps(whole))
    assert (got["history_max_links"], got["stream_limit"], got["areas"]) == (5, 300, [{"id": "cs.AI"}])
    assert got["keywords"] == [{"query": "swarm", "label": "swarm", "priority": 8, "aliases": ["swarm"]}, {"query": "q", "label": "q", "priority": 8, "aliases": ["q", "r"]}]
    with pytest.raises(ValueError):
        files.load_settings("{}")


def test_sinks(spark, tmp_path, sf):
    place = f"file://{tmp_path}/a.json"
    sinks.write_text(spark, place, '{"a": 1}')
    sinks.write_text(spark, place, '{"a": 2}')
    assert sinks.read_text(spark, place, {}) == {"a": 2} and sinks.read_text(spark, f"{place}x", {}) == {}
    assert sinks.recipients("a@x; b@x\na@x;") == ["a@x", "b@x"]
    items = spark.read.parquet(f"{sf}/edition_items.parquet")
    plain, page = sinks.digest(items, "H <1>", "http://s")
    assert plain.count("\n") >= 20 and page.startswith("<h1>H &lt;1&gt;</h1>") and page.count("<li>") == 10
    with pytest.raises(ValueError):
        sinks.digest(items.limit(3), "H", "http://s")
    log = spark.createDataFrame([(1, "ok", 10, "m"), (2, "failed", None, "n")], "at int, state string, n int, note string")
    assert tuple(sinks.run_status(log).first()) == (2, "failed", 1, 10, "n")


def test_items(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"title": "A", "url": "http://a.com/1", "publishedAt": "2026-07-15T22:30:00Z"}]')
    (tmp_path / "b.json").write_text('{"items": [{"id": "x", "title": "B", "url": "http://b.com/1", "published_at": "bad"}]}')
    (tmp_path / "c.json").write_text("{not json")
    got = {r["title"]: r for r in files.read_items(spark, str(tmp_path)).collect()}
    assert set(got) == {"A", "B"} and len(got["A"]["id"]) == 14 and got["B"]["id"] == "x" and got["B"]["published_at"] is None
    assert got["A"]["country"] == "国际"


def test_atom(spark, sf):
    doc = sinks.atom_feed(spark.read.parquet(f"{sf}/edition_items.parquet"), "T & U", "http://site")
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring(doc).findall("{http://www.w3.org/2005/Atom}entry")) == 10


def test_stream_of_many_files_equals_the_table(spark, tmp_path):
    """Counts over several micro-batches, each of which changes windows of the one before."""
    from tidewire.streaming import windows

    t0 = dt.datetime(2026, 7, 1)
    rows = [(t0 + dt.timedelta(minutes=17 * i), "ab"[i % 2]) for i in range(90)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, kind string")
    for i in range(3):
        df.where(F.minute("ts") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    got = windows.run_updates(windows.hourly_counts(windows.read_stream(spark, str(tmp_path), "t.parquet"), "ts", "kind"), "hour", "kind")
    want = df.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "kind").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
