"""Queries that do a whole job, against brute force on rows that the driver tables lack."""

import hashlib
import itertools
import math
import random
import re
import unicodedata
from collections import defaultdict

from prospector.operators import health, resolve
from prospector.plans.catalogue import QUERIES, rivals, table

DIR = "/root/testdata/sf0.001"


def test_blocking_reads_whole_texts(spark, tmp_path):
    words = lambda i: " ".join("abcdefghij"[int(d)] * 3 for d in str(i))
    rows = [(1, "one two three four five zebra"), (2, "six seven eight nine ten Zebra zebra"), (3, "eleven"), (4, None), (5, "")]
    rows += [(100 + i, f"first {words(1000 + i)} common{' rare' if i < 400 else ''}") for i in range(401)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    blocks = defaultdict(set)
    for i, text in rows:
        for w in re.findall("[a-z]{3,}", (text or "").lower()):
            blocks[w].add(i)
    want = {p for ids in blocks.values() if 2 <= len(ids) <= 400 for p in itertools.combinations(sorted(ids), 2)}
    got = [tuple(r) for r in QUERIES["blocking_pairs"](spark, str(tmp_path)).select("a", "b").collect()]
    assert (1, 2) in got and len(got) == len(want) and set(got) == want


def test_every_document_is_folded(spark, tmp_path):
    def fold(text):
        bare = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", text or ""))
        return hashlib.sha256(re.sub("[^a-z0-9]+", " ", bare.lower()).strip().encode()).hexdigest()

    rows = [(1, "Größe über ÄÖÜ ẞ", "de"), (2, None, "de"), (3, "Šířka, ő ű ł ø", "cs"), (4, "e\u0301te\u0301 Ấn", None), (5, "", "fr"), (6, "日本 İI \u212a \u1e9b", "ja"), (7, "¡Qué!", "es")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder, docs in ((str(tmp_path), rows), (DIR, [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()])):
        got = sorted(map(tuple, QUERIES["fold_text"](spark, folder).select("doc_id", "folded").collect()))
        assert got == sorted((d[0], fold(d[1])) for d in docs)


def test_components_of_all_links(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(300), rng.randrange(250)) for _ in range(260)] + [(400 + i // 2, 400 + (i + 1) // 2) for i in range(60)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    links = spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    for folder, pairs in ((str(tmp_path), rows), (DIR, links)):
        near = defaultdict(set)
        for p, s in pairs:
            near[2 * p].add(2 * s + 1)
            near[2 * s + 1].add(2 * p)
        want = {}
        for node in sorted(near):
            open_ = [] if node in want else [node]
            while open_:
                at = open_.pop()
                if at not in want:
                    want[at] = node
                    open_ += near[at]
        got = [tuple(r) for r in QUERIES["link_components"](spark, folder).select("node", "component").collect()]
        assert len(got) == len(want) and dict(got) == want
        assert folder == DIR or len(set(want.values())) > 10


def test_moving_latency_gathers_no_history(spark):
    rng = random.Random(8)
    rows = [(u, 1_700_000_000 + rng.randrange(40_000), i, rng.random() * 100) for i in range(900) for u in [rng.choice([1, 1, 1, 2, 3])]] + [(9, 5, 1, 4.0)]
    log = spark.createDataFrame(rows, "source long, s long, id long, value double").selectExpr("source", "timestamp_seconds(s) AS ts", "id", "value")
    want = {}
    for u, _, _, v in sorted(rows):
        want[u] = want[u] * health.OLD + v * health.NEW if u in want else v
    got = dict(map(tuple, health.moving_latencies(log).collect()))
    assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-9 for u in want)
    plan = QUERIES["moving_latency"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def level_of(a, b):
    """The level of two prepared records, by plain Python."""

    def grams(s):
        return {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}

    x, y = a["norm"], b["norm"]
    sim = 0.0 if not x or not y else 1.0 if x == y else len(grams(x) & grams(y)) / len(grams(x) | grams(y))
    shared = set(a["tokens"]) & set(b["tokens"])
    if set(a["identity"]) & set(b["identity"]):
        return "EXACT"
    if a["tax"] and b["tax"]:
        return "EXACT" if a["tax"] == b["tax"] else None
    if not fits(a["city_key"], b["city_key"]):
        return None
    if a["domain"] and a["domain"] == b["domain"]:
        return "HIGH" if sim >= 0.3 or shared else "MEDIUM"
    if set(a["phone_keys"]) & set(b["phone_keys"]):
        return "HIGH" if sim >= 0.35 or shared else "MEDIUM"
    meters = None
    if None not in (a["lat"], b["lat"], a["lon"], b["lon"]):
        la, lb = math.radians(a["lat"]), math.radians(b["lat"])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
        meters = 2 * 6_371_000 * math.asin(math.sqrt(h))
    if x == y and a["tokens"]:
        return "LOW" if meters is not None and meters > 1500 else "HIGH"
    if not shared:
        return None
    if re.findall("[0-9]+", x) != re.findall("[0-9]+", y):
        return "LOW"
    near = lambda m: meters is not None and meters <= m
    if set(a["tokens"]) == set(b["tokens"]) and sim >= 0.8 and near(150):
        return "HIGH"
    return "MEDIUM" if sim >= 0.6 and near(300) else "LOW" if sim >= 0.7 else None


def fits(x, y):
    return not x or not y or x in y or y in x


def merged_by_force(rows):
    """levels, (cluster, confidence) by record, and review pairs, by plain Python."""
    blocks = defaultdict(set)
    for i, r in rows.items():
        keys = [("id", k) for k in r["identity"]] + [("cnpj", r["tax"])] * bool(r["tax"]) + [("dom", r["domain"])] * bool(r["domain"]) + [("ph", k) for k in r["phone_keys"]] + [("tok", k) for k in r["tokens"]]
        if r["lat"] is not None and r["lon"] is not None:
            keys.append(("geo", math.floor(r["lat"] / 0.002 + 0.5), math.floor(r["lon"] / 0.002 + 0.5), r["norm"][:1]))
        for k in keys:
            blocks[k].add(i)
    pairs = sorted({p for ids in blocks.values() if 2 <= len(ids) <= 400 for p in itertools.combinations(sorted(ids), 2)})
    levels = {(a, b): v for a, b in pairs if (v := level_of(rows[a], rows[b]))}
    group = {i: {i} for i in rows}
    weakest, review = {}, {k: v for k, v in levels.items() if v in ("MEDIUM", "LOW")}
    for level in ("EXACT", "HIGH"):
        for a, b in sorted(k for k, v in levels.items() if v == level):
            if group[a] is group[b]:
                continue
            both = group[a] | group[b]
            taxes, cities = {rows[i]["tax"] for i in both} - {None}, {rows[i]["city_key"] for i in both}
            same = set(rows[a]["identity"]) & set(rows[b]["identity"])
            if len(taxes) > 1 or (not same and not all(fits(x, y) for x in cities for y in cities)):
                review[a, b] = "MEDIUM"
                continue
            for i in both:
                group[i], weakest[i] = both, level
    clusters = {i: (min(g), weakest.get(i)) for i, g in group.items()}
    return levels, clusters, {(a, b): v for (a, b), v in review.items() if clusters[a][0] != clusters[b][0]}


def test_pairs_clusters_and_reviews_against_a_plain_merge(spark):
    p = resolve.prepare(rivals(lambda name: table(spark, DIR, name)))
    rows = {r["idx"]: r.asDict() for r in p.collect()}
    levels, clusters, review = merged_by_force(rows)
    got = [tuple(r) for r in QUERIES["pair_evidence"](spark, DIR).select("a", "b", "level").collect()]
    assert sorted(got) == sorted((a, b, v) for (a, b), v in levels.items())
    assert set(levels.values()) == {"EXACT", "HIGH", "MEDIUM", "LOW"}
    got = sorted(tuple(r) for r in QUERIES["conflicting_clusters"](spark, DIR).select("idx", "cluster", "confidence").collect())
    assert got == sorted((i, *c) for i, c in clusters.items())
    assert {c[1] for c in clusters.values()} == {"EXACT", "HIGH", None}
    got = sorted(tuple(r) for r in QUERIES["merge_reviews"](spark, DIR).select("a", "b", "level").collect())
    assert got == sorted((a, b, v) for (a, b), v in review.items())
    assert any(levels[k] in ("EXACT", "HIGH") for k in review)


def test_breaker_carries_its_state_over_partitions(spark):
    def fold(events):
        state, failures, opened, trips = "CLOSED", 0, None, 0
        for ts, ok in events:
            if state == "OPEN" and ts - opened < health.COOL_DOWN_S:
                continue
            if ok:
                state, failures, opened = "CLOSED", 0, None
                continue
            failures += 1
            if state == "OPEN" or failures >= health.FAILURES:
                state, opened, trips = "OPEN", ts, trips + 1
        return state, failures, trips

    rng = random.Random(4)
    rows, at = [], 1_700_000_000
    for i in range(6000):
        at += rng.choice([0, 1, 5, 30, 119, 120, 121, 400]) if rng.random() < 0.5 else 0
        rows.append((rng.choice([1, 1, 1, 1, 2, None]), at, i, rng.random() < 0.35))
    rows += [(3, at, 1, False), (3, at, 2, False), (3, at, 3, False), (4, at, 1, None), (5, None, 1, False), (6, at, 7, True), (6, at, 7, True)]
    log = spark.createDataFrame(rows, "source long, s long, id long, ok boolean").selectExpr("source", "timestamp_seconds(s) AS ts", "id", "ok")
    by = defaultdict(list)
    for u, ts, i, ok in rows:
        if ts is not None:
            by[u].append((ts, i, bool(ok)))
    want = {u: fold([(ts, ok) for ts, _, ok in sorted(v)]) for u, v in by.items()}
    for parts in ("1", "8", "50"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r["source"]: (r["state"], r["failures"], r["trips"]) for r in health.breakers(log).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == want
    assert health.breakers(log.limit(0)).isEmpty()
    events = spark.read.parquet(f"{DIR}/events.parquet").selectExpr("user_id", "unix_seconds(cast(ts as timestamp)) AS s", "event_id", "event_type <> 'error' AS ok").collect()
    by = defaultdict(list)
    for u, ts, i, ok in events:
        by[u].append((ts, i, ok))
    got = {r["source"]: (r["state"], r["failures"], r["trips"]) for r in QUERIES["breaker_fold"](spark, DIR).collect()}
    assert got == {u: fold([(ts, ok) for ts, _, ok in sorted(v)]) for u, v in by.items()}
