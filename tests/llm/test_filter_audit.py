"""The filter audit against plain Python that applies each order."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from prospector.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string, _words string, kept int"
LABELS = "doc_id long, quality int, toxic int"


def fails_of(docs):
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, _ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and t in least and d > least[t]}
        out.append({k for k, v in f.items() if v})
    return out


def by_hand(docs, labels):
    good, toxic = ({d for d, *m in labels if d is not None and m[i] == 1} for i in (0, 1))
    fails, out = fails_of(docs), []
    for part in {x or "" for _, _, x in docs}:
        own = [(f, d in good, d in toxic) for (d, _, x), f in zip(docs, fails, strict=True) if (x or "") == part]
        rows, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                shapley[f] += len(removed)
                failing = [r for r in own if f in r[0]]
                rows.append((part, "".join(order), step, len(left), len(removed), len(failing) - len(removed), sum(r[0] == {f} for r in own), sum(r[1] for r in removed), sum(r[2] for r in removed)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(11)
    docs = []
    for i in range(150):
        words = [rng.choice(["w", "É", "Q", "x#y"]) + str(rng.randrange(rng.choice([20, 400]))) for _ in range(rng.choice([0, 3, 199, 200, 260]))]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(words), rng.choice(["en", "de", None, ""])))
    docs += [(200 + i, rng.choice(docs)[1], "en") for i in range(60)] + [(300 + i, docs[4][1], "fr") for i in range(90)]
    docs += [(400, None, "xx"), (401, "", "xx"), (None, docs[4][1], "en"), (None, None, None), docs[4], docs[4], (402, "one two " * 40_000, "en"), (403, "\t lead", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).repartition(3)
    got = fa.audit_texts(df, spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == by_hand(docs, labels)
    bare = fa.audit_texts(df.where("lang = 'xx'"), spark.createDataFrame([], LABELS))
    assert sorted(map(tuple, bare.collect())) == by_hand([d for d in docs if d[2] == "xx"], [])
    assert fa.audit_texts(df.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_states_are_shared_and_executed_once(spark, monkeypatch):
    made = []
    real = fa.written
    monkeypatch.setattr(fa, "written", lambda df, tag: made.append(tag) or real(df, tag))
    rows = spark.range(1000).select("id", F.col("id").alias("_state"))
    out = fa.filter_audit(rows, {"x": F.col("id") % 2 == 0, "y": F.col("id") % 3 == 0, "z": F.when(F.col("id") > 500, True)}, F.lit(None), {"odd": F.col("id") % 5 == 0})
    assert made.count("audit-state") == 7  # subsets of three filters, but the whole
    got = {(r["filter_order"], r["step"]): r for r in out.collect()}
    assert len(got) == 18 and got["xyz", 1]["removed"] == 500 and got["zyx", 3]["removed"] == sum(i % 2 == 0 and i % 3 != 0 for i in range(501))
    assert got["xzy", 3]["odd_lost"] == sum(i % 2 and i % 3 == 0 and i % 5 == 0 for i in range(501))
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    with pytest.raises(ValueError):
        fa.filter_audit(rows, {}, F.lit(""), {})
