"""Secret scans: base spans against the patterns as stated, held-out accuracy of the automata, and whole texts."""

import hashlib
import importlib.util
import random
import re

import numpy as np
from pyspark.sql import functions as F

from prospector.llm import secrets as sc
from prospector.llm.common import table

KEYWORDS = "password passwd secret token apikey api_key Password TOKEN API_Key".split()


def stated(text):
    out = []
    patterns = {"assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}
    for k, (kind, (pattern, group, least)) in enumerate(patterns.items()):
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return [(kind, s, e) for s, _, e, kind in sorted(out)]


def test_base_spans():
    rng = random.Random(2)
    pieces = KEYWORDS + ["=", ":", " ", '"', "'", "AKIA", "ABC7", "0af9", "deadbeef" * 3, "x", "é", "𝄞", "\n", "ſ", "K", "hunter2", "."]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 40))) for _ in range(4000)]
    assert [sc.base_spans(t) for t in texts] == [stated(t) for t in texts]
    assert sum(map(len, map(stated, texts))) > 3000


def test_automata_keep_what_is_fixed():
    rng = random.Random(1)
    tree = sc.inferred(["ab" + "".join(rng.choices("xyz", k=12)) for _ in range(200)])
    to, at = tree.to, 0
    for c in "ab":
        assert np.count_nonzero(tree.count[at]) == 1
        at = to[at, sc._ALPHABET.index(c)]
    loop = {int(to[at, sc._ALPHABET.index(c)]) for c in "xyz"}
    assert loop == {at}  # what is random is one state
    assert tree.count[at].sum() == 200 * 13


def test_held_out_accuracy():
    automata, rng, names = sc.fitted(), random.Random(77), list(sc.FORMATS)
    for k, (name, make) in enumerate(sc.FORMATS.items()):
        ratios = automata.ratios([make(rng) for _ in range(400)])
        assert ((ratios - automata.thresholds).max(1) >= 0).mean() > 0.97, name
        assert name == "random" or ((ratios - automata.thresholds).argmax(1) == k).mean() > 0.97, name
    read = set()
    for module in "zipfile._path difflib heapq turtle textwrap dis nntplib trace sched smtpd gettext cgitb profile multiprocessing.managers concurrent.futures.process logging.handlers http.cookiejar email.header json.decoder pickle fractions ipaddress selectors dataclasses enum functools".split():
        try:
            spec = importlib.util.find_spec(module)
        except ModuleNotFoundError:
            continue
        if spec and module not in sc.SOURCES:
            text = open(spec.origin, encoding="utf-8").read()
            read |= {text[s:e] for s, e in sc.candidates(text)}
    ratios = automata.ratios(sorted(read))
    assert len(read) > 1500 and ((ratios - automata.thresholds).max(1) >= 0).mean() < 0.005


def test_scan_of_whole_texts(spark):
    rng = random.Random(9)
    planted, rows = {}, []
    for i, (name, make) in enumerate(sc.FORMATS.items()):
        secret = make(rng)
        lead = "𝄞 é words before it, " * rng.choice([1, 5000]) + "see "
        rows.append((i, f"{lead}{secret}. Then key={secret}, no more", "x"))
        planted[i] = [(len(lead), len(lead) + len(secret)), (len(lead) + len(secret) + 11, len(lead) + 2 * len(secret) + 11)]
    rows += [(100, None, "x"), (101, "", "x"), (None, "password: hunter22", "x"), (103, "token = " + sc._some(rng, 40), "x"), (103, "token = abc", "x"), (104, "plain words, a_long_identifier_name and 8c1f7f60-3a1b-4b6e-9d3f-0a1b2c3d4e5f", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets string").withColumn("kind", F.lit(1)).repartition(3)
    out = sc.secret_scan(df)
    assert out.columns == ["doc_id", "text", "kind", "secrets"] or out.columns == ["doc_id", "text", "secrets", "kind"]
    got = [(r["doc_id"], r["secrets"]) for r in out.collect()]
    assert len(got) == len(rows)
    for i, spans in planted.items():
        own = dict(got)[i]
        assert [(s["start"], s["end"]) for s in own if s["score"] is not None] == spans, list(sc.FORMATS)[i]
        assert i == list(sc.FORMATS).index("random") or {s["kind"] for s in own if s["score"] is not None} == {list(sc.FORMATS)[i]}
    assert dict(got)[100] == [] and dict(got)[101] == [] and dict(got)[104] == []
    assert [(s["kind"], s["start"], s["end"], s["score"]) for s in dict(got)[None]] == [("assign", 0, 18, None)]
    assert sorted([s["kind"] for s in own] for d, own in got if d == 103) == [[], ["assign"]]
    assert sc.secret_scan(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    rows = {r["doc_id"]: r for r in sc.op13(spark, "/root/testdata/sf0.01").collect()}
    docs = table(spark, "/root/testdata/sf0.01", "documents").collect()
    assert len(rows) == len(docs) and sum(r["n_assign"] for r in rows.values()) > 10
    for d in docs:
        own, r = stated(d["text"] or ""), rows[d["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for k, _, _ in own) for kind in sc.BASE_KINDS]
        said = [f"{k}:{s}:{e}" for k, s, e in own]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r["spans"].split(",")) and len(r["spans"].split(",")) >= len(own)
