"""Operators on businesses, imports and results whose rules the queries' data don't reach, by hand and by brute force."""

import random

from pyspark.sql import functions as F

from prospector.functions import links
from prospector.operators import business, imports, niches, resolve, search

FORMS = "id long, tax string, domain string, phone string, email string, name string, city string"


def level_by_hand(a, b):
    same = lambda i: a[i] is not None and a[i] == b[i]
    if same(1) or same(2):
        return 3
    n = same(3) + same(4) + (bool(a[5]) and a[6] is not None and a[5:7] == b[5:7])
    return 2 if n >= 2 else n


def test_import_pool_takes_rows_in_order(spark):
    """Against a loop over the rows in which each accepted row joins the pool; chains of matches included."""
    rng = random.Random(5)
    row = lambda i: (i, rng.choice([None, None, f"t{rng.randrange(40)}"]), rng.choice([None, f"d{rng.randrange(40)}"]), rng.choice([None, f"p{rng.randrange(25)}"]), rng.choice([None, f"e{rng.randrange(25)}"]), rng.choice(["", f"n{rng.randrange(30)}"]), "c")
    existing, incoming = [row(1000 + i) for i in range(15)], [row(i) for i in range(150)]
    incoming += [(200 + i, f"x{i // 2}", f"y{(i + 1) // 2}", None, None, "", "c") for i in range(21)]  # each matches the one before
    pool, want = list(existing), {}
    for r in incoming:
        want[r[0]] = max((level_by_hand(r, x) for x in pool), default=0) < 2
        if want[r[0]]:
            pool.append(r)
    got = imports.import_pool(spark.createDataFrame(incoming, FORMS), spark.createDataFrame(existing, FORMS)).collect()
    assert {r["id"]: r["accepted"] for r in got} == want
    assert imports.import_pool(spark.createDataFrame([], FORMS), spark.createDataFrame(existing, FORMS)).count() == 0


def test_keys_that_thousands_share(spark):
    """A placeholder phone with one e-mail on every row: the first row is taken, and no pairs are made; levels against a loop, nulls and empty values included."""
    rows = [(i, None, None, "p", "e" if i % 2 else None, "", "c") for i in range(4000)] + [(5000, None, None, "p", "e", None, None), (5001, None, None, None, None, "", None)]
    got = {r["id"]: (r["accepted"], r["level"]) for r in imports.import_pool(spark.createDataFrame(rows, FORMS), spark.createDataFrame([(9, None, None, "p", None, "", "c")], FORMS)).collect()}
    assert len(got) == len(rows) and all(level == "POSSIBLE_DUPLICATE" for i, (_, level) in got.items() if i != 5001) and got[5001] == (True, "NO_MATCH")
    assert {i for i, (ok, _) in got.items() if ok} == {i for i in range(4000) if i % 2 == 0} | {1, 5001}
    rng = random.Random(9)
    value = lambda k: rng.choice([None, *[f"{k}{i}" for i in range(6)]])
    make = lambda i: (i, value("t") if i % 5 == 0 else None, value("d") if i % 7 == 0 else None, value("p"), value("e"), rng.choice(["", "n1", "n2", None]), rng.choice(["c", "", None]))
    new, old = [make(i) for i in range(120)], [make(i) for i in range(500, 540)]
    names = resolve.LEVELS
    want = {}
    for r in new:
        level, other = min((-level_by_hand(r, x), x[0]) for x in old)
        want[r[0]] = (other if level else None, names[-level])
    assert {r["id"]: (r["match_id"], r["level"]) for r in resolve.import_matches(spark.createDataFrame(new, FORMS), spark.createDataFrame(old, FORMS)).collect()} == want


def test_discovery_import_fills_and_creates(spark):
    base = spark.createDataFrame([(1, "t1", None, None, None, "", "", None, []), (2, None, None, "p", None, "", "", "old", ["x"])], FORMS + ", website string, tags array<string>")
    found = spark.createDataFrame([(10, "t1", None, None, None, "", "", "w1", [], None), (11, None, None, "p", None, "", "", "w2", [], None), (12, None, None, None, None, "", "", "w3", [], 2), (13, None, None, None, None, "", "", "w4", [], None)], FORMS + ", website string, tags array<string>, company_id long")
    after, log = imports.discovery_import(found, base, ["website"])
    assert {r["id"]: (r["website"], r["tags"]) for r in after.collect()} == {1: ("w1", []), 2: ("old", ["x"]), 11: ("w2", ["POSSIBLE_DUPLICATE"]), 13: ("w4", [])}
    assert {r["id"]: (r["outcome"], r["company_id"]) for r in log.collect()} == {10: ("COMPLEMENTED", 1), 11: ("CREATED_TAGGED", 11), 12: ("EXISTING", 2), 13: ("CREATED", 13)}


def test_phones_and_contacts_keep_the_first_spelling_in_source_order(spark):
    rows = spark.createDataFrame([(1, 5, "osm_overpass", "(88) 3611-0000", ["8836110001", None]), (1, 7, "local_db", "8836110002", ["88 3611 0000"])], "cluster long, idx long, source string, phone string, phones array<string>")
    chosen = spark.createDataFrame([(1, "8836110001")], "cluster long, phone string")
    assert business.kept_phones(rows, chosen).first()["phones"] == ["8836110001", "8836110002", "88 3611 0000"]
    people = spark.createDataFrame([(1, 5, "osm_overpass", 0, "JOSÉ Lima"), (1, 7, "local_db", 0, "Ana"), (1, 7, "local_db", 1, "Jose Lima"), (1, 7, "local_db", 2, None)], "cluster long, idx long, source string, pos int, name string")
    assert business.contact_union(people).first()["contacts"] == ["Ana", "Jose Lima"]


def test_outcomes_of_searches(spark):
    run = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    end = lambda runs, found, **kw: search.outcome(runs, F.lit(found), **kw).first()["outcome"]
    assert end(run(), 0) == "FAILED" and end(run("SOURCE_TIMEOUT"), 0) == "FAILED" and end(run("SOURCE_SUCCESS"), 0) == "NO_RESULTS"
    assert end(run("SOURCE_SUCCESS", "SOURCE_ERROR"), 0) == "PARTIAL" and end(run("SOURCE_SUCCESS", "SOURCE_ERROR"), 4) == "SUCCESS_WITH_WARNINGS"
    assert end(run("SOURCE_PARTIAL_RESULTS"), 4) == "PARTIAL" and end(run("SOURCE_SUCCESS"), 4) == "SUCCESS" and end(run("SOURCE_SUCCESS"), 4, stopped=True) == "PARTIAL"


def test_links_and_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    n = lambda v, kind="string": F.lit(v).cast(kind)
    m = lambda *a: one(links.map_links(*[n(x) for x in a[:6]], n(a[6], "double"), n(a[7], "double")))
    assert m("Bar (do Zé)", None, None, None, "Sobral", "CE", None, None)["search_url"].endswith("query=Bar%20(do%20Z%C3%A9)%2C%20Sobral%20-%20CE")
    assert m(None, None, None, None, None, None, -3.5, -40.25)["strategy"] == "coordinates" and m(None, None, None, None, "X", None, 0.0, 0.0)["strategy"] == "city_only"
    assert m("A", "Rua B", "5", "C", "D", "E", -3.5, -40.25)["query"] == "A, Rua B 5, C, D - E" and m(None, "Rua B", None, None, "D", None, None, None)["strategy"] == "address_only"
    assert [one(links.seconds_text(F.lit(s))) for s in (42, 135, 120, -3)] == ["42s", "2min 15s", "2min", "0s"]
    assert one(links.message_link(F.lit("(88) 99999-1234"), F.lit("olá tu"))) == "https://wa.me/5588999991234?text=ol%C3%A1%20tu"
    robots = "User-agent: *\nDisallow: /a\nUser-agent: me\nDisallow: /b\nUser-agent: *\nDisallow: /c"
    assert [one(links.path_allowed(F.lit(robots), F.lit(p), "me")) for p in ("/a1", "/b1", "/c1", "/d")] == [False, False, True, True]


def test_composite_niches_take_terms_in_turn(spark):
    rows = spark.createDataFrame([(0, ["a", "b"], ["1"], []), (1, ["c", "a", "d"], ["1", "2"], ["t"])], "ord int, terms array<string>, codes array<string>, places array<string>")
    assert tuple(niches.composite(rows, 3).first()) == (["a", "c", "b"], ["1", "2"], ["t"])


def test_suggestions(spark):
    def said(found=3, limit=10, radius=None, terms=(), codes=(), related=False, sources=(), fast=False, mode="BALANCED"):
        row = spark.createDataFrame([(found, limit, radius, list(terms), list(codes), related, list(sources), fast, mode)], "found int, limit int, radius double, terms array<string>, codes array<string>, related boolean, sources array<string>, fast boolean, mode string")
        out = row.select(niches.suggestions(*[F.col(c) for c in row.columns]).alias("x")).first()["x"]
        return [(s["kind"], s["values"]) for s in out]

    assert said() == [("radius", ["15"]), ("nearby_cities", ["30"]), ("mode", ["BROAD"])]
    assert said(found=10) == [] and said(radius=100.0, mode="BROAD") == []
    assert said(radius=7.5, mode="BROAD") == [("radius", ["15"]), ("nearby_cities", ["30"])] and said(radius=70.0, mode="BROAD") == [("radius", ["100"])]
    full = said(radius=0.0, terms="abcdefg", codes=["x", "y"], sources=["s"], fast=True)
    assert full == [("radius", ["15"]), ("keywords", list("abcde")), ("cnaes", ["x", "y"]), ("nearby_cities", ["30"]), ("sources", ["s"]), ("mode", ["BROAD"])]
    assert said(codes=["x"], related=True, radius=100.0, fast=True, mode="BROAD") == [("sources", [])]


def test_ties_of_segments(spark):
    codes = spark.createDataFrame([("category", "bar", "tavern", 1, 1), ("category", "bar", "barber", 1, 2), ("category", "hair", "barber", 1, 0), ("category", "amenity=pub", "tavern", 0, 0), ("category", "beauty_salon", "barber", 0, 0), ("activity", "1", "zoo", 0, 0), ("category", "deep", "barber", 3, 0)], "kind string, code string, segment string, level int, ord int")
    names = spark.createDataFrame([("pub", "tavern"), ("pub hair", "barber")], "fragment string, segment string")
    rows = [(1, None, ["bar"], "x", None), (2, None, ["hair", "bar"], "x", None), (3, None, [], "x", "amenity=pub (irish)"), (4, None, None, "x", "Beauty  salon"), (5, None, ["none"], "Pub Hair", "amenity=pub"), (6, "1", ["bar"], "x", None), (7, None, ["bar", "hair"], None, None), (8, "1", ["deep"], "x", None), (9, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, activity string, category_keys array<string>, name string, category string")
    got = {r["id"]: (r["segment"], r["points"]) for r in niches.match_segments(df, codes, names).collect()}
    assert got == {1: ("tavern", 23), 2: ("barber", 23), 3: ("tavern", 20), 4: ("barber", 20), 5: ("barber", 10), 6: ("zoo", 30), 7: ("tavern", 23), 8: ("zoo", 30)}
    assert {r["id"]: r["segment"] for r in niches.match_segments(df, codes, names, "barber").collect()}[1] == "barber"
