import json
import random

from pyspark.sql import functions as F

from prospector.operators import graph, health, qualify, resolve, score, tables
from prospector.sources import files, payloads, places, registry
from prospector.streaming import events

RECORD = "idx long, source string, source_record_id string, name string, trade_name string, cnpj string, website string, phones array<string>, city string, street string, lat double, lon double, linked_record_ids array<string>"


def record(i, name, source="osm_overpass", **kw):
    base = {"idx": i, "source": source, "source_record_id": f"r{i}", "name": name, "trade_name": None, "cnpj": None, "website": None, "phones": [], "city": "Sobral", "street": None, "lat": None, "lon": None, "linked_record_ids": []}
    return tuple((base | kw).values())


def resolved(spark, rows):
    p = resolve.prepare(spark.createDataFrame(rows, RECORD), "Sobral")
    levels = resolve.classify(p, resolve.candidate_pairs(resolve.block_keys(p)))
    return {r["idx"]: r["cluster"] for r in resolve.clusters(p, levels).collect()}, {(r["a"], r["b"]): r["level"] for r in levels.collect()}


def test_resolution_cases(spark):
    rows = [
        record(0, "Restaurante Aragão LTDA", "local_db", phones=["88999990000"], cnpj="11222333000181"), record(1, "Restaurante Aragao", phones=["(88) 99999-0000"]),
        record(2, "Padaria Estrela"), record(3, "Padaria Estrela", city="Fortaleza"),
        record(4, "Oficina Zebra", cnpj="11222333000181".replace("11", "22", 1)), record(5, "Oficina Zebra", cnpj="33222333000181"),
        record(6, "Restaurante"), record(7, "Restaurante"),
        record(8, "Floricultura Jasmim Azul", lat=-3.68, lon=-40.35), record(9, "Floricultura Jasmim Roxo", lat=-3.6802, lon=-40.3502),
        record(10, "Qualquer Um", linked_record_ids=["osm_overpass:r11"]), record(11, "Outro Nome"),
    ]
    clusters, levels = resolved(spark, rows)
    assert clusters == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10, 11: 10}
    assert levels[0, 1] == "HIGH" and levels[10, 11] == "EXACT" and (2, 3) not in levels


def test_guards_and_conservation(spark):
    rows = [record(i, f"Loja Unica{i}x{i * i}") for i in range(120)]
    clusters, _ = resolved(spark, rows)
    assert len(set(clusters.values())) == 120
    # A record without a tax id links with two that have different ones: only one of them gets it.
    rows = [record(0, "Casa Verde Limao", cnpj="11222333000181", phones=["8836110000"]), record(1, "Casa Verde Limao", phones=["8836110000"]), record(2, "Casa Verde Limao", cnpj="33222333000181", phones=["8836110000"])]
    assert resolved(spark, rows)[0] == {0: 0, 1: 0, 2: 2}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + rng.randrange(1, 50)) for _ in range(30)]
    rng.shuffle(edges)
    got = dict(map(tuple, graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **{n: 100 for e in edges for n in e if n >= 100}}


def test_fusion(spark):
    rows = [(0, "local_db", "MEDIUM", "A", "88999990000"), (1, "osm_overpass", "HIGH", "B", "8836110000"), (2, "places_overture", "LOW", None, "(88) 99999-0000")]
    df = spark.createDataFrame(rows, "idx long, source string, confidence string, name string, phone string")
    out = {r["field"]: r for r in resolve.fuse(df, df.select("idx", F.lit(0).alias("cluster")), {"phone": ["osm_overpass", "local_db"], "name": ["local_db"]}).collect()}
    assert out["name"]["value"] == "A" and out["phone"]["value"] == "8836110000" and out["phone"]["conflict"]
    assert {a["key"] for a in out["phone"]["alternatives"]} == {"88999990000"}


def test_prospect_score(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "id int, x boolean")
    rules = (score.Rule("no_website", "digital_presence", 15), score.Rule("other", "nowhere", 5), score.Rule("off", "content_need", 5, False))
    got = {r["id"]: r for r in score.prospect_score(df, {"no_website": F.col("x"), "off": F.lit(True)}, rules, {"digital_presence": 0.5, "content_need": 0.5}).collect()}
    assert (got[1]["score"], got[1]["level"], len(got[1]["factors"])) == (50, "MEDIO", 1)
    assert (got[2]["score"], got[2]["level"], got[2]["factors"]) == (0, "BAIXO", [])


def test_rules(spark):
    schema = "website string, phone string, email string, whatsapp string, opened_at timestamp, estimated_size string, industry_id string, city string, state string, tags array<string>, socials int, website_flags array<boolean>, visual boolean, recurring boolean, has_offer boolean"
    df = spark.createDataFrame([(None, "1", None, None, None, "MEDIA", "i", "c", "s", [], 1, [False, False, None], True, None, True)], schema)
    fires = score.evaluators(F.lit("2026-01-01"))
    row = df.select(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in fires.items()]).first().asDict()
    assert {k for k, v in row.items() if v} == set(fires) - {"recurring_content_need", "new_business"}


def test_dimensions(spark):
    names = [c.split(" ")[0] for c in qualify.SCHEMA.split(", ")]
    rows = [{}, {"segment_fit": 100, "ticket": "HIGH", "visual": 100, "recurring": True, "website": "w", "site_status": "ACTIVE", "socials": ["instagram", "tiktok", "youtube"], "sources": 3, "cnpj": "1", "cnpj_active": True, "phone_valid": True, "whatsapp": "1", "email_kind": "own", "verified_days": 5.0, "opened_months": 3.0}]
    df = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], qualify.SCHEMA)
    empty, full = sorted(qualify.qualified(df).collect(), key=lambda r: r["lead_score"])
    assert empty["dimensions"] == {"fit": 0.0, "visual_need": 0.0, "digital_presence": 0.0, "opportunity": 0.0, "contactability": 0.0, "data_quality": 2.0, "recency": 4.0}
    assert (empty["lead_score"], empty["confidence"], empty["qualified"]) == (6, "VERY_LOW", False)
    assert full["dimensions"]["fit"] == 25.0 and full["qualified"] and full["confidence"] == "VERY_HIGH" and len(full["reasons"]) == 8


def test_tables(spark):
    old = spark.createDataFrame([(1, "", "x"), (2, "b", "y"), (3, None, "z")], "k int, name string, fresh string")
    new = spark.createDataFrame([(1, "A", "n1"), (2, "B", "n2")], "k int, name string, fresh string")
    assert sorted(map(tuple, tables.complement(old, new, ["k"], ["name"], ["fresh"]).collect())) == [(1, "A", "n1"), (2, "b", "n2"), (3, None, "z")]
    moved, history = tables.move_stage(old.select(F.col("k").alias("company_id"), F.col("fresh").alias("stage")), spark.createDataFrame([(1,), (9,)], "company_id int"), "WON", F.lit("2026-01-01"))
    assert sorted(map(tuple, moved.collect())) == [(1, "WON"), (2, "y"), (3, "z")] and [tuple(r)[:3] for r in history.collect()] == [(1, "x", "WON")]
    sent = spark.createDataFrame([("a",), ("b",)], "contact string").withColumn("sent_at", F.lit("2026-01-01").cast("timestamp"))
    out, blocked = tables.record_outreach(sent, spark.createDataFrame([("b", "all")], "contact string, channel string"), "email")
    assert [r["contact"] for r in out.collect()] == ["a"] and [r["contact"] for r in blocked.collect()] == ["b"]


def test_breaker(spark):
    fold = lambda es: spark.createDataFrame([(es,)], "e array<struct<ts:long,ok:boolean>>").select(health.breaker(F.col("e")).alias("b")).first()["b"]
    down = [(0, False), (1, False), (2, False)]
    assert fold(down[:2])["state"] == "CLOSED" and fold(down)["state"] == "OPEN"
    assert fold([*down, (50, True)])["state"] == "OPEN"
    assert fold([*down, (130, True)])["state"] == "CLOSED"
    assert (fold([*down, (130, False)])["state"], fold([*down, (130, False)])["trips"]) == ("OPEN", 2)


def test_registry_files(spark, tmp_path):
    def row(n, **kw):
        names = registry.ESTABLISHMENT if n == 30 else registry.COMPANY
        return ";".join(f'"{kw.get(c, "")}"' for c in names)

    a = row(30, root="11222333", order="0001", check_digits="81", status_code="02", start_date="20200131", activity="5611201", secondary_activities="5620104, 4721102", uf="CE", municipality="1559", area1="88", phone1="99990000", street_type="RUA", street="São José", email="X@Y.COM")
    b = row(30, root="99", order="0001", check_digits="00", status_code="08", uf="CE", municipality="1559", activity="5611201")
    (tmp_path / "est").write_bytes("\n".join([a, b, '"short";"row"']).encode("latin-1"))
    (tmp_path / "emp").write_bytes(row(7, root="11222333", legal_name="ARAGÃO LTDA", size_code="01").encode("latin-1"))
    est = registry.filter_establishments(registry.read_raw(spark, str(tmp_path / "est"), registry.ESTABLISHMENT), uf="ce", statuses=["02"], activities=["4721102"])
    (r,) = registry.businesses(est, registry.read_raw(spark, str(tmp_path / "emp"), registry.COMPANY)).collect()
    assert (r["cnpj"], r["name"], r["status"], r["size"], str(r["opened_at"]), r["activity"], r["phones"], r["street"]) == ("11222333000181", "ARAGÃO LTDA", "ATIVA", "ME", "2020-01-31", "5611-2/01", ["88999990000"], "RUA São José")


def test_payloads_and_places(spark, tmp_path):
    elements = [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"amenity": "bar", "name": "B", "contact:phone": "1"}}, {"type": "node", "id": 1, "tags": {"name": "B"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"shop": "x"}}]
    (tmp_path / "o.json").write_text(json.dumps({"elements": elements[::2]}))
    records, left = payloads.overpass(spark, str(tmp_path / "o.json"))
    (r,) = records.collect()
    assert (r["source_record_id"], r["category"], r["phone"], r["lat"]) == ("node/1", "amenity=bar", "1", 1.0) and left.first()["n"] == 1
    df = spark.createDataFrame([("a", 0.5, 0.5), ("b", 2.0, 0.5)], "name string, longitude double, latitude double")
    assert [x["name"] for x in places.within(df, [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]).collect()] == ["a"]


def test_files(spark, tmp_path):
    (tmp_path / "u.csv").write_text("Nome,Cidade,UF,X\n A ,Sobral,CE,1\n,Sobral,CE,2\n")
    rows = files.read_csv(spark, str(tmp_path / "u.csv"), {"Nome": "trade_name", "Cidade": "city", "UF": "state", "X": "__skip__"})
    good, bad = files.split_valid(rows)
    assert [r["trade_name"] for r in good.collect()] == ["A"] and [r["missing"] for r in bad.collect()] == ["trade_name"]
    files.export_csv(spark.createDataFrame([("é", ["a", "b"])], "n string, l array<string>").coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text(encoding="utf-8").splitlines() == ["﻿n;l", "é;a | b"]


def test_streams_match_batches(spark, tmp_path):
    stream = events.read_events(spark, "/root/testdata/sf0.001")
    got = events.run_once(events.windowed(stream), "w", "complete", str(tmp_path / "c1"))
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy(F.date_trunc("hour", F.col("ts")).alias("start"), "event_type").count()
    assert sorted((str(r["start"]), r["event_type"], r["n"]) for r in got.collect()) == sorted((str(r["start"]), r["event_type"], r["count"]) for r in batch.collect())
    log = stream.select(F.col("user_id").alias("source"), "ts", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"), "value")
    last = events.run_once(events.source_health(log), "h", "update", str(tmp_path / "c2"))
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("source"), F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok")).alias("e"))
    fold = e.groupBy("source").agg(F.array_sort(F.collect_list("e")).alias("e")).select("source", health.breaker(F.col("e")).alias("b"))
    assert {r["source"]: r["state"] for r in last.collect()} == {r["source"]: r["b"]["state"] for r in fold.collect()}
