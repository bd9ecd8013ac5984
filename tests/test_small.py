"""Functions that no query reaches: payloads, look-ups, scopes, exclusions, small text functions, windows of streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from prospector.functions import text
from prospector.operators import niches, qualify, tables
from prospector.sources import files, payloads, places, registry
from prospector.streaming import events


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_answers_of_map_services(spark, tmp_path):
    nominatim = [{"osm_type": "node", "osm_id": 1, "category": "amenity", "type": "bar", "name": "Bar", "lat": "-3.5", "lon": "x", "address": {"road": "Rua A", "town": "Sobral"}}, {"osm_type": "node", "osm_id": 1, "category": "amenity", "type": "bar", "name": "Bar"}, {"osm_type": "way", "osm_id": 2, "category": "highway", "name": "R"}, {"osm_type": "way", "osm_id": 3, "category": "shop", "name": ""}]
    (tmp_path / "n.json").write_text(json.dumps(nominatim))
    rows = payloads.nominatim(spark, str(tmp_path / "n.json")).collect()
    assert [(r["source_record_id"], r["category"], r["city"], r["lat"], r["lon"]) for r in rows] in ([("node/1", "amenity=bar", "Sobral", -3.5, None)], [("node/1", "amenity=bar", None, None, None)])
    photon = {"features": [{"geometry": {"coordinates": [-40.0, -3.0]}, "properties": {"osm_type": "W", "osm_id": 5, "osm_key": "shop", "osm_value": "bakery", "name": "Pão"}}, {"geometry": None, "properties": {"osm_type": "N", "osm_id": 6, "osm_key": "place", "name": "X"}}]}
    (tmp_path / "p.json").write_text(json.dumps(photon))
    assert [(r["source_record_id"], r["name"], r["lat"], r["lon"]) for r in payloads.photon(spark, str(tmp_path / "p.json")).collect()] == [("way/5", "Pão", -3.0, -40.0)]
    answer = {"cnpj": "1", "razao_social": "A LTDA", "nome_fantasia": "", "descricao_situacao_cadastral": "ativa", "cnae_fiscal": 111301, "porte": "demais", "qsa": [{"nome_socio": str(i), "qualificacao_socio": "q"} for i in range(12)]}
    (tmp_path / "r.json").write_text(json.dumps([answer, {**answer, "cnpj": "2", "descricao_situacao_cadastral": "other", "porte": None}]))
    got = {r["cnpj"]: r for r in payloads.registry_patch(spark, str(tmp_path / "r.json")).collect()}
    assert (got["1"]["status"], got["1"]["activity"], got["1"]["size"], got["1"]["trade_name"], len(got["1"]["partners"])) == ("ATIVA", "0111-3/01", "DEMAIS", None, 10)
    assert got["2"]["status"] is None and got["2"]["size"] is None


def test_payloads_a_line_each(spark, tmp_path):
    answer = lambda k: {"elements": [{"type": "node", "id": 10 * k + i, "lat": -3.0, "lon": -40.0, "tags": {"name": f"Bar {i}", "amenity": "bar", "level": 2}} for i in range(3)] + [{"type": "way", "id": k, "center": {"lat": 1.5, "lon": 2}, "tags": {"shop": "x"}}]}
    lines = [json.dumps(answer(k)) for k in range(400)] + [json.dumps(answer(7)), "{broken", "", '{"other": 1}', '{"elements": [17, {"type": "node", "id": 99999, "tags": {"name": "Only"}}]}']
    (tmp_path / "lines.json").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        raw = payloads.payload_lines(spark, str(tmp_path / "lines.json"))
        assert raw.rdd.getNumPartitions() > 4  # one file, many tasks
        records, bad = payloads.overpass_lines(spark, str(tmp_path / "lines.json"))
        assert {r["reason"]: r["n"] for r in bad.collect()} == {"not_json": 1, "no_elements": 1, "not_an_item": 1, "no_name": 400}
        got = records.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 1201 and {r["category"] for r in got} == {"amenity=bar", None}
    (tmp_path / "whole.json").write_text(json.dumps({"elements": [e for k in range(400) for e in answer(k)["elements"]]}))
    whole, _ = payloads.overpass(spark, str(tmp_path / "whole.json"))
    assert sorted(map(str, whole.collect())) == sorted(str(r) for r in got if r["name"] != "Only")


def test_registry_lookups(spark):
    codes = spark.createDataFrame([("1", "SOBRAL"), ("2", "São Paulo")], "code string, name string")
    assert [r["code"] for r in registry.municipality_code(codes, "sao paulo").collect()] == ["2"]
    records = spark.createDataFrame([("a", "5611", ["1", "2"], ["x"], "e", None), ("b", "9", ["5611"], [], None, "t"), ("c", None, None, [], None, None)], "cnpj string, activity string, secondary_activities array<string>, phones array<string>, email string, trade_name string")
    mapping = spark.createDataFrame([("5611", "global", None), ("5611", "own", "w"), ("1", "first", None)], "activity string, industry_id string, workspace_id string")
    assert {r["cnpj"]: r["industry_id"] for r in registry.niche_of(records, mapping).collect()} == {"a": "own", "b": "own", "c": None}
    assert tuple(registry.counters(records).first()) == (3, 1, 1, 2)
    towns = spark.createDataFrame([("Nova Sobral", "CE"), ("Sobral", "CE"), ("Sobradinho", "DF"), ("Recife", "PE")], "name string, uf string")
    assert [r["name"] for r in files.municipality_suggestions(towns, "sobr").collect()] == ["Sobradinho", "Sobral", "Nova Sobral"]


def test_places_as_records(spark):
    row = ("1", "Bar", "bar", "Rua A, 12B", None, "Sobral", "CE", ["1", "2"], [], ["https://instagram.com/bar", "https://bar.com.br"], ["https://instagram.com/bar", "https://z.org"], -3.0, -40.0, 0.6)
    df = spark.createDataFrame([row, ("2", "B", None, None, None, None, None, None, None, None, None, None, None, None)], "source_id string, name string, category string, street string, postcode string, city string, state string, phones array<string>, emails array<string>, websites array<string>, socials array<string>, latitude double, longitude double, confidence double")
    a, b = places.source_records(df).orderBy("source_record_id").collect()
    assert (a["street"], a["house_number"], a["phone"], a["email"], a["website"], a["confidence"]) == ("Rua A", "12B", "1", None, "https://bar.com.br", "MEDIUM")
    assert [s["key"] for s in a["socials"]] == ["instagram"] and (b["socials"], b["website"], b["confidence"]) == ([], None, "LOW")


def test_small_rules(spark):
    n = lambda v: F.lit(v).cast("string")
    why = lambda name, cat, code: one(spark, qualify.exclusion(n(name), n(cat), n(code), ["igreja", r"\bcon?domin"], ["amenity=bank", "office=*"], ["84"]))
    assert [why("X", "amenity=bank", "84"), why("X", "office=it", None), why("X", "shop=x", "8411"), why("Igréja", "shop=x", "1"), why("X", None, None)] == ["category", "category", "activity", "name", None]
    status = lambda v, ver, inf: one(spark, qualify.field_status(n(v), F.lit(ver), F.lit(inf)))
    assert [status(None, True, False), status("x", True, True), status("x", True, False), status("x", False, False)] == ["UNKNOWN", "INFERRED", "CONFIRMED", "INFERRED"]
    assert one(spark, text.dedup_name(F.lit(" Pão & Cia.  Ltda "))) == "pao  cia  ltda" and one(spark, text.slug(F.lit("Pão & Cia"))) == "pao-cia"
    assert one(spark, text.clean_keyword(F.lit("  a%b_ç (" + "x" * 90))) == ("a b ç  " + "x" * 90)[:60]
    merged = one(spark, tables.merge_maps(F.create_map(F.lit("a"), n("1"), F.lit("b"), n(None)), F.create_map(F.lit("a"), n("2"), F.lit("b"), n("3"), F.lit("c"), n("4"))))
    assert merged == {"a": "1", "b": "3", "c": "4"}


def test_scopes_and_order(spark):
    now = dt.datetime(2026, 1, 31)
    rows = [("w", None, None, now), ("w", now, None, now), ("w", None, now, now - dt.timedelta(days=29)), ("v", None, None, now - dt.timedelta(days=30))]
    df = spark.createDataFrame(rows, "workspace_id string, deleted_at timestamp, archived_at timestamp, at timestamp")
    assert (tables.scoped(df, "w").count(), tables.scoped(df, "w", archived=True).count(), tables.scoped(df, "u").count()) == (1, 2, 0)
    assert tables.keep_recent(df, "at", F.lit(now)).count() == 3
    ranked = spark.createDataFrame([(k, i) for k in "ab" for i in range(5)], "k string, i int")
    assert sorted(map(tuple, niches.last_per_key(ranked, ["k"], [F.desc("i")], 2).collect())) == [("a", 3), ("a", 4), ("b", 3), ("b", 4)]


def test_sessions_and_repeats(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    rows = [(u, base + dt.timedelta(minutes=m), e, "x", 1.0) for u, m, e in [(1, 0, 1), (1, 20, 2), (1, 20, 2), (1, 90, 3), (2, 5, 4), (2, 400, 5)]]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream = events.read_events(spark, f"{tmp_path}/events.parquet", "*.parquet")
    once = events.run_once(events.without_repeats(stream), "once", "append", f"{tmp_path}/c1")
    assert sorted(r["event_id"] for r in once.collect()) == [1, 2, 3, 4, 5]
    got = {(r["user_id"], r["n"]) for r in events.run_once(events.sessions(stream), "sessions", "append", f"{tmp_path}/c2").collect()}
    assert got == {(1, 3), (1, 1), (2, 1)}  # the last session of all is still open


def test_stored_tables_change_in_part(spark, tmp_path):
    import pytest

    from prospector.operators import stored_tables as st

    path = str(tmp_path / "table")
    rows = {i: (i, f"name {i}", i % 5) for i in range(200)} | {None: (None, "none", 0)}
    schema = "id long, name string, age int"
    st.create(spark.createDataFrame(list(rows.values()), schema), path, ["id"], 16)
    files = lambda: {f.relative_to(path) for f in (tmp_path / "table").rglob("*.parquet")}
    same = lambda: sorted(map(str, st.read(spark, path).collect())) == sorted(map(str, spark.createDataFrame(list(rows.values()), schema).collect()))
    before = files()
    change = [(3, "older", 1), (3, "newer", 2), (1000, "new", 9), (None, "other", 1)]
    st.upsert(spark, path, spark.createDataFrame(change, schema), ["id"], 16, F.col("age"))
    rows |= {3: (3, "newer", 2), 1000: (1000, "new", 9), None: (None, "other", 1)}
    assert same() and len(before & files()) >= 13  # three keys lie in three folders at most
    before = files()
    torn = spark.createDataFrame([(5, "x", 1)], schema).withColumn("name", F.when(F.col("age") == 1, F.raise_error(F.lit("torn"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="torn"):
        st.upsert(spark, path, torn, ["id"], 16)
    st.upsert(spark, path, spark.createDataFrame([], schema), ["id"], 16)
    assert same() and files() == before
    assert st.retain(spark, path, F.col("name") != "new") == 1
    del rows[1000]
    assert same() and len(before - files()) == 1
    only = next(iter({r["f"] for r in spark.read.parquet(path).select(F.col("_folder").alias("f")).distinct().collect()}))
    ids = [r["id"] for r in spark.read.parquet(path).where(f"_folder = {only}").collect()]
    before = files()
    assert st.retain(spark, path, ~F.coalesce(F.col("id").isin(*[i for i in ids if i is not None]), F.lit(None in ids))) == len(ids)
    rows = {i: r for i, r in rows.items() if i not in ids}
    assert same() and len(before - files()) == 1 and files() < before
