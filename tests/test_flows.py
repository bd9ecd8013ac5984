"""Waves of sources, stateful streams with timers and expiry, enrichment in batches, clustered places, logs in windows, language order."""

import random
import time
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from prospector.operators import health, search, waves
from prospector.sources import places
from prospector.streaming import enrichment, health_state


def test_waves_isolate_failures_and_follow_low_yields(spark, tmp_path):
    scans = spark.sparkContext.accumulator(0)

    def counted(n, bad=0):
        def each(batches):
            for b in batches:
                scans.add(len(b))
                yield b

        return lambda: spark.range(n + bad).mapInPandas(each, "id long").withColumn("name", F.when(F.col("id") < n, F.lit("x")))

    def broken():
        raise RuntimeError("no answer\nat all")

    late = lambda: spark.range(30).withColumn("name", F.when(F.col("id") == 17, F.raise_error(F.lit("torn"))).otherwise("x"))
    sources = [
        waves.Source("good", counted(50, 3), ["spare"]), waves.Source("poor", counted(5), ["spare", "none", "unknown"]), waves.Source("broken", broken, ["spare", "extra"]), waves.Source("torn", late), waves.Source("empty", counted(0)),
        waves.Source("spare", counted(2), ["never"]), waves.Source("extra", counted(25)), waves.Source("never", counted(9)), waves.Source("none", counted(9), configured=False), waves.Source("shut", counted(9), open=True),
    ]
    runs = waves.run_sources(spark, sources, ["good", "poor", "broken", "torn", "empty", "shut"], str(tmp_path), F.col("name").isNotNull())
    got = {r["source"]: (r["status"], r["returned"], r["invalid"], r["fallback"]) for r in runs.collect()}
    assert got == {
        "good": ("SOURCE_SUCCESS_WITH_WARNINGS", 50, 3, False), "poor": ("SOURCE_SUCCESS", 5, 0, False), "spare": ("SOURCE_SUCCESS", 2, 0, True), "none": ("SOURCE_NOT_CONFIGURED", 0, 0, True),
        "broken": ("SOURCE_ERROR", 0, 0, False), "extra": ("SOURCE_SUCCESS", 25, 0, True), "torn": ("SOURCE_ERROR", 0, 0, False), "empty": ("NO_RESULTS_FROM_SOURCE", 0, 0, False), "shut": ("SOURCE_CIRCUIT_OPEN", 0, 0, False),
    }
    assert [r["source"] for r in runs.collect()][:4] == ["good", "poor", "spare", "none"]
    assert scans.value == 53 + 5 + 2 + 25  # each source was read once
    assert {r["source"]: r["message"] for r in runs.collect()}["broken"] == "no answer"
    assert waves.results_of(spark, runs).groupBy("source").count().orderBy("source").collect() == [("extra", 25), ("good", 50), ("poor", 5), ("spare", 2)]
    assert search.outcome(runs, F.lit(82)).first()["outcome"] == "SUCCESS_WITH_WARNINGS"
    assert waves.results_of(spark, runs.where("source = 'torn'")) is None


@pytest.fixture
def rocks(spark):
    for k, v in health_state.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in health_state.STORE:
        spark.conf.unset(k)


def drained(query_of, checkpoint, **trigger):
    query = query_of().option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
    ended = query.awaitTermination(90)
    query.stop()
    assert ended


def test_health_with_timers_equals_a_fold(rocks, tmp_path):
    spark, rng, start = rocks, random.Random(5), 1_700_000_000
    batches, at = [], start
    for _ in range(4):
        rows = []
        for i in range(40):
            at += rng.choice([1, 5, 30, 130])
            rows.append((rng.choice("ab"), at, i, rng.random() < 0.4, float(rng.randrange(100)) if rng.random() < 0.9 else None))
        batches.append(rows)
    at += 1
    batches.append([("c", at + k, k, False, 1.0) for k in range(3)])
    batches.append([("d", at + 500, 0, True, 1.0)])  # only moves the clock
    schema = "source string, s long, id long, ok boolean, value double"
    stream = lambda: health_state.source_health(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("s")))
    out = lambda: stream().writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/out"))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i in (1, 3, 5):  # the stream stops and starts again from its checkpoint
            drained(out, f"{tmp_path}/checkpoint")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    kept, want = {}, {}
    for rows in batches:
        for s, ts, _, ok, value in sorted(rows, key=lambda r: (r[1], r[2])):
            kept[s] = health_state.step(kept.get(s, ("CLOSED", 0, -1.0, 0, None, 0.0)), float(ts), ok, value)
        want |= {s: k for s, k in kept.items()}
    last = {}
    for r in sorted((r for r in got if r["state"] != "HALF_OPEN"), key=lambda r: (r["batch"], r["at"])):
        last[r["source"]] = (r["state"], r["failures"], r["trips"], None if r["latency"] is None else round(r["latency"], 6))
    assert last == {s: (k[0], k[1], k[3], None if k[4] is None else round(k[4], 6)) for s, k in want.items()}
    half = [r for r in got if r["source"] == "c" and r["state"] == "HALF_OPEN"]
    assert [int(r["at"].timestamp()) for r in half] == [at + 2 + health.COOL_DOWN_S]  # seen without a request of c
    log = spark.createDataFrame([r for rows in batches for r in rows if r[4] is not None], schema).withColumn("ts", F.timestamp_seconds("s"))
    moving = {r["source"]: round(r["latency"], 6) for r in health.moving_latencies(log).collect()}
    assert moving == {s: round(k[4], 6) for s, k in want.items() if k[4] is not None}  # the batch says the same


def test_cached_answers_expire(rocks, tmp_path):
    spark = rocks
    schema = "key string, id long, answer string"
    out = lambda: health_state.cached_answers(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 4000).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out")
    ask = lambda rows: (spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in"), drained(out, f"{tmp_path}/checkpoint", once=True))
    ask([("k", 1, None), ("k", 2, "old"), ("k", 3, None), ("l", 4, "kept")])
    time.sleep(5)
    ask([("k", 5, None), ("l", 6, "new"), ("l", 7, None)])
    got = sorted((r["id"], r["key"], r["answer"], r["hit"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "k", None, False), (2, "k", "old", False), (3, "k", "old", True), (4, "l", "kept", False), (5, "k", None, False), (6, "l", "new", False), (7, "l", "new", True)]


HTML = '<html><a href="mailto:Oi@padariaze.com.br">x</a><a href="https://wa.me/5588999991234">w</a><a href="/blog">b</a></html>'


def test_enrichment_in_batches_that_repeat(spark, tmp_path):
    pages = spark.createDataFrame([(2, "https://www.padariaze.com.br/", HTML), (1, "http://padariaze.com.br/a", "<html>older</html>"), (3, "https://barlua.com.br", HTML.replace("Oi@", "pic@2x.")), (4, "https://x.com.br", None)], "page_id long, url string, html string")
    sites = enrichment.pages_by_site(pages.where("page_id <> 1"))
    assert {r["domain"] for r in enrichment.pages_by_site(pages).collect()} == {"padariaze.com.br", "barlua.com.br"}
    rows = [(1, "Padaria Zé", None, "www.padariaze.com.br", None, ["a"], 5.0), (2, "Padaria Ze", "contato@padariaze.com.br", None, "889", None, 9.0), (3, "Bar Lua", None, "barlua.com.br", "", [], None), (4, "X", "x@gmail.com", None, None, [], 1.0), (5, None, None, "none.com.br", None, ["ENRICHED"], 2.0)]
    rows += [(10 + i, "Y", None, None, None, [], float(-i)) for i in range(6)]
    schema = "id long, name string, email string, website string, whatsapp string, tags array<string>, rank_score double"
    base = spark.createDataFrame(rows, schema)
    work = lambda df: enrichment.enriched(df, sites)
    got = {r["id"]: r for r in work(base).collect()}
    assert len(got) == len(rows) and all("ENRICHED" in r["tags"] for r in got.values()) and got[5]["tags"] == ["ENRICHED"]
    assert (got[1]["email"], got[1]["whatsapp"], got[1]["found"], got[1]["checked"]) == ("oi@padariaze.com.br", "88999991234", ["whatsapp", "email"], True) and got[1]["flags"]["blog"]
    assert (got[2]["website"], got[2]["email"], got[2]["whatsapp"], got[2]["found"]) == ("padariaze.com.br", "contato@padariaze.com.br", "889", ["website"])
    assert (got[4]["found"], got[4]["checked"], got[5]["checked"], got[4]["flags"]) == ([], False, False, None)

    base.coalesce(1).write.parquet(f"{tmp_path}/in")
    pending = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    enrichment.enrich_stream(pending(), work, out, f"{tmp_path}/checkpoint").awaitTermination()
    shape = lambda: sorted((r["batch"], r["turn"], r["id"]) for r in spark.read.parquet(out).select("batch", "turn", "id").collect())
    first = shape()
    assert [i for _, turn, i in first if turn == 0] == [1, 2, 4, 5, 10] and len(first) == len(rows)

    def torn(df):
        if df.where("id = 3").count():
            raise RuntimeError("lost between the writes")
        return work(df)

    with pytest.raises(RuntimeError):
        enrichment.write_batch(base, 0, torn, out)
    enrichment.write_batch(base.union(base), 0, work, out)  # tried again, with repeated rows
    assert shape() == first
    enrichment.enrich_stream(pending(), work, out, f"{tmp_path}/checkpoint").awaitTermination()  # nothing new
    assert shape() == first


def test_clustered_places_are_scanned_in_part(spark, tmp_path):
    xy = spark.range(60_000).select((F.rand(1) * 360 - 180).alias("longitude"), (F.rand(2) * 180 - 90).alias("latitude"), F.when(F.col("id") % 3 == 0, "BR").otherwise("PT").alias("country"), F.repeat(F.col("id").cast("string"), 20).alias("name"))
    rows = xy.withColumn("bbox", F.struct(F.col("longitude").alias("xmin"), F.col("longitude").alias("xmax"), F.col("latitude").alias("ymin"), F.col("latitude").alias("ymax")))
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    places.write_clustered(rows, f"{tmp_path}/clustered", ["country"], files=4, group_bytes=128 << 10)
    box = {"south": -8.0, "west": -41.0, "north": -3.0, "east": -36.0}
    got = places.read_places(spark, f"{tmp_path}/clustered", **box, folders={"country": "BR"})
    want = places.read_places(spark, f"{tmp_path}/rows", **box).where("country = 'BR'")
    assert sorted(r["name"] for r in got.collect()) == sorted(r["name"] for r in want.collect()) and got.count() > 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "bbox.xmin" in plan.split("PushedFilters")[1] and "country" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]

    def met(folder):
        hit = total = 0
        for f in (tmp_path / folder).rglob("*.parquet"):
            meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                stat = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
                x, y = stat["bbox.xmin"], stat["bbox.ymin"]
                total += 1
                hit += x.max >= box["west"] and x.min <= box["east"] and y.max >= box["south"] and y.min <= box["north"]
        return hit, total

    hit, total = met("clustered")
    assert total > 20 and hit <= total / 8, (hit, total)


@pytest.mark.parametrize("window", [25, 60, 100_000])
def test_recent_success_in_windows(spark, window):
    rng = random.Random(window)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.randrange(10**6), i, rng.choice([True, False, False, None]), "x") for i in range(700)] + [(7, i, i, False, "x") for i in range(130)]
    log = spark.createDataFrame(rows, "source long, s long, id long, ok boolean, _pos string").withColumn("ts", F.timestamp_seconds("s"))
    by, want = defaultdict(list), {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by[r[0]].append((r[2], bool(r[3])))
    for own in by.values():
        run = 0
        for k, (i, ok) in enumerate(own):
            run = 0 if ok else run + 1
            last = [x for _, x in own[max(0, k - 19) : k + 1]]
            want[i if own is not by[7] else -1 - i] = (round(sum(last) / len(last), 9), run)
    got = health.recent_success(log.drop("_pos"), window).collect()
    assert len(got) == len(rows)
    assert {(-1 - r["id"] if r["source"] == 7 else r["id"]): (round(r["success_rate"], 9), r["failures"]) for r in got} == want
    assert health.recent_success(log.limit(0).drop("_pos"), window).count() == 0


def test_names_in_the_order_of_the_language(spark):
    names = ["zebra", "Ávila", "avila", "Avila", "ávila", "ação", "acao", "Ação", "bar", "Bar", "bár", "É", "e", "f", "açaí"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)] + [(None, 99)], "name string, key int")
    got = [r["name"] for r in df.orderBy(*search.result_order("name")).collect()]
    assert got == ["açaí", "acao", "ação", "Ação", "avila", "Avila", "ávila", "Ávila", "bar", "Bar", "bár", "e", "É", "f", "zebra", None]
