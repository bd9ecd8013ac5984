"""Stored scores and the rows of an export."""

from pyspark.sql import functions as F

from prospector.operators import score_tables, stored_tables
from prospector.sources import files

SCORED = "company_id long, score long, level string, category_scores map<string,long>, factors array<struct<rule:string,category:string,points:double>>, data_quality int, computed_at timestamp_ntz"


def test_scores_take_the_place_of_older_ones(spark, tmp_path):
    from datetime import datetime

    day = lambda d: datetime(2026, 1, d)
    row = lambda i, s, at, *rules: (i, s, "ALTO", {"fit": s}, [(r, "fit", 10.0) for r in rules], 5, day(at))
    path = str(tmp_path / "scores")
    keep = lambda *rows: score_tables.keep_scores(spark, path, spark.createDataFrame(rows, SCORED), 4)
    read = lambda: {r["company_id"]: (r["score"], [f["rule"] for f in r["factors"]]) for r in stored_tables.read(spark, path).collect()}
    keep(row(1, 10, 1, "a", "b"), row(2, 20, 1), row(1, 11, 2, "c"), row(None, 7, 1, "n"))
    assert read() == {1: (11, ["c"]), 2: (20, []), None: (7, ["n"])}
    keep(row(2, 21, 3, "d"), row(3, 30, 3, "a", "d"))
    keep(row(2, 21, 3, "d"))  # the same again changes nothing
    assert read() == {1: (11, ["c"]), 2: (21, ["d"]), 3: (30, ["a", "d"]), None: (7, ["n"])}
    table = stored_tables.read(spark, path)
    assert sorted((r["company_id"] or 0, r["rule"]) for r in score_tables.factors(table).collect()) == [(0, "n"), (1, "c"), (2, "d"), (3, "a"), (3, "d")]
    assert {r["company_id"] for r in score_tables.stale(table, F.lit(day(3))).collect()} == {1, None}
    keep()
    assert len(read()) == 4


def test_rows_of_an_export(spark):
    text = "name legal_name cnpj cnpj_status category street house_number neighborhood city state postcode phone whatsapp email website confidence quality_label".split()
    kind = ", ".join(f"{c} string" for c in text) + ", phones array<string>, profiles map<string,string>, lat double, lon double, source_labels array<string>, completeness int, conflict_fields array<string>, company_id long"
    some = ["Bar", *[None] * 10, "1", None, None, None, "LOW", "FRACO"]
    df = spark.createDataFrame([(*some, ["1", "2", "3"], {"tiktok": "@t"}, 1.0, -2.25, ["A", "B"], 7, ["x", "y"], 3), (*[None] * len(text), *[None] * 8)], kind)
    first, empty = files.discovery_rows(df).collect()
    assert len(first) == 29 and (first["outros_telefones"], first["fontes"], first["conflitos"], first["ja_no_banco"]) == ("2 | 3", "A + B", "x, y", "sim")
    assert (first["latitude"], first["longitude"], first["tiktok"], first["completude"]) == ("1", "-2.25", "@t", "7") and first["google_maps"].endswith("query=Bar")
    assert {v for k, v in empty.asDict().items() if k not in ("ja_no_banco", "google_maps")} == {""} and empty["ja_no_banco"] == "não"
