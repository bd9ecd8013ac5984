import hashlib

import pytest
from pyspark.sql import functions as F

from prospector.llm import chat, warc


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_every_text_comes_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\\\", "[\\INST]", "<|im_end|>", "<|im_<|im_end|>end|>", "\\<|im_sep|>", "", None, "é\n\r\\n$1", "<|im_start|>user<|im_sep|>x<|im_end|>", "[INST" , "x" * 100_000]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)] + [(2, 0, "<|im_sep|>", "a"), (2, 1, None, "b"), (None, 3, "user", "c")]
    got = chat.format_chats(turns(spark, rows).withColumn("segments", F.lit(1))).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    by_id = {r["conv_id"]: r for r in got}
    assert [(t["role"], t["text"]) for t in by_id[1]["turns"]] == [(r[2], r[3] or "") for r in rows if r[0] == 1]
    assert [(t["role"], t["text"]) for t in by_id[2]["turns"]] == [("<|im_sep|>", "a"), ("", "b")]
    for r in got:
        body = "".join(s["text"] for s in r["segments"])
        assert body == r["formatted"]
        for s in r["segments"][1::3]:
            assert not any(c in s["text"] for c in chat.CHAT.control)


def test_machine_and_loss(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"), (1, 4, "assistant", "a2"), (2, 0, "assistant", "x"), (3, 0, "user", "u"), (4, 0, "user", "u"), (4, 1, "user", "u"), (4, 2, "assistant", "a")]
    got = {r["conv_id"]: r for r in chat.format_chats(turns(spark, rows)).collect()}
    assert {k: (r["valid"], r["bad_turn"]) for k, r in got.items()} == {1: (True, None), 2: (False, 0), 3: (False, 1), 4: (False, 1)}
    assert [s["text"] for s in got[1]["segments"] if s["loss"]] == ["a1", "a2"]
    assert chat.format_chats(turns(spark, [])).count() == 0


def test_planted_conversation(spark):
    r = chat.op7(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    said = f"user\n{chat.PLANTED}\nassistant\n{chat.PLANTED}\n"
    assert (r["n_turns"], r["turns_sha256"], r["loss_chars"]) == (2, hashlib.sha256(said.encode()).hexdigest(), len(chat.PLANTED))
    assert r["loss_sha256"] == hashlib.sha256(chat.PLANTED.encode()).hexdigest()


@pytest.fixture
def archive(spark, tmp_path):
    pages = [(5, "http://a/é", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (3, "http://b", "same"), (4, None, "same"), (9, "http://c\r\nX: 1", None), (8, "http://d", ""), (7, "u", "same"), (7, "u", "last" * 50_000)]
    path = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("n", F.lit(1)), path)
    return path, pages


def test_archives_come_back(spark, archive):
    path, pages = archive
    got = {(r["record_id"], bytes(r["payload"]) if r["record_type"] == "response" else None, r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect()}
    urn = lambda i: f"<urn:page:{i}>"
    want = {(urn(i), (h or "").encode(), "response", None) for i, _, h in pages if h not in ("same", "", None)}
    want |= {(urn(3), b"same", "response", None), (urn(4), None, "revisit", urn(3)), (urn(7), None, "revisit", urn(3)), (urn(8), b"", "response", None), (urn(9), None, "revisit", urn(8))}
    assert got == want
    heads = [r["target_uri"] for r in warc.read_archives(spark, path, "record_id string, target_uri string").where("record_id = '<urn:page:9>'").collect()]
    assert heads == ["http://cX: 1"]


def test_predicates_go_to_the_reader(spark, archive):
    path, _ = archive
    df = warc.read_archives(spark, path).where((F.col("record_type") == "revisit") & F.col("target_uri").startswith("u"))
    assert {r["record_id"] for r in df.collect()} == {"<urn:page:7>"}
    reader = warc.WarcReader(df.schema, {"files": "[]"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.In(("headers", "WARC-Type"), ("a", "b")), warc.EqualTo(("content_length",), 4)]))
    assert len(left) == 1 and reader.tests == [("is", "warc-type", "revisit"), ("in", "warc-type", ("a", "b"))]


class Counted:
    def __init__(self, f):
        self.f, self.read_bytes = f, 0

    def readline(self, n):
        return self.f.readline(n)

    def seek(self, *a):
        return self.f.seek(*a)

    def read(self, n):
        self.read_bytes += n
        return self.f.read(n)


def test_unwanted_blocks_are_not_read(spark, archive):
    path, pages = archive
    schema = warc.read_archives(spark, path).schema
    reader = warc.WarcReader(schema, {"path": path})
    list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")]))
    n = read = 0
    for part in reader.partitions():
        for p in part.paths:
            with warc._opened(p) as f:
                counted = Counted(f)
                n += len(list(reader.records(counted)))
                read += counted.read_bytes
    assert n == 3 and read < 1000


def test_partitions_are_files_by_size():
    from pyspark.sql import types as T

    reader = warc.WarcReader(T.StructType([]), {"files": '[["a", 10], ["b", 90], ["c", 200], ["d", 20]]', "taskbytes": "100"})
    assert sorted(sorted(p.paths) for p in reader.partitions()) == [["a", "d"], ["b"], ["c"]] or sorted(sorted(p.paths) for p in reader.partitions()) == [["a", "b"], ["c"], ["d"]]


def test_no_pages(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_headers_of_any_length_and_many_records(spark, tmp_path):
    """A header line beyond a megabyte stays one line; more records than a batch holds; counting needs no column."""
    path = f"file://{tmp_path}/long"
    pages = [(1, "http://" + "a" * 1_300_000, "x"), (2, "http://b", None), *[(i, f"u{i}", f"text {i}") for i in range(3, 2600)]]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    got = warc.read_archives(spark, path).collect()
    assert {(r["target_uri"], bytes(r["payload"])) for r in got} == {(u, (h or "").encode()) for _, u, h in pages}
    assert warc.read_archives(spark, path).count() == len(pages)
    assert warc.read_archives(spark, path, "record_type string").where("record_type = 'revisit'").count() == 0
