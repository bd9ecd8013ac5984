"""Operator 2, WARC: archives written by Spark's text writer and read by a Python data source.

Writing: records are laid out by column expressions (headers, HTTP head, payload) and saved as text whose line separator is
the empty line that ends a record, so Spark's own commit protocol covers lost executors and any file system Spark knows.
Equal payloads are stored once, in the record of the smallest id; the others are `revisit` records that name it.

Reading: the data source plans partitions of whole files, by size; it takes over predicates on the columns that are headers
(record_type, target_uri and so on), parses the head of a record first, and seeks over the block of a record that they
refuse. A block is read only where a payload is asked for by the schema. Spark hands no predicates on elements of a map
to a source, so those on headers['name'] are Spark's own. Records leave a task as Arrow batches of a bounded size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema

from .common import join_counted, scratch_path, table, written

END = "\r\n"
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_length long, headers map<string,string>, payload binary"
#: Columns that are headers, by their names in lower case.
HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: Bytes of files that one task reads; larger files have a task each.
TASK_BYTES = 128 << 20
#: Records and bytes of payload in a batch.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.arrow = to_arrow_schema(schema)
        self.paths = json.loads(options["files"]) if "files" in options else _listed(options["path"])
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes over equality, membership and prefixes on header columns, and on headers; all others stay with Spark."""
        for f in filters:
            kind = {EqualTo: "is", In: "in", StringStartsWith: "begins"}.get(type(f))
            where = f.attribute if kind else ()
            name = HEADER.get(where[0]) if len(where) == 1 else where[1].lower() if len(where) == 2 and where[0] == "headers" else None
            if kind is None or name is None:
                yield f
            else:
                self.tests.append((kind, name, tuple(f.value) if kind == "in" else f.value))

    def partitions(self) -> Sequence[InputPartition]:
        out: list[list[str]] = []
        room = 0
        for path, size in sorted(self.paths, key=lambda x: (-x[1], x[0])):
            if not out or room < size:
                out.append([])
                room = max(self.task_bytes, size)
            out[-1].append(path)
            room -= size
        return [Files(x) for x in out]

    def _wanted(self, head: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            own = head.get(name)
            if own is None or not (own == value if kind == "is" else own in value if kind == "in" else own.startswith(value)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in partition.paths:
            with _opened(path) as f:
                for row in self.records(f):
                    rows.append(row)
                    size += len(row[self.names.index("payload")] or b"") if "payload" in self.names else 0
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        values = [[list(v.items()) if isinstance(v, dict) else v for v in column] for column in zip(*rows, strict=True)] if self.names else []
        if not self.names:
            return pa.RecordBatch.from_struct_array(pa.array([{}] * len(rows), pa.struct([])))
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, self.arrow, strict=True)], schema=self.arrow)

    def records(self, f) -> Iterator[tuple]:
        payload = "payload" in self.names
        while (head := _head(f)) is not None:
            length = int(head["content-length"])
            if not self._wanted(head):
                f.seek(length, 1)
                continue
            body = None
            if payload:
                body = f.read(length)
                if len(body) < length:
                    raise EOFError(f"a record of {length} bytes ends after {len(body)}")
                if head.get("content-type", "").startswith("application/http"):
                    body = body.partition(b"\r\n\r\n")[2]
            else:
                f.seek(length, 1)
            special = {"content_length": length, "headers": head, "payload": body}
            yield tuple(special[n] if n in special else head.get(HEADER[n]) for n in self.names)


class WarcSource(DataSource):
    """spark.read.format("warc"): option path (a folder or file that pyarrow's file systems reach) or files (JSON list of path and size), and taskBytes. A schema without payload skips all blocks."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    system, root = _system(path)
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    info = system.get_file_info(root)
    files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    return [(prefix + x.path, x.size) for x in files if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]


def _opened(path: str):
    import gzip
    import io

    system, at = _system(path)
    raw = system.open_input_file(at)
    # A gzip archive can't be sought in; GzipFile reads over what is skipped, without keeping it.
    return gzip.GzipFile(fileobj=raw) if at.endswith(".gz") else io.BufferedReader(raw, 1 << 18)


def _head(f) -> dict[str, str] | None:
    """Headers by lower-case name, the file standing at the block; None at the end. Lines may have any length; continued ones are joined."""
    line = f.readline(-1)
    while line in (b"\r\n", b"\n"):
        line = f.readline(-1)
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {line[:40]!r}")
    head: dict[str, str] = {}
    name = ""
    while (line := f.readline(-1).rstrip(b"\r\n")) or not name:
        if not line:
            raise ValueError("a record without headers")
        if line[:1] in b" \t" and name:
            head[name] += " " + line.strip().decode("utf-8", "replace")
        else:
            key, _, value = line.decode("utf-8", "replace").partition(":")
            name = key.strip().lower()
            head[name] = value.strip()
    return head


def base32_sha1(c: Column) -> Column:
    """Upper-case base 32 of SHA-1: 40 hex digits, five at a time, to four digits of base 32 each."""
    hexes = F.sha1(c)
    part = [F.lpad(F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2026-01-01T00:00:00Z") -> None:
    """A record per row of pages (page_id, url, html) as archives in the folder `path`.

    Of records with equal payloads of at least min_bytes, that with the smallest page_id is a response and the others
    revisit it; smaller payloads are all responses. Null html: an empty payload. Null url: no target. Control characters in a url
    are left out. Rows that repeat the smallest id are one response and revisits of it; null ids count as largest.
    Empty table: no records. Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("text"))
    rows = rows.select("page_id", "url", "text", F.octet_length("text").cast("long").alias("n"), base32_sha1(F.col("text").cast("binary")).alias("digest"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    same = rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min(order)["page_id"].alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first_id", "copies")
    same = written(same, "warc-copies")
    marked = join_counted(rows, same, ["digest"], "copies")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    again = F.coalesce((F.col("n") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    marked = marked.withColumn("again", again)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END + END))
    body = F.when(F.col("again"), F.lit("")).otherwise(F.col("text"))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(_urn(F.col("page_id")), F.lit("<urn:page:>"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x1F\x7F]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-X-Payload-Length", F.col("n").cast("string")),
        F.when(F.col("again"), F.concat(line("WARC-Refers-To", _urn(F.col("first_id"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(F.col("again"), F.lit(0)).otherwise(F.col("n"))).cast("string")),
        F.lit(END),
    )
    marked.select(F.concat(head, http, body).alias("value")).write.option("lineSep", END + END).text(path)


def archive_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the archives in a folder, by Spark's own file system: their number is bounded by the tasks that wrote them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(s.getPath().toString(), s.getLen()) for s in system.listStatus(root) if not s.getPath().getName().startswith(("_", "."))]


def read_archives(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The records of the archives in a folder. Predicates on record_type and the other header columns are pushed down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc").option("files", json.dumps(archive_files(spark, path)))
    return (reader.schema(schema) if schema else reader).load()


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).cast("long")
    whole = F.col("record_type") == "response"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload")).otherwise(F.col("headers")["warc-x-payload-length"]).cast("long").alias("payload_bytes"),
        F.when(whole, base32_sha1(F.col("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT p.page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(p.h, 5 * (i // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN p.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN firsts ON p.h = firsts.h
"""
