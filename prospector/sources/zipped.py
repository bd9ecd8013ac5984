"""Members of zip archives as a table: a partition a member, inflated and parsed as a stream of Arrow batches."""

from __future__ import annotations

import fnmatch
import json
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import present

#: Inflated bytes that are parsed at once.
BLOCK_BYTES = 1 << 20


def _opened(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


class Member(InputPartition):
    def __init__(self, path: str, name: str):
        super().__init__((path, name))
        self.path, self.name = path, name


class ZipReader(DataSourceReader):
    def __init__(self, schema, options):
        self.wanted = [f.name for f in schema.fields]
        self.columns = json.loads(options["columns"])
        self.files = json.loads(options["files"])
        self.members = options.get("members", "*")
        self.encoding, self.delimiter = options.get("encoding", "latin1"), options.get("sep", ";")

    def partitions(self) -> list[Member]:
        """The central directory of each archive alone is read here."""
        out = []
        for path in self.files:
            try:
                with _opened(path) as f, zipfile.ZipFile(f) as z:
                    names = [i.filename for i in z.infolist() if not i.is_dir() and fnmatch.fnmatch(i.filename, self.members)]
            except (zipfile.BadZipFile, pa.ArrowInvalid) as error:
                raise ValueError(f"{path}: {error}") from error
            out += [Member(path, n) for n in names]
        return out

    def read(self, member: Member) -> Iterator[pa.RecordBatch]:
        from pyarrow import csv

        wanted = [c for c in self.wanted if c != "_member"]
        schema = pa.schema([(c, pa.string()) for c in self.wanted])
        read = csv.ReadOptions(column_names=self.columns, encoding=self.encoding, block_size=BLOCK_BYTES, use_threads=False)
        parse = csv.ParseOptions(delimiter=self.delimiter, quote_char='"', double_quote=True, newlines_in_values=True, invalid_row_handler=lambda _: "skip")
        convert = csv.ConvertOptions(include_columns=wanted or self.columns[:1], column_types={c: pa.string() for c in self.columns}, strings_can_be_null=False)
        try:
            with _opened(member.path) as f, zipfile.ZipFile(f) as z, z.open(member.name) as stream:
                if not stream.peek(1):
                    return
                for batch in csv.open_csv(stream, read, parse, convert):
                    named = pa.array([member.name] * batch.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([named if c == "_member" else batch.column(c) for c in self.wanted], schema=schema)
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, pa.ArrowInvalid) as error:
            raise ValueError(f"member {member.name} of {member.path}: {error}") from error


class ZipSource(DataSource):
    """spark.read.format("zip_csv"): options files (JSON list of archives), columns (JSON list, all columns of a row in order), members (a pattern of names), sep, encoding. The schema names the columns that are parsed into values."""

    @classmethod
    def name(cls) -> str:
        return "zip_csv"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema) -> ZipReader:
        return ZipReader(schema, self.options)


def archives(spark: SparkSession, path: str) -> list[str]:
    """The zip files that a path or pattern names, by Spark's own file system."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
    return sorted(s.getPath().toString() for s in found)


def read_zipped(spark: SparkSession, path: str, columns: list[str], wanted: list[str] | None = None, members: str = "*") -> DataFrame:
    """Rows of headerless `;`-separated, quoted, latin-1 members, as read_raw gives them for plain files: short or long rows are left out, blanks are null.

    path names archives, by a pattern too; members is a pattern of member names. wanted are the columns to keep, in their
    order, with _member the member's name; others aren't made into values. A member is one task, as it can't be split; one that is broken fails
    the query with its name. Empty members give no rows; no archive at all gives an empty table.
    """
    spark.dataSource.register(ZipSource)
    wanted = wanted or columns
    unknown = [c for c in wanted if c not in (*columns, "_member")]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    schema = ", ".join(f"`{c}` string" for c in wanted)
    files = archives(spark, path)
    if not files:
        return spark.createDataFrame([], schema)
    raw = spark.read.format("zip_csv").options(files=json.dumps(files), columns=json.dumps(columns), members=members).schema(schema).load()
    return raw.select(*[F.col(c) if c == "_member" else present(F.col(c)).alias(c) for c in wanted])
