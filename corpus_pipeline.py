"""The corpus pipeline: five stages, each on what its predecessor kept, the last packing the documents for training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospector.llm.common import drop_tables, noted_tables, table, written
from prospector.llm.decontaminate import cut_spans
from prospector.llm.line_dedup import drop_lines
from prospector.llm.ngram_join import keep_one
from prospector.llm.packing import pack, pieces, vocabulary
from prospector.llm.quality import quality_select


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, as the texts now are."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier selects, with the columns they had. Null and empty texts are not selected; without labels of both kinds all with words are. Repeated rows fare alike."""
    own = [c if c in ("doc_id", "text") else f"_column{i}" for i, c in enumerate(docs.columns)]  # names that the operator gives its results are theirs
    out = quality_select(docs.toDF(*own), table(spark, sf_dir, "labels"))
    return out.select(*own).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur in documents of larger ids. Null texts stay null; repeated rows are cut alike; ties have no say, as the largest id holding a line keeps it."""
    return _recounted(drop_lines(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the smallest id. Rows without words, and null ids, stay; of rows that repeat id and text one stays."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of the benchmark. Null and empty texts, and all where the benchmark is empty, stay; repeated rows are cut alike."""
    return _recounted(cut_spans(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents. A null or empty text is its end token alone; a text longer than a sequence is cut; each repeated row is packed. Empty table: no rows."""
    return pack(pieces(docs, vocabulary()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", packing),
]

#: The quality classifier is fitted here and the packing ranks by hashes: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables that a stage made on its way are removed once it is written, and its input with them."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with noted_tables() as made:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_tables(spark, [*before, *made[:-1]])
        before = made[-1:]
    return docs
