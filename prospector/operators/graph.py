"""Connected components of links by rounds of joins; state lies in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; else, if all runs on this machine (tests), a folder of our own, one an application."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="prospector-")
    return _LOCAL[app]


def new_path(spark: SparkSession) -> str:
    """A place in the shared folder that nothing else uses; `drop_stored` removes it."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Removes every table that this application left in the shared folder; call it once results are written, as nothing of them can be read after."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): component is the smallest node reachable. Labels halve their distance to it in each round."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = labels.join(near, labels["node"] == near["a"]).join(jump, "component", "left")
        new = stored(new.select("node", F.least("component", "near", "far").alias("component"), F.col("component").alias("was")))
        labels = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return labels
