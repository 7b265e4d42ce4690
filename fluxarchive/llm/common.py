"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (one
    machine), an error on a cluster, whose executors do not see each other's folders."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + os.path.join(tempfile.gettempdir(), "fluxarchive-checkpoints")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends in files that all executors see."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one computation, in a folder of their own under the shared one; clear() deletes them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """For when nothing that is still to run reads them."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def merge_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the corpus: sorted and merged, never broadcast, split where a key is hot."""
    return left.join(right.hint("merge"), on, how)


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """merge_join() with a table that was aggregated by the key, and so dealt by it already. A second key has both sides dealt
    for the join, which lets Spark split a hot key's rows over tasks."""
    again = F.xxhash64(key).alias("__again")
    return merge_join(left.select("*", again), right.select("*", again), [key, "__again"], how).drop("__again")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not use."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan's rows over all task slots if it has fewer partitions, so that a Python stage uses every core. What comes
    from a shuffle is left as it is: asking for its partitions would run it."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if re.search("Join|Aggregate|Window|Exchange|Repartition", plan):
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)
