"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a local one in local mode (as in tests), else an error."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut_lineage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in a folder for each value of ``by``, and continue from the written copy.

    The copy outlives any executor, is compressed and read by column, and its size is known to
    the planner. Tables stay until the folder is cleared, like other checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def partition_folder(**values: object) -> str:
    """The folder that a partitioned table keeps these values in; special characters are written as Spark writes them."""
    unsafe = set("\"#%'*/:=?\\\x7f{}[]^") | set(map(chr, range(1, 32)))
    escaped = lambda v: "".join(f"%{ord(c):02X}" if c in unsafe else c for c in str(v)) if v not in (None, "") else "__HIVE_DEFAULT_PARTITION__"
    return "/".join(f"{k}={escaped(v)}" for k, v in values.items())
