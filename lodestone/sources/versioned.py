"""Tables that are replaced as a whole: a new version is written beside the old, then a pointer is switched."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def write_version(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Write a new version and switch to it; readers see the old one or the new one, never a part. Returns the version."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{version}")
    fs, jvm = _fs(spark, root)
    fresh, pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}.{version}"), jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    out = fs.create(fresh, True)
    out.write(version.encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, pointer, overwrite)
    return version


def current_version(spark: SparkSession, root: str) -> str | None:
    fs, jvm = _fs(spark, root)
    pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return bytes(stream.readNBytes(64)).decode()
    finally:
        stream.close()


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The current version of a table."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no version in {root}")
    return spark.read.parquet(f"{root}/{version}")
