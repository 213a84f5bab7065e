"""Readers of the corpus, index and journal tables, with the rules for their late and doubled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def latest_versions(df: DataFrame) -> DataFrame:
    """Of each (workspace, path) the row with the greatest mtime_ms; a null one counts as the oldest.

    Equal mtimes are settled by a hash of the row, so the pick does not depend on the order
    of arrival. ``max_by`` aggregates before the shuffle: a file delivered a million times
    sends one row per task, never a group.
    """
    keys = ["workspace", "path"]
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.coalesce(F.col("mtime_ms"), F.lit(-(2**62))), F.xxhash64(*rest))
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("v"))
    return picked.select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])


def current_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_versions(table(spark, sf_dir, "files"))


def current_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_versions(table(spark, sf_dir, "corpus"))
