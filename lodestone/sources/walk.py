"""Reading source files from folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import SYMBOL_EXTENSIONS, TEXT_EXTENSIONS, extension, ignore_rules, is_ignored


def walk_corpus(spark: SparkSession, root: str, workspace: str, extra_rules: tuple[str, ...] = (), most_bytes: int = 1_500_000) -> DataFrame:
    """(workspace, path, content, mtime_ms, size) of the indexable files below a folder.

    Other extensions are never listed, and the content of files above 1.5 MB is never read. Files in ignored
    folders and of ignored patterns are left out, though read. Bytes that are not UTF-8 become
    replacement characters.
    """
    listed = ",".join(e for x in (*SYMBOL_EXTENSIONS, *TEXT_EXTENSIONS) for e in (x, x.upper()))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{listed}}}").load(root)
    base = F.lit(root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/")
    path = F.expr("substring(path, instr(path, base) + length(base))")
    listed = found.withColumn("base", base).withColumn("rel", path)
    kept = listed.where(extension(F.col("rel")).isin(*SYMBOL_EXTENSIONS, *TEXT_EXTENSIONS) & ~is_ignored(F.col("rel"), ignore_rules(extra_rules)) & (F.col("length") <= most_bytes))
    return kept.select(F.lit(workspace).alias("workspace"), F.col("rel").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"))
