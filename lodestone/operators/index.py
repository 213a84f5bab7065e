"""Keeping an index in step with its files: what is dirty, what is gone, and replacing by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dirty_files(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(workspace, path, status): added, removed or changed between two listings (workspace, path, hash, mtime_ms, size).

    A file of equal mtime and size is taken as unchanged without comparing hashes; others are compared by hash.
    """
    a = indexed.select("workspace", "path", F.col("hash").alias("h0"), F.col("mtime_ms").alias("m0"), F.col("size").alias("s0"), F.lit(True).alias("in0"))
    b = current.select("workspace", "path", F.col("hash").alias("h1"), F.col("mtime_ms").alias("m1"), F.col("size").alias("s1"), F.lit(True).alias("in1"))
    joined = a.join(b, ["workspace", "path"], "full")
    same = (F.col("m0").eqNullSafe(F.col("m1")) & F.col("s0").eqNullSafe(F.col("s1"))) | F.col("h0").eqNullSafe(F.col("h1"))
    status = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when(~same, "changed")
    return joined.withColumn("status", status).where("status is not null").select("workspace", "path", "status")


def missing_files(indexed: DataFrame, walked: DataFrame) -> DataFrame:
    """(workspace, path) that are indexed but not found by the walk."""
    return indexed.select("workspace", "path").distinct().join(walked.select("workspace", "path").distinct(), ["workspace", "path"], "left_anti")


def without_paths(table: DataFrame, removed: DataFrame, path_col: str = "path") -> DataFrame:
    """The rows of an index table that do not belong to a removed file."""
    return table.join(removed.select("workspace", F.col("path").alias(path_col)).distinct(), ["workspace", path_col], "left_anti")


def replace_paths(table: DataFrame, fresh: DataFrame, path_col: str = "path") -> DataFrame:
    """The table with the rows of all files in ``fresh`` replaced by those of ``fresh``."""
    return without_paths(table, fresh.select("workspace", F.col(path_col).alias("path")), path_col).unionByName(fresh)


def orphans(symbols: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(check, n): chunks without their symbol, and symbols and chunks without their file."""
    keys = files.select("workspace", "path").distinct()
    ids = symbols.select(F.col("id").alias("symbol_id")).distinct()
    parts = {
        "chunks without symbol": chunks.select("symbol_id").distinct().join(ids, "symbol_id", "left_anti"),
        "symbols without file": symbols.select("id", "workspace", "path").distinct().join(keys, ["workspace", "path"], "left_anti"),
        "chunks without file": chunks.select("symbol_id", "workspace", "path").distinct().join(keys, ["workspace", "path"], "left_anti"),
    }
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def parse_status(lines: DataFrame, column: str = "line") -> DataFrame:
    """(status, path, deleted) of porcelain status lines: a rename counts for its new path, quotes are taken off."""
    code = F.trim(F.substring(column, 1, 2))
    rest = F.substring(F.col(column), 4, 1_000_000)
    path = F.when(F.contains(rest, F.lit(" -> ")), F.split_part(rest, F.lit(" -> "), F.lit(2))).otherwise(rest)
    return lines.where(F.length(column) > 3).select(code.alias("status"), F.regexp_replace(path, '^"|"$', "").alias("path"), F.contains(code, F.lit("D")).alias("deleted"))


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(workspace, path, change) between two versions (workspace, path, hash): A, D, M, or R for a file that only moved.

    A removed and an added file of one workspace with the same hash count as a move when each hash
    was removed and added once.
    """
    a = old.select("workspace", "path", F.col("hash").alias("h0"))
    b = new.select("workspace", "path", F.col("hash").alias("h1"))
    joined = a.join(b, ["workspace", "path"], "full").where(~F.col("h0").eqNullSafe(F.col("h1")))
    plain = joined.select("workspace", "path", F.coalesce("h1", "h0").alias("hash"), F.when(F.col("h0").isNull(), "A").when(F.col("h1").isNull(), "D").otherwise("M").alias("change"))
    moves = plain.where("change in ('A', 'D')").groupBy("workspace", "hash").agg(F.count_if(F.col("change") == "A").alias("na"), F.count_if(F.col("change") == "D").alias("nd")).where("na = 1 and nd = 1").select("workspace", "hash", F.lit(True).alias("moved"))
    marked = plain.join(moves, ["workspace", "hash"], "left")
    return marked.where(~(F.coalesce("moved", F.lit(False)) & (F.col("change") == "D"))).select("workspace", "path", F.when(F.col("moved") & (F.col("change") == "A"), "R").otherwise(F.col("change")).alias("change"))
