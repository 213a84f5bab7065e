"""Counts and rollups of an index, and its health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import canonical_language


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, n): rows of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def top_counts(df: DataFrame, key: Column, name: str, k: int | None = None) -> DataFrame:
    """(name, n): rows of each key, most first; ties by key."""
    counted = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    return counted if k is None else counted.orderBy(F.desc("n"), name).limit(k)


def folder_of(path: Column) -> Column:
    """(root) for a bare name; two parts below src, packages, apps, services and libs; else the first part."""
    parts = F.split(path, "/")
    first = F.element_at(parts, 1)
    two = first.isin("src", "packages", "apps", "services", "libs") & (F.size(parts) > 2)
    return F.when(F.size(parts) <= 1, "(root)").when(two, F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(first)


def folder_rollup(files: DataFrame, k: int = 20) -> DataFrame:
    return top_counts(files, folder_of(F.col("path")), "folder", k)


def language_counts(files: DataFrame) -> DataFrame:
    return top_counts(files, canonical_language(F.col("language")), "language")


def heaviest_files(symbols: DataFrame, files: DataFrame, k: int = 15) -> DataFrame:
    """(workspace, path, language, n): files with most symbols; unknown where the file is not listed."""
    counted = symbols.groupBy("workspace", "path").agg(F.countDistinct("id").alias("n"))
    best = counted.orderBy(F.desc("n"), "workspace", "path").limit(k)
    joined = best.join(files.select("workspace", "path", "language"), ["workspace", "path"], "left")
    return joined.select("workspace", "path", canonical_language(F.col("language")).alias("language"), "n")


def directory_listing(files: DataFrame, dirs: int = 12, names: int = 8) -> DataFrame:
    """(workspace, dir, n_files, names) of the first directories of each workspace with their first file names."""
    split = files.select("workspace", F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".").alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name")).distinct()
    counts = split.groupBy("workspace", "dir").agg(F.count("*").alias("n_files"))
    kept = counts.withColumn("r", F.row_number().over(Window.partitionBy("workspace").orderBy("dir"))).where(F.col("r") <= dirs).drop("r")
    listed = split.join(kept.select("workspace", "dir"), ["workspace", "dir"], "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("workspace", "dir").orderBy("name"))).where(F.col("r") <= names)
    shown = listed.groupBy("workspace", "dir").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    return kept.join(shown, ["workspace", "dir"])


def top_shares(counts: DataFrame, name: str, k: int) -> DataFrame:
    """(name, n, share): the k largest counts and each one's share of what is shown."""
    shown = counts.orderBy(F.desc("n"), name).limit(k)
    return shown.select(name, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"))  # k rows


def usage_health(events: DataFrame, least_asked: int = 10, floor: float = 0.25) -> DataFrame:
    """(check, value, status): hit rate of injects with a prompt, once there are ten, and share of injects that timed out."""
    inject = F.col("event_type") == "inject"
    asked = inject & ~F.coalesce("no_prompt", F.lit(False))
    late = inject & (F.coalesce("timed_out_delta", F.lit(False)) | F.coalesce("timed_out_retrieve", F.lit(False)))
    n = events.agg(F.count_if(asked).alias("asked"), F.count_if(asked & (F.col("hits") > 0)).alias("hit"), F.count_if(inject).alias("injects"), F.count_if(late).alias("late"))
    rate, share = F.round(F.col("hit") / F.nullif("asked", F.lit(0)), 6), F.round(F.col("late") / F.nullif("injects", F.lit(0)), 6)
    rows = F.array(
        F.struct(F.lit("hit rate").alias("check"), rate.alias("value"), F.when((F.col("asked") >= least_asked) & (rate < floor), "warn").otherwise("ok").alias("status")),
        F.struct(F.lit("timeouts").alias("check"), share.alias("value"), F.when(share > 0.5, "warn").otherwise("ok").alias("status")),
    )
    return n.select(F.inline(rows))


def index_health(files: DataFrame, symbols: DataFrame, chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """(check, value, status): has files, symbols and chunks; share of symbols with a chunk and of notes with an embedding."""
    n = table_counts(files=files, symbols=symbols.select("id").distinct(), chunks=chunks.select("symbol_id").distinct())
    present = n.select(F.col("name").alias("check"), F.col("n").cast("double").alias("value"), F.when(F.col("n") > 0, "ok").otherwise("bad").alias("status"))
    held = chunks.where("text is not null").select(F.col("symbol_id").alias("id"), F.lit(1).alias("held")).distinct()
    covered = symbols.select("id").distinct().join(held, "id", "left").agg(F.count("held").alias("c"), F.count("*").alias("t"))
    share = covered.select(F.lit("chunk coverage").alias("check"), F.round(F.col("c") / F.greatest("t", F.lit(1)), 6).alias("value"))
    vectors = embedded.agg(F.round(F.count_if(F.col("embedding").isNotNull()) / F.greatest(F.count("*"), F.lit(1)), 6).alias("value")).select(F.lit("embedding coverage").alias("check"), "value")
    both = share.unionByName(vectors)
    return present.unionByName(both.withColumn("status", F.when(F.col("value") >= 0.8, "ok").when(F.col("value") >= 0.5, "warn").otherwise("bad")))
