"""Putting together what a prompt is given: strong hits in full, weak ones by name, or what is recent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.windows import is_quality_hit

STRONG, WEAK, RECENT, CAP, CAP_ALONE = 4, 3, 5, 1200, 720


def prompt_pack(hits: DataFrame, recent: DataFrame, floor_ratio: float = 0.6) -> DataFrame:
    """(part, pos, path, line, text): at most 4 strong hits with their text, at most 3 weak paths, and 5 recent symbols where nothing is strong.

    hits (path, line, first, score, snippet) are a ranked result, recent (path, line, name, mtime_ms) likewise. A hit is
    strong with a window, 24 characters and at least 0.6 of the best score. Texts are cut at 1,200
    characters, at 720 where one hit stands alone. Ties go by path and line.
    """
    best = Window.partitionBy(F.lit(1))  # a ranked result of some twenty rows
    judged = hits.withColumn("strong", is_quality_hit(F.col("snippet"), F.col("first"), F.col("score"), 0.0) & (F.col("score") >= F.max("score").over(best) * floor_ratio))
    order = Window.partitionBy("strong").orderBy(F.desc("score"), "path", "line")
    numbered = judged.withColumn("pos", F.row_number().over(order)).withColumn("n_strong", F.count(F.when(F.col("strong"), 1)).over(best))
    cap = F.when(F.col("n_strong") == 1, CAP_ALONE).otherwise(CAP)
    strong = numbered.where(F.col("strong") & (F.col("pos") <= STRONG)).select(F.lit("strong").alias("part"), "pos", "path", "line", F.substring(F.col("snippet"), F.lit(1), cap).alias("text"))
    weak = numbered.where(~F.col("strong") & (F.col("pos") <= WEAK)).select(F.lit("weak").alias("part"), "pos", "path", "line", F.lit("").alias("text"))
    newest = recent.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("mtime_ms"), "path", "line"))).where(F.col("pos") <= RECENT)
    none = hits.agg(F.count("*").alias("n")).join(numbered.where("strong").agg(F.count("*").alias("m")), F.lit(True)).where("m = 0")  # one row or none
    filler = newest.join(F.broadcast(none), F.lit(True), "left_semi").select(F.lit("recent").alias("part"), "pos", "path", "line", F.col("name").alias("text"))
    return strong.unionByName(weak).unionByName(filler)
