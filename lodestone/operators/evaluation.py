"""Graded retrieval evaluation and the benchmark report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import token_estimate

FILE_CAP_TOKENS, WALK_CHARS = 8000, 40


def ir_metrics(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, recall5, recall10, rr, ndcg10) of every judged query.

    hits (query_id, item, rank), qrels (query_id, item, grade). An item is credited once, at its first
    rank; recall is capped by the number of places; a query without hits scores 0.
    """
    judged = qrels.where("grade > 0").groupBy("query_id", "item").agg(F.max("grade").alias("grade"))
    first = hits.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    credit = judged.join(first, ["query_id", "item"], "left")
    ideal = Window.partitionBy("query_id").orderBy(F.desc("grade"), "item")
    gain = F.pow(F.lit(2.0), F.col("grade").cast("double")) - 1
    ranked = credit.withColumn("best", F.row_number().over(ideal))
    got = lambda k: F.count(F.when(F.col("rank") <= k, 1)) / F.least(F.count("*"), F.lit(k))
    dcg = F.sum(F.when(F.col("rank") <= 10, gain / F.log2(F.col("rank") + 1)).otherwise(0.0))
    best = F.sum(F.when(F.col("best") <= 10, gain / F.log2(F.col("best") + 1)).otherwise(0.0))
    return ranked.groupBy("query_id").agg(F.round(got(5), 6).alias("recall5"), F.round(got(10), 6).alias("recall10"), F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("rr"), F.round(dcg / best, 6).alias("ndcg10"))


def graded_hits(hits: DataFrame, golden: DataFrame) -> DataFrame:
    """(query_id, item, rank): the golden item that each hit counts for, as ``ir_metrics`` takes it.

    hits (query_id, rank, path, symbol), golden (query_id, item), an item being ``path#symbol`` or ``path``: a hit
    counts for its symbol where that is asked for, else for its path; hits that nobody asked for are left out.
    """
    asked = golden.select("query_id", "item").distinct()
    keyed = hits.select("query_id", "rank", F.col("path"), F.concat("path", F.lit("#"), "symbol").alias("exact"))
    by_symbol = keyed.join(asked.select("query_id", F.col("item").alias("exact"), F.lit(True).alias("named")), ["query_id", "exact"], "left")
    by_path = by_symbol.join(asked.select("query_id", F.col("item").alias("path"), F.lit(True).alias("placed")), ["query_id", "path"], "left")
    return by_path.select("query_id", F.when(F.col("named"), F.col("exact")).when(F.col("placed"), F.col("path")).alias("item"), "rank").where("item is not null")


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """(queries, recall5, recall10, mrr, ndcg10): means over the queries."""
    return metrics.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 4).alias(n) for c, n in (("recall5", "recall5"), ("recall10", "recall10"), ("rr", "mrr"), ("ndcg10", "ndcg10"))])


def gate(means: DataFrame, recall5: float = 0.5, mrr: float = 0.6, ndcg10: float = 0.45) -> DataFrame:
    """(metric, value, floor, passed): the means against their floors."""
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.lit(float(f)).alias("floor")) for n, f in (("recall5", recall5), ("mrr", mrr), ("ndcg10", ndcg10))])
    return means.select(F.inline(rows)).withColumn("passed", F.col("value") >= F.col("floor"))


def bench_report(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """(task_id, injected, baseline, net): tokens given against a listing of all files plus three whole files of at most 8,000 tokens each.

    tasks (task_id, workspace, injected, paths): the first three known paths are read.
    """
    known = files.select("workspace", "path", F.least(token_estimate(F.coalesce("size", F.lit(0))), F.lit(FILE_CAP_TOKENS)).alias("tokens"))
    listing = known.groupBy("workspace").agg(F.ceil(F.count("*") * WALK_CHARS / 4).alias("walk"))
    read = tasks.select("task_id", "workspace", F.posexplode("paths").alias("pos", "path")).join(known, ["workspace", "path"])
    order = Window.partitionBy("task_id").orderBy("pos")
    three = read.withColumn("r", F.row_number().over(order)).where("r <= 3").groupBy("task_id").agg(F.sum("tokens").alias("reads"))
    joined = tasks.join(listing, "workspace", "left").join(three, "task_id", "left")
    baseline = F.coalesce("walk", F.lit(0)) + F.coalesce("reads", F.lit(0))
    return joined.select("task_id", F.coalesce("injected", F.lit(0)).alias("injected"), baseline.alias("baseline"), (baseline - F.coalesce("injected", F.lit(0))).alias("net"))
