"""What the plans must look like to hold at scale."""

import re

from pyspark.sql import functions as F

from lodestone.operators import search, windows
from lodestone.operators.journal import events_once, token_ledger
from lodestone.plans.common import TERMS
from lodestone.sources.tables import current_files, table


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_bm25_scores_without_a_shuffle_and_reads_two_columns(spark, data):
    text = plan(search.term_counts(table(spark, data, "documents"), ["doc_id"], "text", TERMS))
    assert "Exchange" not in plan(search.bm25(table(spark, data, "documents"), "doc_id", "text", TERMS))
    assert "Exchange" not in text and re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


def test_path_filters_reach_the_scan_below_the_version_rule(spark, data):
    text = plan(current_files(spark, data).where(F.col("path").startswith("services/")))
    assert "StringStartsWith(path,services/)" in text


def test_topk_is_one_operator(spark, data):
    text = plan(search.bm25(table(spark, data, "documents"), "doc_id", "text", TERMS).orderBy(F.desc("score")).limit(5))
    assert "TakeOrderedAndProject" in text


def test_ledger_reads_only_its_columns(spark, data):
    schema = re.search(r"ReadSchema: struct<(.*)>", plan(token_ledger(events_once(table(spark, data, "journal"))))).group(1)
    assert "paths" not in schema and "delta_ms" not in schema and "event_id" in schema


def test_range_joins_have_an_equi_key(spark, data):
    hits = table(spark, data, "symbols").select(F.col("id").alias("hit_id"), "workspace", "path", "line")
    text = plan(windows.cover_spans(hits, table(spark, data, "chunks")))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_no_registered_query_has_a_cross_join(spark, data):
    from lodestone.plans import code, usage

    for module in (code, usage):
        for name in ("impact", "resolve_targets", "stale_notes", "dirty_diff", "index_health", "workspace_rollup"):
            if name in module.queries():
                text = plan(module.queries()[name](spark, data))
                assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
