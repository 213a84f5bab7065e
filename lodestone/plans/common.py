"""Tables and SQL fragments that the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.journal import events_once
from lodestone.sources.tables import current_corpus, current_files, table

#: The clock of every query that needs one.
AS_OF = "2026-06-01 00:00:00"
WORKSPACE = "lumen/harbor"
TERMS = ["index", "cache", "token", "budget", "ledger"]


def symbols_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").dropDuplicates(["id"])


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").dropDuplicates(["symbol_id"])


def named_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks (id, workspace, path, name, line, text) with header and text as one."""
    symbols = symbols_of(spark, sf_dir).select(F.col("id").alias("symbol_id"), "name", "line")
    text = F.concat_ws("\n", "header", "text")
    return chunks_of(spark, sf_dir).join(symbols, "symbol_id").select(F.col("symbol_id").alias("id"), "workspace", "path", "name", "line", text.alias("text"))


def named_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols_of(spark, sf_dir).select("id", "workspace", "path", "name", "line", F.concat_ws(" ", "name", "tokens", "signature", "path").alias("text"))


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_once(table(spark, sf_dir, "journal"))


def notes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "memories")


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_files(spark, sf_dir)


def corpus_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_corpus(spark, sf_dir)


def _latest(name: str, alias: str) -> str:
    return f"{alias} AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY workspace, path ORDER BY coalesce(mtime_ms, -4611686018427387904) DESC) AS r FROM {name}) WHERE r = 1)"


SQL_FILES = _latest("files", "f")
SQL_CORPUS = _latest("corpus", "c")
SQL_SYMBOLS = "s AS (SELECT DISTINCT ON (id) * FROM symbols)"
SQL_CHUNKS = "h AS (SELECT DISTINCT ON (symbol_id) * FROM chunks)"
SQL_EVENTS = "j AS (SELECT DISTINCT ON (event_id) * FROM journal)"
SQL_LINES = r"l AS (SELECT workspace, path, unnest(generate_series(1, len(a))) AS line, rtrim(unnest(a), chr(13)) AS text FROM (SELECT workspace, path, string_split(content, chr(10)) AS a FROM c))"


def bm25_sql(source: str, id_col: str, text: str, phrases: list, name: str = "bm") -> str:
    """CTEs that end in ``name`` (id, score)."""
    wanted = [(p, False) if isinstance(p, str) else p for p in phrases]
    test = [f"starts_with(x, '{p}')" if prefix else f"x = '{p}'" for p, prefix in wanted]
    tf = ", ".join(f"len(list_filter(t, lambda x: {c})) AS tf{i}" for i, c in enumerate(test))
    n = ", ".join(f"sum((tf{i} > 0)::INT) AS n{i}" for i in range(len(test)))
    part = " + ".join(
        f"CASE WHEN tf{i} > 0 THEN greatest(CASE WHEN (n - n{i} + 0.5) / (n{i} + 0.5) > 1 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 0 END, 1e-6) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(test))
    )
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(test)))
    return (
        f"{name}_t AS (SELECT {id_col} AS id, list_filter(string_split_regex(lower(coalesce({text}, '')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM {source}), "
        f"{name}_m AS (SELECT id, len(t) AS dl, {tf} FROM {name}_t), {name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {n} FROM {name}_m), "
        f"{name} AS (SELECT id, {part} AS score FROM {name}_m, {name}_s WHERE {hit})"
    )


def hash_sql(source: str, p: str = "") -> str:
    """CTEs that end in {p}em (doc_id, idx, weight): the feature-hash embeddings of source (doc_id, text), by their definition."""
    hexint = "('0x' || substr(d, {0}, {1}))::BIGINT"
    return f"""{p}tok AS (SELECT doc_id, unnest(list_concat(list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> ''),
  list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')))) AS token FROM {source}),
{p}dg AS (SELECT doc_id, sha256(token) AS d FROM {p}tok),
{p}em AS (SELECT doc_id, idx, sum(w) AS weight FROM (
  SELECT doc_id, ({hexint.format(1, 8)} % 256)::INT AS idx, CASE WHEN {hexint.format(9, 2)} % 2 = 0 THEN 1.0 ELSE -1.0 END AS w FROM {p}dg
  UNION ALL SELECT doc_id, ({hexint.format(17, 8)} % 256)::INT, CASE WHEN {hexint.format(25, 2)} % 2 = 0 THEN 0.5 ELSE -0.5 END FROM {p}dg) GROUP BY doc_id, idx)"""


def hash_vector_sql(text: str, name: str) -> str:
    """CTEs that end in ``name`` (v): the unit feature-hash embedding of one text as a list of 256 numbers."""
    made = hash_sql(f"(SELECT 0 AS doc_id, '{text}' AS text)", f"{name}_")
    return f"""{made}, {name} AS (SELECT list(coalesce(weight, 0)::DOUBLE / (SELECT sqrt(sum(weight::DOUBLE * weight)) FROM {name}_em) ORDER BY i) AS v FROM range(256) r(i) LEFT JOIN {name}_em ON idx = i)"""
