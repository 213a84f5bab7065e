"""Registered queries of text, code and vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import format as fm
from lodestone.functions import text as T
from lodestone.functions.vectors import hash_embedding, hash_similarity
from lodestone.operators import evaluation, grep, lookup, search, windows
from lodestone.operators.pack import prompt_pack
from lodestone.operators.extract import import_edges
from lodestone.plans.common import (
    SQL_CHUNKS, SQL_CORPUS, SQL_FILES, SQL_LINES, SQL_SYMBOLS, TERMS, WORKSPACE, bm25_sql, chunks_of, corpus_of, files_of, hash_sql, hash_vector_sql, named_chunks, named_symbols, notes_of, symbols_of,
)
from lodestone.sources.storage import folder_exists, shared_folder
from lodestone.sources.tables import table

QUERY, NAME = "validate token cache", "loadPolicy"
PHRASES = search.phrases_of(QUERY)
DOC_QUERY = "which cache keeps the token budget of the index"
PATTERN = r"(^|[^A-Za-z0-9_])(flush|merge)[A-Z][A-Za-z]+\("


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return search.ranked(search.bm25(table(s, d, "documents"), "doc_id", "text", TERMS), "doc_id", 20)


def prefix_topk(s: SparkSession, d: str) -> DataFrame:
    return search.ranked(search.bm25(named_chunks(s, d), "id", "text", PHRASES), "id", 20)


def notes_topk(s: SparkSession, d: str) -> DataFrame:
    return search.ranked(search.bm25(notes_of(s, d).select("id", F.concat_ws(" ", "text", "tags", "paths").alias("text")), "id", "text", TERMS), "id", 20)


def lexical_union(s: SparkSession, d: str) -> DataFrame:
    files = corpus_of(s, d).select("workspace", "path", F.col("content").alias("text"))
    return search.lexical_union(named_symbols(s, d), named_chunks(s, d), files, PHRASES, 20)


def bm25_batch(s: SparkSession, d: str) -> DataFrame:
    docs = named_symbols(s, d).select("id", F.col("name").alias("text")).select("id", T.identifier_tokens(F.col("text")).alias("text"))
    asked = docs.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("text").alias("query"))
    return search.bm25_batch(asked, docs, 10)


def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    vectors = table(s, d, "embeddings")
    query = vectors.where("vec_id = 0").select("embedding").head()[0]
    return search.cosine_topk(vectors, query, "vec_id", "embedding", 8)


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    lists = [search.ranked(search.bm25(docs, "doc_id", "text", TERMS[:2]), "doc_id", 20), search.ranked(search.bm25(docs, "doc_id", "text", TERMS[2:]), "doc_id", 20)]
    return search.rrf(lists, "doc_id", 20)


def hybrid(s: SparkSession, d: str) -> DataFrame:
    return search.hybrid_search(table(s, d, "documents"), DOC_QUERY, "doc_id", "text", 20)


def hash_embeddings(s: SparkSession, d: str) -> DataFrame:
    return hash_embedding(table(s, d, "documents"), "doc_id", "text")


def hash_topk(s: SparkSession, d: str) -> DataFrame:
    return search.ranked(hash_similarity(table(s, d, "documents"), "doc_id", "text", DOC_QUERY), "doc_id", 20, 4)


def symbol_inputs(s: SparkSession, d: str) -> DataFrame:
    """What a symbol's embedding is made of: its name and kind, then its chunk."""
    symbols = symbols_of(s, d).select(F.col("id").alias("symbol_id"), "name", "kind")
    return symbols.join(chunks_of(s, d).select("symbol_id", "text"), "symbol_id").select("symbol_id", F.concat(F.concat_ws(" ", "name", "kind"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("input"))


def rerank(s: SparkSession, d: str) -> DataFrame:
    hits = search.ranked(search.bm25(table(s, d, "documents"), "doc_id", "text", TERMS), "doc_id", 20).join(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    return search.rerank_overlap(hits, DOC_QUERY, "text", "doc_id", 8).select("doc_id", "score", "overlap")


def lsh_candidates(s: SparkSession, d: str) -> DataFrame:
    vectors = table(s, d, "embeddings")
    return search.lsh_neighbours(vectors.where("vec_id % 50 = 0"), vectors, "vec_id", "embedding", 64)


def lsh_sizes(s: SparkSession, d: str) -> DataFrame:
    return search.lsh_buckets(table(s, d, "embeddings"), "vec_id", "embedding", 64).groupBy("table_id", "bucket").agg(F.count("*").alias("n"))


def _document_lines(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).alias("n"), "line").where(F.trim("line") != "")


def classify_queries(s: SparkSession, d: str) -> DataFrame:
    """Every line of every document as a query."""
    return _document_lines(s, d).select("doc_id", "n", T.classify_query(F.col("line")).alias("kind"))


def classify_intents(s: SparkSession, d: str) -> DataFrame:
    """Every line of every document as a prompt."""
    return _document_lines(s, d).groupBy("doc_id", T.classify_intent(F.col("line")).alias("intent")).agg(F.count("*").alias("n"))


def query_signals(s: SparkSession, d: str) -> DataFrame:
    return notes_of(s, d).where("text is not null").select("id", F.array_join(T.query_signals(F.col("text")), "|").alias("signals"))


def identifier_tokens(s: SparkSession, d: str) -> DataFrame:
    return symbols_of(s, d).select("id", T.identifier_tokens(F.col("name")).alias("tokens"))


def grep_pattern(s: SparkSession, d: str) -> DataFrame:
    return grep.grep_lines(corpus_of(s, d), PATTERN, None).select("workspace", "path", "line", "text")


def numbered_corpus(s: SparkSession, d: str) -> DataFrame:
    return corpus_of(s, d).withColumn("file", F.xxhash64("workspace", "path"))


def stored_postings(s: SparkSession, d: str) -> DataFrame:
    """The n-gram postings of the whole corpus, in folders by the first digit of the hash: written once for a session and folder,
    read by every further query. Each task writes its own files, so no posting is shuffled. Files stand in them by a number
    of 64 bits; two files of one number would only be searched together.
    """
    at = f"{shared_folder(s)}/ngrams-{s.sparkContext.applicationId}-{abs(hash(d)):x}"
    if not folder_exists(s, f"{at}/_SUCCESS"):
        grep.ngram_postings(numbered_corpus(s, d), ["file"], settled=True).withColumn("part", F.conv(F.substring("hash", 1, 1), 16, 10).cast("int")).write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(at)
    return s.read.schema("hash string, file bigint, part int").parquet(at)


def grep_literal(s: SparkSession, d: str) -> DataFrame:
    return grep.grep_fast(numbered_corpus(s, d), stored_postings(s, d), NAME, None, file_keys=["file"]).select("workspace", "path", "line", "snippet")


def ngram_postings(s: SparkSession, d: str) -> DataFrame:
    """Every n-gram of every current text, with the file it stands in."""
    return grep.ngram_lists(corpus_of(s, d))


def ngram_sizes(s: SparkSession, d: str) -> DataFrame:
    """The number of files of every n-gram."""
    return grep.ngram_counts(corpus_of(s, d))


def symbol_lookup(s: SparkSession, d: str) -> DataFrame:
    return lookup.symbol_lookup(symbols_of(s, d), "policy", 30)


def list_paths(s: SparkSession, d: str) -> DataFrame:
    return lookup.list_paths(files_of(s, d), "services/", 40)


def recent_symbols(s: SparkSession, d: str) -> DataFrame:
    return lookup.recent_symbols(symbols_of(s, d), files_of(s, d), 20)


def merged_hits(s: SparkSession, d: str) -> DataFrame:
    chunks = named_chunks(s, d)
    scored = chunks.drop("text").join(search.bm25(chunks, "id", "text", PHRASES), "id")
    hits = scored.select("workspace", "path", "line", F.col("name").alias("symbol"), F.round("score", 6).alias("score"))
    return lookup.merge_per_file(hits)


def merged_snippets(s: SparkSession, d: str) -> DataFrame:
    """The twenty best chunks as one hit for each file, with their snippets."""
    return lookup.merge_per_file(_best_chunks(s, d).select("workspace", "path", "line", "symbol", "score", "snippet"))


def packed_budget(s: SparkSession, d: str) -> DataFrame:
    scored = search.ranked(search.bm25(table(s, d, "documents"), "doc_id", "text", TERMS), "doc_id", 200).join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return lookup.pack_budget(scored, [F.desc("score"), F.col("doc_id")], F.col("n_chars")).select("doc_id", "cost", "cum_cost")


def fallback(s: SparkSession, d: str) -> DataFrame:
    return lookup.fallback_ladder(symbols_of(s, d), corpus_of(s, d), [NAME, "trackShard", "plain"], 8)


def context_pack(s: SparkSession, d: str) -> DataFrame:
    chunks = named_chunks(s, d).where(F.col("workspace") == WORKSPACE)
    hits = search.ranked(search.bm25(chunks, "id", "text", PHRASES), "id", 20).join(chunks, "id").select("workspace", "path", "line", F.col("name").alias("symbol"), "score")
    return lookup.context_pack(hits, import_edges(corpus_of(s, d).where(F.col("workspace") == WORKSPACE)))


def snippets(s: SparkSession, d: str) -> DataFrame:
    """The window of terms around the first match in every document that has one."""
    docs = table(s, d, "documents")
    found = docs.join(search.bm25(docs, "doc_id", "text", TERMS).select("doc_id"), "doc_id", "left_semi")
    return found.select("doc_id", fm.snippet(F.col("text"), [(t, False) for t in TERMS], 24).alias("snippet"))


def _best_chunks(s: SparkSession, d: str) -> DataFrame:
    chunks = named_chunks(s, d)
    ranked = search.ranked(search.bm25(chunks, "id", "text", PHRASES), "id", 20)
    return chunks.join(F.broadcast(ranked), "id").select(F.col("id").alias("hit_id"), "workspace", "path", "line", F.col("name").alias("symbol"), "score", "rank", F.substring("text", 1, 60).alias("snippet"))


def hits_markdown(s: SparkSession, d: str) -> DataFrame:
    """The best hits of every workspace that has any, as Markdown."""
    hits = _best_chunks(s, d).withColumn("first", F.col("line")).withColumn("last", F.lit(None).cast("int")).withColumn("snippet", F.split_part("snippet", F.lit("\n"), F.lit(1)))
    return fm.hits_as_text(hits, "workspace")


def packed_prompt(s: SparkSession, d: str) -> DataFrame:
    best = _best_chunks(s, d)
    shown = windows.enrich_hits(best.select("hit_id", "workspace", "path", "line", "snippet"), chunks_of(s, d), corpus_of(s, d))
    hits = shown.join(best.select("hit_id", "score"), "hit_id").select("path", "line", "first", "score", "snippet")
    return prompt_pack(hits, lookup.recent_symbols(symbols_of(s, d), files_of(s, d), 20))


def _hits(s: SparkSession, d: str) -> DataFrame:
    """Every symbol as a hit two lines below its start."""
    return symbols_of(s, d).select(F.col("id").alias("hit_id"), "workspace", "path", (F.col("line") + 2).alias("line"), F.coalesce("signature", F.lit("")).alias("snippet"))


def span_cover(s: SparkSession, d: str) -> DataFrame:
    return windows.cover_spans(_hits(s, d).drop("snippet"), chunks_of(s, d)).select("hit_id", "line", "start_line", "end_line")


def hit_windows(s: SparkSession, d: str) -> DataFrame:
    enriched = windows.enrich_hits(_hits(s, d), chunks_of(s, d), corpus_of(s, d))
    return enriched.select("hit_id", "first", "last", F.length("snippet").alias("n_chars"), F.md5(F.encode("snippet", "UTF-8")).alias("body"), windows.is_quality_hit(F.col("snippet"), F.col("first")).alias("quality"))


def _graded(s: SparkSession, d: str, *shown: Column) -> tuple[DataFrame, DataFrame]:
    """Asked symbols (query_id, path, shown) and their hits (query_id, rank, path, shown), both from one reading of the symbols."""
    docs = table(s, d, "symbols").select("id", F.concat_ws(":", "workspace", "path").alias("path"), *shown, F.col("name").alias("text"))
    texts, hits = search.best_of_own(docs, T.identifier_terms_of, F.col("id") % 50 == 0, 10)
    asked = texts.where("asked is not null").withColumnRenamed("id", "query_id")
    return asked.drop("asked"), hits.join(texts.drop("asked"), "id").drop("id", "score")


def _golden(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked, hits = _graded(s, d)
    return hits.select("query_id", F.col("path").alias("item"), "rank"), asked.select("query_id", F.col("path").alias("item"), F.lit(2).alias("grade"))


def ir_metrics(s: SparkSession, d: str) -> DataFrame:
    return evaluation.ir_metrics(*_golden(s, d))


def golden_metrics(s: SparkSession, d: str) -> DataFrame:
    """Each asked symbol's own place as golden item of grade 2, by path and symbol, and its file as one of grade 1."""
    asked, hits = _graded(s, d, F.col("name").alias("symbol"))
    items = F.array(F.struct(F.concat("path", F.lit("#"), "symbol").alias("item"), F.lit(2).alias("grade")), F.struct(F.col("path").alias("item"), F.lit(1).alias("grade")))
    golden = asked.select("query_id", F.inline(items))
    return evaluation.ir_metrics(evaluation.graded_hits(hits, golden), golden)


def ir_gate(s: SparkSession, d: str) -> DataFrame:
    return evaluation.gate(evaluation.mean_metrics(evaluation.ir_metrics(*_golden(s, d))))


def bench_report(s: SparkSession, d: str) -> DataFrame:
    chunks = chunks_of(s, d).where("workspace is not null")
    files = F.col("path")
    tasks = chunks.select(F.col("symbol_id").alias("task_id"), "workspace", T.token_estimate(F.length(F.coalesce("text", F.lit("")))).alias("injected"), F.array(files).alias("paths"))
    return evaluation.bench_report(tasks, files_of(s, d))


def queries() -> dict:
    return {
        "bm25_topk": bm25_topk, "bm25_prefix_topk": prefix_topk, "notes_bm25_topk": notes_topk, "lexical_union": lexical_union, "bm25_batch": bm25_batch, "cosine_topk": cosine_topk, "rrf_fusion": rrf_fusion,
        "hybrid_search": hybrid, "hash_embedding_sparse": hash_embeddings, "hash_embedding_topk": hash_topk, "symbol_embedding_input": symbol_inputs, "rerank_overlap": rerank, "lsh_candidates": lsh_candidates, "lsh_bucket_sizes": lsh_sizes,
        "classify_query": classify_queries, "classify_intent": classify_intents, "query_signals": query_signals, "tokenize_identifier": identifier_tokens, "grep_lines": grep_pattern, "grep_prefilter": grep_literal,
        "ngram_postings": ngram_postings, "ngram_sizes": ngram_sizes, "symbol_lookup": symbol_lookup, "list_paths": list_paths, "recent_symbols": recent_symbols, "merge_per_file": merged_hits, "merged_snippets": merged_snippets, "token_budget_pack": packed_budget, "zero_hit_ladder": fallback,
        "context_pack": context_pack, "fts_snippet": snippets, "hits_markdown": hits_markdown, "prompt_pack": packed_prompt, "span_cover": span_cover, "hit_windows": hit_windows, "ir_metrics": ir_metrics, "ir_gate": ir_gate, "golden_metrics": golden_metrics, "bench_report": bench_report,
    }


def _top(name: str, id_col: str, k: int, digits: int = 6, cte: str = "bm") -> str:
    return f"SELECT id AS {id_col}, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(score, {digits}) AS score FROM {cte}) ORDER BY score DESC, id LIMIT {k}"


_TOKENS = r"list_filter(list_distinct(list_concat([lower(name)], list_transform(string_split_regex(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)))), lambda x: x <> '')"


def _identifier_sql() -> str:
    # the order of first occurrence has to be kept, which list_distinct does not promise
    parts = r"list_concat([lower(name)], list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: x <> ''))"
    return f"p AS (SELECT id, workspace, path, {parts} AS a FROM s), tk AS (SELECT id, workspace, path, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' ') AS tokens FROM p)"


def _batch_sql() -> str:
    return f"""{SQL_SYMBOLS}, {_identifier_sql()},
t AS (SELECT id, list_filter(string_split_regex(lower(tokens), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM tk),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
po AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM t) GROUP BY ALL),
q AS (SELECT DISTINCT id AS query_id, unnest(t) AS term FROM t WHERE id % 50 = 0),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
w AS (SELECT query_id, term, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM q JOIN df USING (term), st),
sc AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM po JOIN w USING (term), st GROUP BY query_id, id),
hits AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10)"""


def _metrics_sql() -> str:
    return _batch_sql() + """,
it AS (SELECT query_id, concat(workspace, ':', path) AS item, min(rank) AS rank FROM hits JOIN s USING (id) GROUP BY ALL),
qr AS (SELECT id AS query_id, concat(workspace, ':', path) AS item FROM s WHERE id % 50 = 0),
m AS (SELECT qr.query_id, CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END AS recall5, CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END AS recall10, round(coalesce(1.0 / rank, 0), 6) AS rr,
  round(CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1) ELSE 0.0 END, 6) AS ndcg10 FROM qr LEFT JOIN it USING (query_id, item))"""


def _hash_topk_sql() -> str:
    return f"{hash_sql('documents')}, {hash_vector_sql(DOC_QUERY, 'qv')}, hs AS (SELECT doc_id AS id, sum(weight * v[idx + 1]) / sqrt(sum(weight * weight)) AS score FROM em, qv GROUP BY doc_id HAVING sum(weight * weight) > 0)"


_NAMED = "nc AS (SELECT symbol_id AS id, h.workspace, h.path, s.name, s.line, concat_ws(chr(10), h.header, h.text) AS text FROM h JOIN s ON s.id = h.symbol_id)"
_KEYED_LINES = "kl AS (SELECT workspace, path, unnest(generate_series(1, len(a))) AS line, rtrim(unnest(a), chr(13)) AS text, list_transform(a, lambda x: rtrim(x, chr(13))) AS a FROM (SELECT workspace, path, string_split(content, chr(10)) AS a FROM c))"
_DOC_LINES = "dl AS (SELECT * FROM (SELECT doc_id, unnest(generate_series(1, len(a))) AS n, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) WHERE trim(line) <> '')"
_COVER = """hit AS (SELECT id AS hit_id, workspace, path, line + 2 AS line, coalesce(signature, '') AS snippet FROM s),
sp AS (SELECT DISTINCT workspace, path, least(start_line, end_line) AS b, greatest(start_line, end_line) AS e FROM h WHERE start_line IS NOT NULL AND end_line IS NOT NULL),
cv AS (SELECT hit_id, b, e FROM (SELECT hit_id, b, e, row_number() OVER (PARTITION BY hit_id ORDER BY (b <> line)::INT, e - b, b) AS r FROM hit JOIN sp USING (workspace, path) WHERE line BETWEEN b AND e) WHERE r = 1)"""


def _served_sql() -> str:
    from lodestone.plans.code import _EXT, _ignored_sql

    return f"{_EXT} IN {(*T.SYMBOL_EXTENSIONS, *T.TEXT_EXTENSIONS)} AND NOT {_ignored_sql()} AND strlen(coalesce(content, '')) <= 1500000"


def _ladder_sql() -> str:
    names = [NAME, "trackShard"]
    parts = []
    for pos, name in enumerate(names):
        low = name.lower()
        parts.append(
            f"(SELECT 0 AS stage, {pos} AS pos, workspace, path, line, name AS text FROM (SELECT DISTINCT workspace, path, line, name, kind, CASE WHEN name = '{name}' THEN 0 WHEN starts_with(lower(name), '{low}') THEN 1 ELSE 2 END AS tier FROM s WHERE contains(lower(name), '{low}')) ORDER BY tier, length(name), name, workspace, path, line LIMIT 2)"
        )
    for pos, name in enumerate(names):
        parts.append(f"(SELECT 1 AS stage, {pos} AS pos, workspace, path, line, text FROM l WHERE contains(text, '{name}') ORDER BY path, workspace, line LIMIT 2)")
    return f"WITH {SQL_SYMBOLS}, {SQL_CORPUS}, {SQL_LINES}, u AS ({' UNION ALL '.join(parts)}) SELECT stage, workspace, path, line, text FROM u ORDER BY stage, pos, workspace, path, line LIMIT 8"


def _pack_sql() -> str:
    from lodestone.plans.code import _IMPORTS

    return f"""WITH {SQL_SYMBOLS}, {SQL_CHUNKS}, {_NAMED}, nw AS (SELECT * FROM nc WHERE workspace = '{WORKSPACE}'), {bm25_sql('nw', 'id', 'text', PHRASES)}, r AS ({_top('bm', 'id', 20)}), {_IMPORTS},
mg AS (SELECT workspace, path, max(r.score) AS score, array_to_string(list_sort(list(DISTINCT name)), ', ') AS symbols, array_to_string(list_sort(list(DISTINCT line)), ', ') AS lines FROM r JOIN nw USING (id) GROUP BY workspace, path),
cs AS (SELECT *, row_number() OVER w AS rn, sum(ceil((length(path) + length(symbols) + length(lines)) / 4.0)) OVER w AS cum FROM mg WINDOW w AS (ORDER BY score DESC, path, workspace ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT * FROM cs WHERE rn = 1 OR cum <= 1400), il AS (SELECT DISTINCT to_specifier FROM im JOIN kept ON kept.rn = 1 AND kept.workspace = im.workspace AND kept.path = im.from_path ORDER BY to_specifier LIMIT 8)
SELECT 'hit' AS part, path, score, symbols AS detail FROM kept UNION ALL SELECT 'import', to_specifier, 0.0, '' FROM il"""


def _snippet_sql() -> str:
    listed = ", ".join(f"'{t}'" for t in TERMS)
    return f"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents), p AS (SELECT doc_id, t, list_position(list_transform(t, lambda x: x IN ({listed})), TRUE) AS p FROM t),
q AS (SELECT doc_id, t, greatest(p - 12, 1) AS b FROM p WHERE p > 0) SELECT doc_id, CASE WHEN b > 1 THEN '... ' ELSE '' END || array_to_string(t[b:b + 23], ' ') || CASE WHEN b + 23 < len(t) THEN ' ...' ELSE '' END AS snippet FROM q"""


def oracle_sql() -> dict[str, str]:
    grep_rx = PATTERN.replace("\\", "\\")
    return {
        "bm25_topk": f"WITH {bm25_sql('documents', 'doc_id', 'text', TERMS)} {_top('bm', 'doc_id', 20)}",
        "bm25_prefix_topk": f"WITH {SQL_SYMBOLS}, {SQL_CHUNKS}, {_NAMED}, {bm25_sql('nc', 'id', 'text', PHRASES)} {_top('bm', 'id', 20)}",
        "notes_bm25_topk": f"WITH n AS (SELECT id, concat_ws(' ', text, tags, paths) AS text FROM memories), {bm25_sql('n', 'id', 'text', TERMS)} {_top('bm', 'id', 20)}",
        "lexical_union": f"""WITH {SQL_SYMBOLS}, {SQL_CHUNKS}, {SQL_CORPUS}, {_NAMED}, ns AS (SELECT id, workspace, path, name, line, concat_ws(' ', name, tokens, signature, path) AS text FROM s),
fl AS (SELECT struct_pack(w := workspace, p := path) AS key, content AS text FROM c WHERE NOT EXISTS (SELECT 1 FROM nc WHERE nc.workspace = c.workspace AND nc.path = c.path)), {bm25_sql('ns', 'id', 'text', PHRASES, 'a')}, {bm25_sql('nc', 'id', 'text', PHRASES, 'b')}, {bm25_sql('fl', 'key', 'text', PHRASES, 'e')},
u AS ((SELECT workspace, path, line, name AS symbol, 'symbols' AS source, round(score, 6) AS score FROM a JOIN ns USING (id) ORDER BY score DESC, workspace, path, line, symbol LIMIT 60)
UNION ALL (SELECT workspace, path, line, name, 'chunks', round(score * 0.9, 6) AS sc FROM b JOIN nc USING (id) ORDER BY sc DESC, workspace, path, line, name LIMIT 40)
UNION ALL (SELECT id.w, id.p, 0, '', 'files', round(score * 0.8, 6) AS sc FROM e ORDER BY sc DESC, id.w, id.p LIMIT 20))
SELECT workspace, path, line, symbol, source, score FROM (SELECT *, row_number() OVER (PARTITION BY workspace, path, line, symbol ORDER BY score DESC, source) AS r FROM u) WHERE r = 1 ORDER BY score DESC, workspace, path, line, symbol LIMIT 20""",
        "bm25_batch": f"WITH {_batch_sql()} SELECT query_id, id, score, rank FROM hits",
        "cosine_topk": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id AS id, round(list_inner_product(embedding::DOUBLE[], q), 4) AS score FROM embeddings, q), bm AS (SELECT * FROM x WHERE score >= 0.12) " + _top("bm", "vec_id", 8, 4),
        "rrf_fusion": f"WITH {bm25_sql('documents', 'doc_id', 'text', TERMS[:2], 'a')}, {bm25_sql('documents', 'doc_id', 'text', TERMS[2:], 'b')}, ra AS ({_top('a', 'doc_id', 20, cte='a')}), rb AS ({_top('b', 'doc_id', 20, cte='b')}), bm AS (SELECT doc_id AS id, sum(1.0 / (60 + rank)) AS score FROM (SELECT doc_id, rank FROM ra UNION ALL SELECT doc_id, rank FROM rb) GROUP BY doc_id) {_top('bm', 'doc_id', 20, 9)}",
        "hybrid_search": f"WITH {bm25_sql('documents', 'doc_id', 'text', search.phrases_of(DOC_QUERY), 'a')}, ra AS ({_top('a', 'doc_id', 20, cte='a')}), {_hash_topk_sql()}, hf AS (SELECT * FROM hs WHERE score >= 0.12), rb AS ({_top('hf', 'doc_id', 20, 4, cte='hf')}), bm AS (SELECT doc_id AS id, sum(1.0 / (60 + rank)) AS score FROM (SELECT doc_id, rank FROM ra UNION ALL SELECT doc_id, rank FROM rb) GROUP BY doc_id) {_top('bm', 'doc_id', 20, 9)}",
        "hash_embedding_sparse": f"WITH {hash_sql('documents')} SELECT doc_id, idx, weight::DOUBLE AS weight FROM em",
        "hash_embedding_topk": f"WITH {_hash_topk_sql()} {_top('hs', 'doc_id', 20, 4, cte='hs')}",
        "symbol_embedding_input": f"WITH {SQL_SYMBOLS}, {SQL_CHUNKS} SELECT symbol_id, concat_ws(' ', name, s.kind) || chr(10) || coalesce(text, '') AS input FROM h JOIN s ON s.id = h.symbol_id",
        "rerank_overlap": f"WITH {bm25_sql('documents', 'doc_id', 'text', TERMS)}, r AS ({_top('bm', 'doc_id', 20)}), o AS (SELECT doc_id, score, round(len(list_intersect(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+')), {sorted({p for p, x in search.phrases_of(DOC_QUERY) if not x})!r}))::DOUBLE / {len({p for p, x in search.phrases_of(DOC_QUERY) if not x})}, 6) AS overlap FROM r JOIN documents USING (doc_id)) SELECT doc_id, score, overlap FROM o ORDER BY overlap DESC, score DESC, doc_id LIMIT 8",
        "classify_query": f"WITH {_DOC_LINES}, " + r"""q AS (SELECT doc_id, n, trim(line) AS q FROM dl)
SELECT doc_id, n, CASE WHEN regexp_matches(q, '^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*$') THEN 'identifier' WHEN contains(q, ' ') AND regexp_matches(q, '[a-z]{3,}') AND NOT regexp_matches(q, '[A-Z]{2,}') THEN 'natural' ELSE 'mixed' END AS kind FROM q""",
        "classify_intent": f"WITH {_DOC_LINES}, " + r"""q AS (SELECT doc_id, trim(line) AS q FROM dl), w AS (SELECT doc_id, q, ' ' || lower(q) || ' ' AS l FROM q),
i AS (SELECT doc_id, CASE WHEN q = '' THEN 'meta' WHEN regexp_matches(q, '[A-Z][a-z]+[A-Z]|[a-z]+[A-Z][a-zA-Z]|[a-z]+_[a-z]+|\.[A-Za-z0-9_]+\(|[A-Za-z0-9_./-]+\.[a-zA-Z]{1,5}([^A-Za-z0-9_]|$)|`[^`]+`') THEN 'code'
WHEN regexp_matches(l, '^ (stop|done|thanks|thank you)[^a-z0-9_]|[^a-z0-9_]explain what you (did|just did|changed)[^a-z0-9_]|[^a-z0-9_](commit|push|merge|revert|stash|summarize|pull request|thanks|thank you|pr)[^a-z0-9_]') THEN 'meta'
WHEN regexp_matches(l, '[^a-z0-9_](explain|why|how does|what is|tell me about)[^a-z0-9_]') THEN 'question' ELSE 'code' END AS intent FROM w) SELECT doc_id, intent, count(*) AS n FROM i GROUP BY ALL""",
        "query_signals": r"""WITH t AS (SELECT id, text AS t FROM memories WHERE text IS NOT NULL),
a AS (SELECT id, list_filter(list_transform(list_concat(regexp_extract_all(t, '`([^`]+)`', 1), regexp_extract_all(t, '([\w./-]+\.[a-zA-Z]{1,5})\b', 1), regexp_extract_all(t, '\b([A-Z][a-zA-Z0-9]*[A-Z][A-Za-z0-9]*)\b', 1), regexp_extract_all(t, '\b([a-z]+[A-Z][A-Za-z0-9]*)\b', 1), regexp_extract_all(t, '\b([a-z]+_[a-z0-9_]+)\b', 1)), lambda x: trim(x)), lambda x: length(x) >= 2) AS a FROM t),
l AS (SELECT id, a, list_transform(a, lambda x: lower(x)) AS l FROM a) SELECT id, coalesce(array_to_string(list_filter(a, lambda x, i: list_position(l, lower(x)) = i)[1:12], '|'), '') AS signals FROM l""",
        "tokenize_identifier": f"WITH {SQL_SYMBOLS}, {_identifier_sql()} SELECT id, tokens FROM tk",
        "grep_lines": f"WITH {SQL_CORPUS}, {_KEYED_LINES} SELECT workspace, path, line, text FROM kl WHERE regexp_matches(text, '{grep_rx}')",
        "grep_prefilter": f"WITH {SQL_CORPUS}, {_KEYED_LINES} SELECT workspace, path, line, substr(array_to_string(list_transform(a[greatest(line - 2, 1):line + 2], lambda x, i: (i + greatest(line - 2, 1) - 1)::VARCHAR || '| ' || x), chr(10)), 1, 800) AS snippet FROM kl WHERE contains(text, '{NAME}')",
        "symbol_lookup": f"""WITH {SQL_SYMBOLS}, x AS (SELECT DISTINCT workspace, path, line, name, kind, CASE WHEN name = 'policy' THEN 0 WHEN starts_with(lower(name), 'policy') THEN 1 ELSE 2 END AS tier FROM s WHERE contains(lower(name), 'policy')),
o AS (SELECT *, row_number() OVER (ORDER BY tier, length(name), name, workspace, path, line) AS r FROM x) SELECT workspace, path, line, name, kind, 31 - r AS score FROM o WHERE r <= 30""",
        "list_paths": f"WITH {SQL_FILES} SELECT DISTINCT workspace, path FROM f WHERE starts_with(path, 'services/') ORDER BY path, workspace LIMIT 40",
        "recent_symbols": f"WITH {SQL_FILES}, {SQL_SYMBOLS} SELECT DISTINCT s.workspace, s.path, s.line, s.name, f.mtime_ms FROM s JOIN f USING (workspace, path) ORDER BY mtime_ms DESC, workspace, path, line, name LIMIT 20",
        "merge_per_file": f"""WITH {SQL_SYMBOLS}, {SQL_CHUNKS}, {_NAMED}, {bm25_sql('nc', 'id', 'text', PHRASES)}, hit AS (SELECT workspace, path, line, name, round(score, 6) AS score FROM bm JOIN nc USING (id))
SELECT workspace, path, max(score) AS score, array_to_string(list_sort(list(DISTINCT name)), ', ') AS symbols, array_to_string(list_sort(list(DISTINCT line)), ', ') AS lines, count(*) AS n FROM hit GROUP BY workspace, path""",
        "merged_snippets": f"""WITH {SQL_SYMBOLS}, {SQL_CHUNKS}, {_NAMED}, {bm25_sql('nc', 'id', 'text', PHRASES)}, r AS ({_top('bm', 'id', 20)}), x AS (SELECT workspace, path, line, name, r.score, substr(text, 1, 60) AS sn FROM r JOIN nc USING (id)),
g AS (SELECT workspace, path, max(score) AS score, array_to_string(list_sort(list(DISTINCT name)), ', ') AS symbols, array_to_string(list_sort(list(DISTINCT line)), ', ') AS lines, count(*) AS n, string_agg(sn, chr(10) || '---' || chr(10) ORDER BY score DESC, line, name, sn) FILTER (WHERE sn <> '') AS sn FROM x GROUP BY workspace, path)
SELECT workspace, path, score, symbols, lines, n, CASE WHEN n > 1 THEN concat_ws(chr(10), CASE WHEN lines <> '' THEN 'lines ' || lines END, sn) ELSE coalesce(sn, '') END AS snippet FROM g""",
        "token_budget_pack": f"""WITH {bm25_sql('documents', 'doc_id', 'text', TERMS)}, r AS ({_top('bm', 'doc_id', 200)}), x AS (SELECT doc_id, score, ceil(n_chars / 4.0)::BIGINT AS cost FROM r JOIN documents USING (doc_id)),
o AS (SELECT doc_id, cost, (sum(cost) OVER w)::BIGINT AS cum_cost, row_number() OVER w AS rn FROM x WINDOW w AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT doc_id, cost, cum_cost FROM o WHERE rn = 1 OR cum_cost <= 1400""",
        "zero_hit_ladder": _ladder_sql(),
        "context_pack": _pack_sql(),
        "fts_snippet": _snippet_sql(),
        "hits_markdown": f"""WITH {SQL_SYMBOLS}, {SQL_CHUNKS}, {_NAMED}, {bm25_sql('nc', 'id', 'text', PHRASES)}, r AS ({_top('bm', 'id', 20)}), x AS (SELECT workspace, path, line, name, rank, split_part(substr(text, 1, 60), chr(10), 1) AS sn FROM r JOIN nc USING (id))
SELECT workspace, string_agg('- ' || CASE WHEN coalesce(name, '') <> '' THEN '**' || name || '** ' ELSE '' END || path || ':' || line || CASE WHEN coalesce(sn, '') <> '' THEN chr(10) || '  ' || sn ELSE '' END, chr(10) ORDER BY rank) AS text FROM x GROUP BY workspace""",
        "span_cover": f"WITH {SQL_SYMBOLS}, {SQL_CHUNKS}, {_COVER} SELECT hit_id, line, b AS start_line, e AS end_line FROM hit LEFT JOIN cv USING (hit_id)",
        "hit_windows": f"""WITH {SQL_SYMBOLS}, {SQL_CHUNKS}, {SQL_CORPUS}, {_COVER},
rg AS (SELECT hit_id, workspace, path, snippet, CASE WHEN b IS NULL THEN line - 2 WHEN e - b + 1 > 80 THEN greatest(b, line - 40) ELSE b END AS f0, CASE WHEN b IS NULL THEN line + 2 WHEN e - b + 1 > 80 THEN least(greatest(b, line - 40) + 79, e) ELSE e END AS l0 FROM hit LEFT JOIN cv USING (hit_id)),
ln AS (SELECT workspace, path, list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: rtrim(x, chr(13))) AS a FROM c WHERE {_served_sql()}),
cl AS (SELECT hit_id, snippet, a, least(greatest(f0, 1), len(a)) AS f1, l0 FROM rg JOIN ln USING (workspace, path)), c2 AS (SELECT hit_id, snippet, a, f1, least(greatest(l0, f1), len(a), f1 + 79) AS l1 FROM cl),
bd AS (SELECT hit_id, f1, l1, substr(array_to_string(a[f1:l1], chr(10)), 1, 3500) AS body FROM c2),
fin AS (SELECT rg.hit_id, bd.f1 AS first, bd.l1 AS last, coalesce(CASE WHEN trim(body) <> '' THEN body END, snippet) AS sn FROM rg LEFT JOIN bd USING (hit_id))
SELECT hit_id, first, last, length(sn)::INT AS n_chars, md5(sn) AS body, length(trim(sn)) >= 24 AND first IS NOT NULL AS quality FROM fin""",
        "ir_metrics": f"WITH {_metrics_sql()} SELECT query_id, recall5::DOUBLE AS recall5, recall10::DOUBLE AS recall10, rr::DOUBLE AS rr, ndcg10::DOUBLE AS ndcg10 FROM m",
        "golden_metrics": f"""WITH {_batch_sql()}, gq AS (SELECT id AS query_id, concat(workspace, ':', path) AS path, name FROM s WHERE id % 50 = 0), hp AS (SELECT query_id, rank, concat(workspace, ':', path) AS path, name FROM hits JOIN s USING (id)),
go AS (SELECT query_id, path || '#' || name AS item, 2 AS grade FROM gq UNION ALL SELECT query_id, path, 1 FROM gq), mt AS (SELECT query_id, CASE WHEN hp.name = gq.name THEN hp.path || '#' || hp.name ELSE hp.path END AS item, min(rank) AS rank FROM hp JOIN gq USING (query_id, path) GROUP BY ALL),
cr AS (SELECT go.query_id, grade, rank FROM go LEFT JOIN mt USING (query_id, item))
SELECT query_id, round((count(*) FILTER (WHERE rank <= 5))::DOUBLE / least(count(*), 5), 6) AS recall5, round((count(*) FILTER (WHERE rank <= 10))::DOUBLE / least(count(*), 10), 6) AS recall10, round(coalesce(1.0 / min(rank), 0)::DOUBLE, 6) AS rr,
round(sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) / (3 / log2(2) + 1 / log2(3)), 6)::DOUBLE AS ndcg10 FROM cr GROUP BY query_id""",
        "ir_gate": f"WITH {_metrics_sql()}, a AS (SELECT round(avg(recall5::DOUBLE), 4) AS recall5, round(avg(rr::DOUBLE), 4) AS mrr, round(avg(ndcg10::DOUBLE), 4) AS ndcg10 FROM m) SELECT metric, value, floor, value >= floor AS passed FROM (SELECT 'recall5' AS metric, recall5 AS value, 0.5::DOUBLE AS floor FROM a UNION ALL SELECT 'mrr', mrr, 0.6 FROM a UNION ALL SELECT 'ndcg10', ndcg10, 0.45 FROM a)",
        "bench_report": f"""WITH {SQL_CHUNKS}, {SQL_FILES}, t AS (SELECT symbol_id AS task_id, workspace, path, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS injected FROM h WHERE workspace IS NOT NULL),
w AS (SELECT workspace, ceil(count(*) * 40 / 4.0)::BIGINT AS walk FROM f GROUP BY workspace)
SELECT task_id, injected, (coalesce(walk, 0) + coalesce(least(ceil(coalesce(size, 0) / 4.0)::BIGINT, 8000), 0) * (f.path IS NOT NULL)::INT)::BIGINT AS baseline, (coalesce(walk, 0) + coalesce(least(ceil(coalesce(size, 0) / 4.0)::BIGINT, 8000), 0) * (f.path IS NOT NULL)::INT - injected)::BIGINT AS net FROM t LEFT JOIN w USING (workspace) LEFT JOIN f ON f.workspace = t.workspace AND f.path = t.path""",
    }
