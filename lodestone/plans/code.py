"""Registered queries of files, extraction, graphs, index upkeep and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import format as fm
from lodestone.functions import text as T
from lodestone.operators import extract, graph, index, snapshot
from lodestone.plans.common import SQL_CORPUS, SQL_EVENTS, SQL_FILES, SQL_LINES, SQL_SYMBOLS, chunks_of, corpus_of, events_of, files_of, notes_of, symbols_of
from lodestone.sources.storage import cut_lineage
from lodestone.sources.tables import table

NAME = "fetchPolicy"


def corpus_walk(s: SparkSession, d: str) -> DataFrame:
    rules = T.ignore_rules()
    return files_of(s, d).where((T.extension_class(F.col("path")) != "other") & ~T.is_ignored(F.col("path"), rules)).select("workspace", "path")


def ignored_files(s: SparkSession, d: str) -> DataFrame:
    return files_of(s, d).select("workspace", "path", T.is_ignored(F.col("path"), T.ignore_rules()).alias("ignored"))


def extension_classes(s: SparkSession, d: str) -> DataFrame:
    return files_of(s, d).select("workspace", "path", T.extension_class(F.col("path")).alias("class"), T.parse_language(F.col("path")).alias("language"))


def safe_paths(s: SparkSession, d: str) -> DataFrame:
    """Paths as they are and bent in four ways, with whether each may be read."""
    p = F.col("path")
    bent = F.array(p, F.concat(F.lit("/"), p), F.concat(F.lit("../"), p), F.concat(F.lit("a/../"), p), F.concat(F.lit("a/../../"), p))
    return files_of(s, d).select("workspace", F.explode(bent).alias("path")).select("workspace", "path", T.is_safe_path(F.col("path")).alias("safe"))


def py_symbols(s: SparkSession, d: str) -> DataFrame:
    return extract.python_symbols(corpus_of(s, d))


def go_symbols(s: SparkSession, d: str) -> DataFrame:
    return extract.go_symbols(corpus_of(s, d))


def script_symbols(s: SparkSession, d: str) -> DataFrame:
    return extract.script_symbols(corpus_of(s, d))


def imports(s: SparkSession, d: str) -> DataFrame:
    return extract.import_edges(corpus_of(s, d))


def calls(s: SparkSession, d: str) -> DataFrame:
    return extract.call_edges(corpus_of(s, d))


def stored_calls(s: SparkSession, d: str) -> DataFrame:
    """The call edges as a written table, as an index holds them, for queries that use them more than once."""
    return cut_lineage(calls(s, d))


def resolved_imports(s: SparkSession, d: str) -> DataFrame:
    return extract.resolve_imports(imports(s, d), files_of(s, d))


def resolved_calls(s: SparkSession, d: str) -> DataFrame:
    return extract.resolve_calls(stored_calls(s, d), symbols_of(s, d), cut_lineage(resolved_imports(s, d)))


def built_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks built from symbols and texts: their sizes and a digest of each."""
    built = extract.build_chunks(symbols_of(s, d), corpus_of(s, d))
    return built.select("id", "start_line", "end_line", "header", F.length("text").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


def changed_symbols(s: SparkSession, d: str) -> DataFrame:
    """Symbols that hold a line which the newest version of a file has and its oldest has not."""
    rows = table(s, d, "corpus")
    oldest = rows.groupBy("workspace", "path").agg(F.min_by("content", F.struct("mtime_ms", F.xxhash64("content"))).alias("content"))
    return extract.changed_symbols(extract.changed_lines(oldest, corpus_of(s, d), *T.SYMBOL_EXTENSIONS), symbols_of(s, d))


def parse_agreement(s: SparkSession, d: str) -> DataFrame:
    """How the language that a path is scanned as agrees with what the parser reported."""
    reported = table(s, d, "parse_results").dropDuplicates(["workspace", "path"])
    joined = files_of(s, d).join(reported.select("workspace", "path", F.col("language").alias("reported")), ["workspace", "path"], "left")
    return joined.groupBy(T.parse_language(F.col("path")).alias("scanned"), T.canonical_language(F.col("reported")).alias("reported")).agg(F.count("*").alias("n"))


def impact_definitions(s: SparkSession, d: str) -> DataFrame:
    return graph.best_definitions(symbols_of(s, d), NAME, 20)


def key_importers(s: SparkSession, d: str) -> DataFrame:
    """Breadth first from one region over the keys of nations, customers and orders: a dense graph of depth three."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda t, kind, a, to, b: table(s, d, t).select(F.lit("").alias("workspace"), node(kind, a).alias("from_path"), node(to, b).alias("to_path"))
    edges = edge("nation", "nation", "n_nationkey", "region", "n_regionkey").unionByName(edge("customer", "customer", "c_custkey", "nation", "c_nationkey")).unionByName(edge("orders", "order", "o_orderkey", "customer", "o_custkey"))
    start = table(s, d, "region").where("r_name = 'ASIA'").select(F.lit("").alias("workspace"), node("region", "r_regionkey").alias("path"))
    return graph.importers(edges, start, 3).select("path", "depth", (F.lit(4) - F.col("depth")).alias("score"))


def impact_importers(s: SparkSession, d: str) -> DataFrame:
    """Importers of every tenth file by relative imports, up to three steps."""
    start = files_of(s, d).where(F.pmod(F.length("path"), F.lit(10)) == 0)
    return graph.importers(cut_lineage(resolved_imports(s, d)), start, 3)


def impact_callers(s: SparkSession, d: str) -> DataFrame:
    return graph.callers(calls(s, d), NAME, graph.definitions(symbols_of(s, d), NAME))


def impact_references(s: SparkSession, d: str) -> DataFrame:
    defined = graph.definitions(symbols_of(s, d), NAME)
    return graph.references(corpus_of(s, d), NAME, defined, graph.callers(calls(s, d), NAME, defined))


def impact(s: SparkSession, d: str) -> DataFrame:
    return graph.impact(symbols_of(s, d), cut_lineage(resolved_imports(s, d)), stored_calls(s, d), corpus_of(s, d), NAME, 2)


def call_graph(s: SparkSession, d: str) -> DataFrame:
    return graph.call_graph(stored_calls(s, d))


def call_graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.call_graph_nodes(stored_calls(s, d), symbols_of(s, d))


def call_graph_details(s: SparkSession, d: str) -> DataFrame:
    return graph.node_details(cut_lineage(graph.enclosing(calls(s, d), symbols_of(s, d))), symbols_of(s, d))


def impact_text(s: SparkSession, d: str) -> DataFrame:
    return fm.impact_as_text(impact(s, d), NAME)


def counts(s: SparkSession, d: str) -> DataFrame:
    return snapshot.table_counts(files=files_of(s, d), symbols=symbols_of(s, d), chunks=chunks_of(s, d), notes=notes_of(s, d), parsed=table(s, d, "parse_results").dropDuplicates(["workspace", "path"]))


def symbol_kinds(s: SparkSession, d: str) -> DataFrame:
    return snapshot.top_counts(symbols_of(s, d), F.col("kind"), "kind")


def folders(s: SparkSession, d: str) -> DataFrame:
    return snapshot.folder_rollup(files_of(s, d))


def languages(s: SparkSession, d: str) -> DataFrame:
    return snapshot.language_counts(files_of(s, d))


def heaviest(s: SparkSession, d: str) -> DataFrame:
    return snapshot.heaviest_files(symbols_of(s, d), files_of(s, d))


def listing(s: SparkSession, d: str) -> DataFrame:
    return snapshot.directory_listing(files_of(s, d))


def shares(s: SparkSession, d: str) -> DataFrame:
    return snapshot.top_shares(snapshot.top_counts(symbols_of(s, d), F.col("workspace"), "workspace"), "workspace", 12)


def health(s: SparkSession, d: str) -> DataFrame:
    return snapshot.index_health(files_of(s, d), symbols_of(s, d), chunks_of(s, d), notes_of(s, d)).unionByName(snapshot.usage_health(events_of(s, d)))


def workspace_stats(s: SparkSession, d: str) -> DataFrame:
    """Files and symbols of every workspace; scratch workspaces are left out."""
    keep = lambda df: df.where("workspace is not null and not contains(workspace, '/tmp/') and not contains(workspace, '/var/folders/') and workspace not like 'tmp/%'")
    files = keep(files_of(s, d)).groupBy("workspace").agg(F.count("*").alias("n_files"))
    symbols = keep(symbols_of(s, d)).groupBy("workspace").agg(F.count("*").alias("n_symbols"))
    return files.join(symbols, "workspace", "left").select("workspace", "n_files", F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def _scans(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two listings of each file: its oldest scan and its newest."""
    rows = table(s, d, "files").select("workspace", "path", "hash", "mtime_ms", "size")
    entry = F.struct(F.col("mtime_ms"), F.col("hash"), F.col("size"))
    pick = lambda f: rows.groupBy("workspace", "path").agg(f(entry).alias("v")).select("workspace", "path", F.col("v.hash").alias("hash"), F.col("v.mtime_ms").alias("mtime_ms"), F.col("v.size").alias("size"))
    return pick(F.min), pick(F.max)


def dirty_diff(s: SparkSession, d: str) -> DataFrame:
    old, new = _scans(s, d)
    return index.dirty_files(old.where(F.pmod(F.length("path"), F.lit(7)) != 0), new.where(F.pmod(F.length("path"), F.lit(11)) != 0))


def version_diff(s: SparkSession, d: str) -> DataFrame:
    old, new = _scans(s, d)
    return index.version_diff(old.where(F.pmod(F.length("path"), F.lit(7)) != 0), new.where(F.pmod(F.length("path"), F.lit(11)) != 0))


def prune_missing(s: SparkSession, d: str) -> DataFrame:
    return index.missing_files(table(s, d, "files"), table(s, d, "corpus"))


def without_missing(s: SparkSession, d: str) -> DataFrame:
    """Symbols that stay when the files that were never read are taken out."""
    return index.without_paths(symbols_of(s, d), prune_missing(s, d)).select("id", "workspace", "path")


def orphans(s: SparkSession, d: str) -> DataFrame:
    return index.orphans(symbols_of(s, d), chunks_of(s, d), files_of(s, d))


def status_lines(s: SparkSession, d: str) -> DataFrame:
    """Status lines written from the listing and read again."""
    n = F.pmod(F.length("path"), F.lit(4))
    line = F.when(n == 0, F.concat(F.lit(" M "), "path")).when(n == 1, F.concat(F.lit(" D "), "path")).when(n == 2, F.concat(F.lit("R  old.ts -> "), "path")).otherwise(F.concat(F.lit('?? "'), "path", F.lit('"')))
    return index.parse_status(files_of(s, d).select(line.alias("line")))


def queries() -> dict:
    return {
        "corpus_walk": corpus_walk, "ignore_last_match": ignored_files, "ext_classify": extension_classes, "path_safety": safe_paths, "py_symbols": py_symbols, "go_symbols": go_symbols, "script_symbols": script_symbols,
        "import_edges": imports, "call_edges": calls, "resolve_imports": resolved_imports, "resolve_targets": resolved_calls, "chunk_build": built_chunks, "changed_symbols": changed_symbols, "parse_agreement": parse_agreement,
        "impact_definitions": impact_definitions, "impact_importers_bfs": key_importers, "impact_file_importers": impact_importers, "impact_callers": impact_callers, "impact_references": impact_references, "impact": impact, "call_graph_topk": call_graph,
        "call_graph_nodes": call_graph_nodes, "call_graph_details": call_graph_details, "impact_markdown": impact_text, "table_counts": counts, "symbol_kinds": symbol_kinds, "folder_rollup": folders, "language_counts": languages, "heaviest_files": heaviest, "directory_listing": listing, "top_shares": shares,
        "index_health": health, "workspace_stats": workspace_stats, "dirty_diff": dirty_diff, "version_diff": version_diff, "prune_missing": prune_missing, "delete_by_path": without_missing, "integrity_check": orphans, "git_status_parse": status_lines,
    }


_EXT = r"lower(regexp_extract(path, '\.([^./]+)$', 1))"
_LANG = f"CASE WHEN {_EXT} IN ('ts', 'tsx') THEN 'typescript' WHEN {_EXT} IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' WHEN {_EXT} = 'py' THEN 'python' WHEN {_EXT} = 'go' THEN 'go' ELSE 'text' END"


def _canonical(c: str) -> str:
    low = f"lower(trim({c}))"
    return f"coalesce(CASE WHEN {low} IN ('ts', 'typescript') THEN 'typescript' WHEN {low} IN ('js', 'javascript') THEN 'javascript' WHEN {low} IN ('py', 'python') THEN 'python' WHEN {low} IN ('go', 'golang') THEN 'go' WHEN {low} IN ('yml', 'yaml') THEN 'yaml' WHEN {low} IN ('md', 'markdown') THEN 'md' WHEN {low} IN ('json', 'jsonc') THEN 'json' WHEN {low} = '' THEN 'unknown' ELSE {low} END, 'unknown')"


def _ignored_sql() -> str:
    decided = "NULL::BOOLEAN"
    for regex, ignored in T.ignore_rules():
        decided = f"CASE WHEN regexp_matches(path, '{regex}') THEN {str(ignored).upper()} ELSE {decided} END"
    return f"coalesce({decided}, FALSE)"


_PY_DEF = r"^[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*\("
_PY_CLASS = r"^[ \t]*class[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*[:(]"
_GO_FUNC = r"^func[ \t]+(?:\([^)]+\)[ \t]*)?([A-Za-z_][A-Za-z0-9_]*)[ \t]*\("
_GO_TYPE = r"^type[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]+"
_CALL = r"(?:^|[^A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)?)[ \t]*\("
_PARTS = r"list_concat([lower(name)], list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda x: lower(x)), lambda x: x <> ''))"


def _symbols_sql(ext: str, cases: list[tuple[str, str]]) -> str:
    when = " ".join(f"WHEN regexp_matches(text, '{r}') THEN '{k}'" for r, k in cases)
    name = " ".join(f"WHEN regexp_matches(text, '{r}') THEN regexp_extract(text, '{r}', 1)" for r, _ in cases)
    return f"""WITH {SQL_CORPUS}, {SQL_LINES}, x AS (SELECT workspace, path, CASE {name} END AS name, CASE {when} END AS kind, line::INT AS line, text FROM l WHERE {_EXT} IN ({ext})),
y AS (SELECT *, {_PARTS} AS a FROM x WHERE kind IS NOT NULL)
SELECT workspace, path, name, kind, line, line AS end_line, substr(trim(text, ' '), 1, 240) AS signature, array_to_string(list_filter(a, lambda v, i: list_position(a, v) = i), ' ') AS tokens FROM y"""


_IMPORTS = rf"""{SQL_CORPUS}, {SQL_LINES}, lg AS (SELECT *, lag(text) OVER (PARTITION BY workspace, path ORDER BY line) AS before FROM l),
im AS (SELECT workspace, path AS from_path, trim(coalesce(nullif(regexp_extract(text, '^[ \t]*(?:from[ \t]+([^ \t]+)[ \t]+)?import[ \t]+(.+)$', 1), ''), regexp_extract(text, '^[ \t]*(?:from[ \t]+([^ \t]+)[ \t]+)?import[ \t]+(.+)$', 2))) AS to_specifier, line::INT AS line
  FROM l WHERE {_EXT} = 'py' AND regexp_matches(text, '^[ \t]*(?:from[ \t]+([^ \t]+)[ \t]+)?import[ \t]+(.+)$') AND NOT regexp_matches(text, '{_PY_DEF}') AND NOT regexp_matches(text, '{_PY_CLASS}')
UNION ALL SELECT workspace, path, regexp_extract(text, '^[ \t]*"([^"]+)"[ \t]*$', 1), line::INT FROM lg WHERE {_EXT} = 'go' AND regexp_matches(text, '^[ \t]*"([^"]+)"[ \t]*$') AND regexp_matches(before, 'import[ \t]*\(')
UNION ALL SELECT workspace, path, regexp_extract(text, '^(?:import|export)[ \t{{*].*?["'']([^"'']+)["''];?[ \t]*$', 1), line::INT FROM l WHERE {_EXT} IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs') AND regexp_matches(text, '^(?:import|export)[ \t{{*].*?["'']([^"'']+)["''];?[ \t]*$') AND regexp_matches(text, '(from|import)[ \t]*["'']'))"""
_SCRIPT = "('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs')"
_MEMBER = r"^(?: {1,4}|\t)(?:(?:public|private|protected|static|async|override|readonly)[ \t]+)*\*?([A-Za-z_][A-Za-z0-9_]*)[ \t]*(?:<[^<>()]*>)?\(.*\)[ \t]*(?::[^={]+)?\{"
_WORDS = str(tuple(extract.KEYWORDS))


def _calls_sql() -> str:
    code = "text"
    for pattern, instead in extract._STRIPPED[:-1]:
        code = f"regexp_replace({code}, '{pattern.replace(chr(39), chr(39) * 2)}', '{instead.replace(chr(39), chr(39) * 2).replace('$1', chr(92) + '1')}', 'g')"
    return rf"""l1 AS (SELECT workspace, path, line, {code} AS t FROM l WHERE {_EXT} IN {_SCRIPT} AND contains(text, '(')), l2 AS (SELECT *, regexp_extract(t, '{_MEMBER}', 1) AS h FROM l1),
l3 AS (SELECT workspace, path, line, replace(CASE WHEN h <> '' AND h NOT IN {_WORDS} THEN regexp_replace(t, '^[ \t]*(?:[a-z]+[ \t]+)*\*?[A-Za-z_][A-Za-z0-9_]*[ \t]*(?:<[^<>()]*>)?\(', '(') ELSE t END, '(', '( ') AS t FROM l2),
l4 AS (SELECT workspace, path, line, string_split(unnest(regexp_extract_all(t, '{extract._SCRIPT_CALL}', 1)), '.') AS x FROM l3),
cl AS (SELECT * EXCLUDE (e) FROM (SELECT workspace, path AS from_path, regexp_extract(text, '{_CALL}', 1) AS to_name, line::INT AS line, {_EXT} AS e FROM l WHERE ({_EXT} = 'py' AND NOT regexp_matches(text, '{_PY_DEF}') AND NOT regexp_matches(text, '{_PY_CLASS}')) OR ({_EXT} = 'go' AND NOT regexp_matches(text, '{_GO_FUNC}')))
  WHERE to_name <> '' AND NOT (e = 'py' AND to_name IN ('def', 'class', 'if', 'for', 'while', 'return')) AND NOT (e = 'go' AND to_name = 'func')
  UNION ALL SELECT workspace, path, CASE WHEN len(x) = 2 AND x[1] NOT IN ('this', 'super') THEN array_to_string(x, '.') ELSE x[-1] END, line::INT FROM l4 WHERE x[-1] NOT IN {_WORDS} AND NOT (len(x) = 1 AND x[1] = 'this'))"""


_CALLS = _calls_sql()


def _resolved_sql() -> str:
    exts = extract.IMPORT_EXTENSIONS
    bare = r"regexp_replace(base, '\.(js|jsx|mjs|cjs)$', '')"
    cand = ["base", *[f"base || '{e}'" for e in exts], *[f"CASE WHEN {bare} <> base THEN {bare} || '{e}' END" for e in exts], *[f"base || '/index{e}'" for e in exts]]
    return rf"""{SQL_FILES}, {_IMPORTS},
jn AS (SELECT *, CASE WHEN starts_with(to_specifier, '/') THEN to_specifier ELSE regexp_replace(from_path, '[^/]*$', '') || to_specifier END AS j FROM im WHERE regexp_matches(to_specifier, '^(/|\.\.?/|\.\.?$)')),
pt AS (SELECT *, list_filter(string_split(j, '/'), lambda x: x <> '' AND x <> '.') AS p FROM jn),
bs AS (SELECT *, array_to_string(list_reduce(p, lambda a, x: CASE WHEN x = '..' THEN a[1:len(a) - 1] ELSE list_append(a, x) END, []::VARCHAR[]), '/') AS base FROM (SELECT workspace, from_path, to_specifier, line, list_transform(p, lambda x: [x]) AS q, p FROM pt)),
cd AS (SELECT workspace, from_path, to_specifier, line, unnest([{", ".join(cand)}]) AS path, unnest(generate_series(0, {len(cand) - 1})) AS ord FROM bs),
mt AS (SELECT workspace, from_path, to_specifier, line, arg_min(path, ord) AS to_path FROM cd JOIN (SELECT DISTINCT workspace, path FROM f) USING (workspace, path) GROUP BY ALL),
ri AS (SELECT im.*, mt.to_path FROM im LEFT JOIN mt ON im.workspace IS NOT DISTINCT FROM mt.workspace AND im.from_path = mt.from_path AND im.to_specifier = mt.to_specifier AND im.line = mt.line)"""


def _impact_sql(name: str, depth: int) -> str:
    return f"""{_resolved_sql().replace("WITH ", "")}, {SQL_SYMBOLS}, {_CALLS},
df AS (SELECT DISTINCT workspace, path, line, name FROM s WHERE name = '{name}' OR suffix(name, '.{name}')),
ca AS (SELECT DISTINCT workspace, from_path AS path, line, to_name FROM cl WHERE to_name = '{name}' OR suffix(to_name, '.{name}')), cb AS (SELECT * FROM ca WHERE (workspace, path) NOT IN (SELECT workspace, path FROM df)),
rf AS (SELECT workspace, path FROM c WHERE regexp_matches(content, '(^|[^A-Za-z0-9_]){name}([^A-Za-z0-9_]|$)') AND (workspace, path) NOT IN (SELECT workspace, path FROM df) AND (workspace, path) NOT IN (SELECT workspace, path FROM cb)),
ed AS (SELECT DISTINCT workspace, from_path, to_path FROM ri WHERE to_path IS NOT NULL),
bf(workspace, path, d) AS (SELECT DISTINCT workspace, path, 0 FROM df UNION SELECT ed.workspace, ed.from_path, d + 1 FROM bf JOIN ed ON ed.workspace = bf.workspace AND ed.to_path = bf.path WHERE d < {depth}),
ip AS (SELECT workspace, path, min(d) AS depth FROM bf GROUP BY workspace, path HAVING min(d) > 0)"""


def oracle_sql() -> dict[str, str]:
    classes = f"CASE WHEN {_EXT} IN {T.SYMBOL_EXTENSIONS} THEN 'symbols' WHEN {_EXT} IN {T.TEXT_EXTENSIONS} THEN 'text' ELSE 'other' END"
    useful = f"length(trim(to_name)) >= 2 AND to_name <> '(anon)' AND lower(trim(to_name)) NOT IN {tuple(graph.NOISE_NAMES)} AND NOT ({' OR '.join(f'''starts_with(trim(to_name), '{p}')''' for p in graph.NOISE_PREFIXES)}) AND trim(to_name) NOT IN {tuple(graph.DECORATORS)}"
    scans = "a AS (SELECT workspace, path, min(struct_pack(m := mtime_ms, h := hash, z := size)) AS v FROM files GROUP BY 1, 2), b AS (SELECT workspace, path, max(struct_pack(m := mtime_ms, h := hash, z := size)) AS v FROM files GROUP BY 1, 2), o AS (SELECT workspace, path, v.h AS h0, v.m AS m0, v.z AS s0 FROM a WHERE length(path) % 7 <> 0), n AS (SELECT workspace, path, v.h AS h1, v.m AS m1, v.z AS s1 FROM b WHERE length(path) % 11 <> 0), jo AS (SELECT coalesce(o.workspace, n.workspace) AS workspace, coalesce(o.path, n.path) AS path, h0, m0, s0, h1, m1, s1, o.path IS NULL AS no0, n.path IS NULL AS no1 FROM o FULL JOIN n ON o.workspace IS NOT DISTINCT FROM n.workspace AND o.path = n.path)"
    return {
        "corpus_walk": f"WITH {SQL_FILES} SELECT workspace, path FROM f WHERE {classes} <> 'other' AND NOT {_ignored_sql()}",
        "ignore_last_match": f"WITH {SQL_FILES} SELECT workspace, path, {_ignored_sql()} AS ignored FROM f",
        "ext_classify": f"WITH {SQL_FILES} SELECT workspace, path, {classes} AS class, {_LANG} AS language FROM f",
        "path_safety": f"WITH {SQL_FILES} SELECT workspace, x.p AS path, x.ok AS safe FROM (SELECT workspace, unnest([struct_pack(p := path, ok := TRUE), struct_pack(p := '/' || path, ok := FALSE), struct_pack(p := '../' || path, ok := FALSE), struct_pack(p := 'a/../' || path, ok := TRUE), struct_pack(p := 'a/../../' || path, ok := FALSE)]) AS x FROM f)",
        "py_symbols": _symbols_sql("'py'", [(_PY_DEF, "function"), (_PY_CLASS, "class")]),
        "go_symbols": _symbols_sql("'go'", [(_GO_FUNC, "function"), (_GO_TYPE, "type")]),
        "script_symbols": _symbols_sql("'ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs'", [(r, k) for r, k, _ in extract._TS]).replace("y AS (", f"""v AS (SELECT workspace, path, line, text, regexp_extract(text, '{extract._TS_CLASS}', 1) AS o, regexp_extract(text, '{_MEMBER}', 1) AS m FROM l WHERE {_EXT} IN {_SCRIPT}),
z AS (SELECT *, last_value(CASE WHEN o <> '' THEN o WHEN starts_with(text, '}}') THEN '' END IGNORE NULLS) OVER (PARTITION BY workspace, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM v),
xx AS (SELECT * FROM x UNION ALL SELECT workspace, path, held || '.' || m, 'method', line::INT, text FROM z WHERE m <> '' AND held <> '' AND m NOT IN {_WORDS}),
y AS (""").replace("AS a FROM x WHERE", "AS a FROM xx WHERE"),
        "import_edges": f"WITH {_IMPORTS} SELECT workspace, from_path, to_specifier, line FROM im",
        "call_edges": f"WITH {SQL_CORPUS}, {SQL_LINES}, {_CALLS} SELECT workspace, from_path, to_name, line FROM cl",
        "resolve_imports": f"WITH {_resolved_sql()} SELECT workspace, from_path, to_specifier, line, to_path FROM ri",
        "resolve_targets": rf"""WITH {_resolved_sql()}, {SQL_SYMBOLS}, {_CALLS}, nm AS (SELECT DISTINCT cl.workspace, cl.to_name, s.path AS to_path FROM (SELECT DISTINCT workspace, to_name FROM cl) cl JOIN s ON s.workspace = cl.workspace AND string_split(s.name, '.')[-1] = string_split(cl.to_name, '.')[-1] AND (s.name = cl.to_name OR suffix(s.name, '.' || cl.to_name))),
oy AS (SELECT workspace, to_name, count(*) AS n, min(to_path) AS one FROM nm GROUP BY ALL), im2 AS (SELECT x.workspace, x.from_path, x.to_name, min(x.to_path) AS imp FROM (SELECT DISTINCT cl.workspace, cl.from_path, cl.to_name, ri.to_path FROM cl JOIN ri ON ri.workspace = cl.workspace AND ri.from_path = cl.from_path WHERE ri.to_path IS NOT NULL) x JOIN nm USING (workspace, to_name, to_path) GROUP BY ALL)
SELECT cl.workspace, cl.from_path, cl.to_name, cl.line, CASE WHEN oy.n = 1 THEN oy.one ELSE coalesce(sm.to_path, im2.imp) END AS to_path FROM cl LEFT JOIN oy ON oy.workspace = cl.workspace AND oy.to_name = cl.to_name LEFT JOIN nm sm ON sm.workspace = cl.workspace AND sm.to_name = cl.to_name AND sm.to_path = cl.from_path LEFT JOIN im2 ON im2.workspace = cl.workspace AND im2.from_path = cl.from_path AND im2.to_name = cl.to_name""",
        "chunk_build": rf"""WITH {SQL_CORPUS}, {SQL_SYMBOLS}, ls AS (SELECT workspace, path, list_transform(string_split(content, chr(10)), lambda x: rtrim(x, chr(13))) AS a FROM c WHERE content IS NOT NULL),
j0 AS (SELECT s.id, s.line, s.end_line, substr(s.path || ' > ' || s.name || '(' || coalesce(s.signature, '') || ')', 1, 300) AS header, a, list_reverse(a[greatest(s.line - 16, 1):s.line - 1]) AS up FROM s JOIN ls ON ls.workspace = s.workspace AND ls.path = s.path),
j1 AS (SELECT *, list_position(list_transform(up, lambda x: trim(x, ' ') <> ''), TRUE) AS k FROM j0), j2 AS (SELECT *, CASE WHEN k > 0 THEN up[k:] ELSE [] END AS rest FROM j1),
j3 AS (SELECT *, list_position(list_transform(rest, lambda x: regexp_matches(trim(x, ' '), '^(//|#|/\*|\*|\"\"\")')), FALSE) AS stop FROM j2),
j4 AS (SELECT id, line, end_line, header, array_to_string(list_filter([header, array_to_string(list_reverse(rest[1:least(CASE WHEN stop > 0 THEN stop - 1 ELSE len(rest) END, 8)]), chr(10)), array_to_string(a[line:greatest(end_line, line)], chr(10))], lambda x: x <> ''), chr(10)) AS t FROM j3)
SELECT id, line AS start_line, end_line, header, length(t)::INT AS n_chars, md5(t) AS digest FROM j4""",
        "changed_symbols": f"""WITH {SQL_CORPUS}, {SQL_LINES}, {SQL_SYMBOLS}, ol AS (SELECT workspace, path, rtrim(unnest(string_split(arg_min(content, mtime_ms), chr(10))), chr(13)) AS text FROM corpus WHERE {_EXT} IN {T.SYMBOL_EXTENSIONS} GROUP BY workspace, path),
nl AS (SELECT * FROM l WHERE {_EXT} IN {T.SYMBOL_EXTENSIONS} AND NOT EXISTS (SELECT 1 FROM ol WHERE ol.workspace = l.workspace AND ol.path = l.path AND ol.text = l.text)),
x AS (SELECT DISTINCT s.workspace, s.path, s.name, s.line FROM s JOIN nl ON nl.workspace = s.workspace AND nl.path = s.path AND nl.line BETWEEN s.line AND s.end_line)
SELECT workspace, path, name, line FROM (SELECT *, row_number() OVER (PARTITION BY workspace, path ORDER BY line, name) AS r FROM x) WHERE r <= 6""",
        "parse_agreement": f"WITH {SQL_FILES}, p AS (SELECT DISTINCT ON (workspace, path) workspace, path, language AS rep FROM parse_results) SELECT {_LANG.replace('path', 'f.path')} AS scanned, {_canonical('rep')} AS reported, count(*) AS n FROM f LEFT JOIN p ON p.workspace = f.workspace AND p.path = f.path GROUP BY ALL",
        "impact_definitions": f"WITH {SQL_SYMBOLS}, x AS (SELECT DISTINCT workspace, path, line, name, (name = '{NAME}')::INT AS e FROM s WHERE name = '{NAME}' OR suffix(name, '.{NAME}')), o AS (SELECT *, row_number() OVER (ORDER BY e DESC, workspace, path, line, name) AS rank FROM x) SELECT workspace, path, line, name, rank FROM o WHERE rank <= 20",
        "impact_importers_bfs": """WITH n AS (SELECT n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'), c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT k FROM n)), o AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT k FROM c))
SELECT 'nation:' || k AS path, 1 AS depth, 3 AS score FROM n UNION ALL SELECT 'customer:' || k, 2, 2 FROM c UNION ALL SELECT 'order:' || k, 3, 1 FROM o""",
        "impact_file_importers": f"WITH RECURSIVE {_resolved_sql()}, ed AS (SELECT DISTINCT workspace, from_path, to_path FROM ri WHERE to_path IS NOT NULL), bf(workspace, path, d) AS (SELECT DISTINCT workspace, path, 0 FROM f WHERE length(path) % 10 = 0 UNION SELECT ed.workspace, ed.from_path, d + 1 FROM bf JOIN ed ON ed.workspace = bf.workspace AND ed.to_path = bf.path WHERE d < 3) SELECT workspace, path, min(d) AS depth FROM bf GROUP BY workspace, path HAVING min(d) > 0",
        "impact_callers": f"WITH RECURSIVE {_impact_sql(NAME, 2)} SELECT workspace, path, line, to_name FROM cb",
        "impact_references": f"WITH RECURSIVE {_impact_sql(NAME, 2)} SELECT workspace, path FROM rf",
        "impact": f"WITH RECURSIVE {_impact_sql(NAME, 2)} SELECT 'definition' AS section, workspace, path, line, 1.0::DOUBLE AS score FROM df UNION ALL SELECT 'importer', workspace, path, 0, (3 - depth)::DOUBLE FROM ip UNION ALL SELECT 'caller', workspace, path, line, 0.8 FROM cb UNION ALL SELECT 'reference', workspace, path, 0, 0.5 FROM rf",
        "call_graph_topk": f"""WITH {SQL_CORPUS}, {SQL_LINES}, {_CALLS}, dg AS (SELECT to_name, count(*) AS n FROM cl GROUP BY 1 ORDER BY n DESC, to_name LIMIT 288), ch AS (SELECT to_name FROM dg WHERE {useful} ORDER BY n DESC, to_name LIMIT 48),
ed AS (SELECT from_path, to_name, count(*) AS weight FROM cl JOIN ch USING (to_name) GROUP BY 1, 2 ORDER BY weight DESC, from_path, to_name LIMIT 270), nu AS (SELECT *, row_number() OVER (ORDER BY weight DESC, from_path, to_name) AS n FROM ed),
ad AS (SELECT from_path FROM (SELECT from_path, row_number() OVER (ORDER BY min(n)) AS p FROM nu GROUP BY from_path) WHERE p <= 24) SELECT from_path AS source, to_name AS target, weight FROM nu WHERE from_path IN (SELECT from_path FROM ad) ORDER BY n LIMIT 90""",
        "call_graph_nodes": f"""WITH {SQL_CORPUS}, {SQL_LINES}, {SQL_SYMBOLS}, {_CALLS}, dg AS (SELECT string_split(to_name, '.')[-1] AS name, count(*) AS sites, count(DISTINCT (workspace, from_path)) AS callers FROM cl WHERE {useful} GROUP BY 1 ORDER BY sites DESC, name LIMIT 48),
fd AS (SELECT name, arg_min(kind, struct_pack(w := workspace, p := path, l := line)) AS kind, arg_min(line, struct_pack(w := workspace, p := path, l := line)) AS line, count(DISTINCT (workspace, path)) AS n_paths FROM s WHERE name IN (SELECT name FROM dg) GROUP BY name) SELECT name, kind, line, coalesce(n_paths, 0) AS n_paths, callers, sites FROM dg LEFT JOIN fd USING (name)""",
        "call_graph_details": rf"""WITH {SQL_CORPUS}, {SQL_LINES}, {SQL_SYMBOLS}, {_CALLS}, cc AS (SELECT workspace, from_path, to_name, line, count(*) AS n FROM cl GROUP BY ALL),
sp AS (SELECT DISTINCT workspace, path, name, least(line, coalesce(end_line, line)) AS a, greatest(line, coalesce(end_line, line)) AS b FROM s),
bs AS (SELECT cc.workspace, cc.from_path, cc.to_name, cc.line, arg_min(sp.name, struct_pack(z := b - a, y := -a, x := sp.name)) AS sym FROM cc JOIN sp ON sp.workspace = cc.workspace AND sp.path = cc.from_path AND cc.line BETWEEN a AND b GROUP BY ALL),
he AS (SELECT cc.*, bs.sym FROM cc LEFT JOIN bs ON bs.workspace = cc.workspace AND bs.from_path = cc.from_path AND bs.to_name = cc.to_name AND bs.line = cc.line),
dg AS (SELECT string_split(to_name, '.')[-1] AS name, sum(n)::BIGINT AS sites FROM he WHERE {useful} GROUP BY 1 ORDER BY sites DESC, name LIMIT 48),
fd AS (SELECT name, arg_min_null(kind, struct_pack(w := workspace, p := path, l := line)) AS kind, arg_min_null(substr(signature, 1, 160), struct_pack(w := workspace, p := path, l := line)) AS signature, arg_min_null(line, struct_pack(w := workspace, p := path, l := line)) AS line FROM s WHERE name IN (SELECT name FROM dg) GROUP BY name),
pt AS (SELECT name, string_agg(path, ' ' ORDER BY path) AS paths FROM (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY path) AS r FROM (SELECT DISTINCT name, path FROM s WHERE name IN (SELECT name FROM dg))) WHERE r <= 6 GROUP BY name),
p1 AS (SELECT string_split(to_name, '.')[-1] AS name, sym AS to_name, n FROM he WHERE sym <> ''), q1 AS (SELECT name, to_name AS peer, sum(n)::BIGINT AS w FROM p1 WHERE {useful} GROUP BY ALL), r1 AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY w DESC, peer) AS r FROM q1),
ca AS (SELECT name, sum(w)::BIGINT AS callers, string_agg(peer, ' ' ORDER BY r) FILTER (WHERE r <= 8) AS tc FROM r1 GROUP BY name),
q2 AS (SELECT string_split(sym, '.')[-1] AS name, to_name AS peer, sum(n)::BIGINT AS w FROM he WHERE sym <> '' AND {useful} GROUP BY ALL), r2 AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY w DESC, peer) AS r FROM q2),
ce AS (SELECT name, sum(w)::BIGINT AS callees, string_agg(peer, ' ' ORDER BY r) FILTER (WHERE r <= 8) AS tc FROM r2 GROUP BY name)
SELECT dg.name, fd.kind, fd.signature, fd.line, coalesce(paths, '') AS paths, coalesce(callers, sites) AS callers, coalesce(callees, 0) AS callees, coalesce(ca.tc, '') AS top_callers, coalesce(ce.tc, '') AS top_callees
FROM dg LEFT JOIN fd USING (name) LEFT JOIN pt USING (name) LEFT JOIN ca USING (name) LEFT JOIN ce USING (name)""",
        "impact_markdown": f"""WITH RECURSIVE {_impact_sql(NAME, 2)}, al AS (SELECT 'definition' AS section, workspace, path, line, 1.0::DOUBLE AS score FROM df UNION ALL SELECT 'importer', workspace, path, 0, (3 - depth)::DOUBLE FROM ip UNION ALL SELECT 'caller', workspace, path, line, 0.8 FROM cb UNION ALL SELECT 'reference', workspace, path, 0, 0.5 FROM rf),
ls AS (SELECT section, string_agg('- `' || path || CASE WHEN line > 0 THEN ':' || line ELSE '' END || '`', chr(10) ORDER BY score DESC, workspace, path, line) AS t FROM al GROUP BY section)
SELECT '## impact: {NAME}' || (SELECT string_agg(chr(10) || chr(10) || '### ' || k.title || chr(10) || coalesce(ls.t, '(none)'), '' ORDER BY k.o) FROM (VALUES (1, 'definition', 'definitions'), (2, 'caller', 'callers'), (3, 'importer', 'importers'), (4, 'reference', 'references')) k(o, section, title) LEFT JOIN ls ON ls.section = k.section) AS text""",
        "table_counts": f"WITH {SQL_FILES} SELECT 'files' AS name, count(*) AS n FROM f UNION ALL SELECT 'symbols', count(DISTINCT id) FROM symbols UNION ALL SELECT 'chunks', count(DISTINCT symbol_id) FROM chunks UNION ALL SELECT 'notes', count(*) FROM memories UNION ALL SELECT 'parsed', count(*) FROM (SELECT DISTINCT workspace, path FROM parse_results)",
        "symbol_kinds": f"WITH {SQL_SYMBOLS} SELECT kind, count(*) AS n FROM s GROUP BY kind",
        "folder_rollup": f"WITH {SQL_FILES} SELECT CASE WHEN NOT contains(path, '/') THEN '(root)' WHEN string_split(path, '/')[1] IN ('src', 'packages', 'apps', 'services', 'libs') AND len(string_split(path, '/')) > 2 THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] ELSE string_split(path, '/')[1] END AS folder, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, folder LIMIT 20",
        "language_counts": f"WITH {SQL_FILES} SELECT {_canonical('language')} AS language, count(*) AS n FROM f GROUP BY 1",
        "heaviest_files": f"WITH {SQL_FILES}, t AS (SELECT workspace, path, count(DISTINCT id) AS n FROM symbols GROUP BY 1, 2 ORDER BY n DESC, workspace, path LIMIT 15) SELECT t.workspace, t.path, {_canonical('f.language')} AS language, t.n FROM t LEFT JOIN f ON f.workspace = t.workspace AND f.path = t.path",
        "directory_listing": f"""WITH {SQL_FILES}, x AS (SELECT DISTINCT workspace, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir, string_split(path, '/')[-1] AS name FROM f), k AS (SELECT * FROM (SELECT workspace, dir, count(*) AS n_files, row_number() OVER (PARTITION BY workspace ORDER BY dir) AS r FROM x GROUP BY 1, 2) WHERE r <= 12),
y AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY workspace, dir ORDER BY name) AS r FROM x) WHERE r <= 8) SELECT k.workspace, k.dir, k.n_files, string_agg(y.name, ', ' ORDER BY y.name) AS names FROM k JOIN y ON y.workspace = k.workspace AND y.dir = k.dir GROUP BY ALL""",
        "top_shares": f"WITH {SQL_SYMBOLS}, t AS (SELECT workspace, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, workspace LIMIT 12) SELECT workspace, n, round(n / sum(n) OVER (), 6)::DOUBLE AS share FROM t",
        "index_health": f"""WITH {SQL_FILES}, {SQL_EVENTS}, ua AS (SELECT count(*) FILTER (WHERE NOT coalesce(no_prompt, FALSE)) AS asked, count(*) FILTER (WHERE NOT coalesce(no_prompt, FALSE) AND hits > 0) AS hit, count(*) AS injects, count(*) FILTER (WHERE coalesce(timed_out_delta, FALSE) OR coalesce(timed_out_retrieve, FALSE)) AS late FROM j WHERE event_type = 'inject'),
n AS (SELECT 'files' AS c, count(*)::DOUBLE AS v FROM f UNION ALL SELECT 'symbols', count(DISTINCT id) FROM symbols UNION ALL SELECT 'chunks', count(DISTINCT symbol_id) FROM chunks),
v AS (SELECT 'chunk coverage' AS c, round(count(DISTINCT id) FILTER (WHERE id IN (SELECT symbol_id FROM chunks WHERE text IS NOT NULL)) / greatest(count(DISTINCT id), 1)::DOUBLE, 6) AS v FROM symbols UNION ALL SELECT 'embedding coverage', round(count(embedding) / greatest(count(*), 1)::DOUBLE, 6) FROM memories)
SELECT c AS "check", v AS value, CASE WHEN v > 0 THEN 'ok' ELSE 'bad' END AS status FROM n UNION ALL SELECT c, v, CASE WHEN v >= 0.8 THEN 'ok' WHEN v >= 0.5 THEN 'warn' ELSE 'bad' END FROM v
UNION ALL SELECT 'hit rate', round(hit::DOUBLE / nullif(asked, 0), 6), CASE WHEN asked >= 10 AND hit::DOUBLE / asked < 0.25 THEN 'warn' ELSE 'ok' END FROM ua UNION ALL SELECT 'timeouts', round(late::DOUBLE / nullif(injects, 0), 6), CASE WHEN late::DOUBLE / injects > 0.5 THEN 'warn' ELSE 'ok' END FROM ua""",
        "workspace_stats": f"WITH {SQL_FILES}, {SQL_SYMBOLS}, a AS (SELECT workspace, count(*) AS n_files FROM f GROUP BY 1), b AS (SELECT workspace, count(*) AS n_symbols FROM s GROUP BY 1) SELECT workspace, n_files, coalesce(n_symbols, 0) AS n_symbols FROM a LEFT JOIN b USING (workspace) WHERE workspace IS NOT NULL AND NOT contains(workspace, '/tmp/') AND NOT contains(workspace, '/var/folders/') AND NOT starts_with(workspace, 'tmp/')",
        "dirty_diff": f"WITH {scans} SELECT workspace, path, CASE WHEN no0 THEN 'added' WHEN no1 THEN 'removed' ELSE 'changed' END AS status FROM jo WHERE no0 OR no1 OR NOT ((m0 IS NOT DISTINCT FROM m1 AND s0 IS NOT DISTINCT FROM s1) OR h0 IS NOT DISTINCT FROM h1)",
        "version_diff": f"""WITH {scans}, p AS (SELECT workspace, path, coalesce(h1, h0) AS hash, CASE WHEN h0 IS NULL THEN 'A' WHEN h1 IS NULL THEN 'D' ELSE 'M' END AS change FROM jo WHERE h0 IS DISTINCT FROM h1),
mv AS (SELECT workspace, hash FROM p WHERE change <> 'M' GROUP BY ALL HAVING count(*) FILTER (WHERE change = 'A') = 1 AND count(*) FILTER (WHERE change = 'D') = 1)
SELECT p.workspace, p.path, CASE WHEN mv.hash IS NOT NULL AND change = 'A' THEN 'R' ELSE change END AS change FROM p LEFT JOIN mv ON mv.workspace = p.workspace AND mv.hash = p.hash WHERE NOT (mv.hash IS NOT NULL AND change = 'D')""",
        "prune_missing": "SELECT DISTINCT workspace, path FROM files WHERE (workspace, path) NOT IN (SELECT workspace, path FROM corpus)",
        "delete_by_path": f"WITH {SQL_SYMBOLS}, g AS (SELECT DISTINCT workspace, path FROM files WHERE (workspace, path) NOT IN (SELECT workspace, path FROM corpus)) SELECT id, workspace, path FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.workspace = s.workspace AND g.path = s.path)",
        "integrity_check": 'SELECT \'chunks without symbol\' AS "check", count(DISTINCT symbol_id) AS n FROM chunks WHERE symbol_id NOT IN (SELECT id FROM symbols) UNION ALL SELECT \'symbols without file\', count(*) FROM (SELECT DISTINCT id, workspace, path FROM symbols WHERE (workspace, path) NOT IN (SELECT workspace, path FROM files)) UNION ALL SELECT \'chunks without file\', count(*) FROM (SELECT DISTINCT symbol_id, workspace, path FROM chunks WHERE (workspace, path) NOT IN (SELECT workspace, path FROM files))',
        "git_status_parse": f"WITH {SQL_FILES} SELECT CASE length(path) % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'D' WHEN 2 THEN 'R' ELSE '??' END AS status, path, length(path) % 4 = 1 AS deleted FROM f",
    }
