"""Registered queries of the usage journal, notes and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import format as fm
from lodestone.functions import text as T
from lodestone.functions.vectors import hash_embedding_of
from lodestone.operators import journal, notes, search
from lodestone.plans.common import AS_OF, SQL_EVENTS, SQL_FILES, TERMS, WORKSPACE, bm25_sql, events_of, files_of, hash_vector_sql, notes_of
from lodestone.sources.journal import read_lines, to_lines
from lodestone.sources.tables import table

RECALL_QUERY = "decided to keep the ledger cache"


def token_ledger(s: SparkSession, d: str) -> DataFrame:
    return journal.token_ledger(events_of(s, d))


def ledger_by_mode(s: SparkSession, d: str) -> DataFrame:
    return journal.ledger_by_mode(events_of(s, d))


def event_summary(s: SparkSession, d: str) -> DataFrame:
    return journal.event_summary(events_of(s, d).where("workspace is not null"), "workspace")


def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    return journal.latency_percentiles(events_of(s, d))


def inject_summary(s: SparkSession, d: str) -> DataFrame:
    return journal.inject_summary(events_of(s, d), WORKSPACE)


def hits_histogram(s: SparkSession, d: str) -> DataFrame:
    return journal.hits_histogram(events_of(s, d))


def workspace_rollup(s: SparkSession, d: str) -> DataFrame:
    return journal.workspace_rollup(events_of(s, d))


def event_mix(s: SparkSession, d: str) -> DataFrame:
    return journal.event_mix(events_of(s, d))


def dual_scope(s: SparkSession, d: str) -> DataFrame:
    return journal.dual_scope(events_of(s, d), WORKSPACE)


def session_claims(s: SparkSession, d: str) -> DataFrame:
    return journal.session_claims(events_of(s, d))


def locate_credit(s: SparkSession, d: str) -> DataFrame:
    """Credit of every call that named paths; its answer, shared among them, is what was delivered of each."""
    calls = events_of(s, d).where("event_type = 'mcp' and ok")
    each = F.floor(F.coalesce("response_tokens", F.lit(0)) / F.size("paths"))
    hits = calls.where(F.size("paths") > 0).select(journal.scope_key().alias("scope"), "event_id", "workspace", F.explode(F.array_distinct("paths")).alias("path"), each.alias("delivered"), (F.coalesce("response_tokens", F.lit(0)) >= 6).alias("quality"))
    return journal.locate_credit(hits, files_of(s, d))


def notes_text(s: SparkSession, d: str) -> DataFrame:
    """The distilled notes as Markdown."""
    kept = notes.distilled(notes_of(s, d)).join(notes_of(s, d).select("id", "text", "tags", "paths"), "id")
    return fm.notes_as_text(kept.withColumn("rank", F.struct((-F.col("uses")).alias("u"), (-F.col("id")).alias("i"))), "## notes")


def repeat_reads(s: SparkSession, d: str) -> DataFrame:
    return journal.repeat_reads(events_of(s, d))


def prior_reads(s: SparkSession, d: str) -> DataFrame:
    return journal.prior_reads(events_of(s, d))


def liveness(s: SparkSession, d: str) -> DataFrame:
    return journal.liveness(events_of(s, d), AS_OF)


def usage_advice(s: SparkSession, d: str) -> DataFrame:
    events = events_of(s, d).where("workspace is not null")
    both = journal.event_summary(events, "workspace").join(journal.token_ledger(events, "workspace").select("workspace", "calls", "net"), "workspace")
    return journal.advice(both).select("workspace", "advice")


def health_classes(s: SparkSession, d: str) -> DataFrame:
    events = events_of(s, d).where("workspace is not null")
    both = journal.event_summary(events, "workspace").join(journal.token_ledger(events, "workspace").select("workspace", "net"), "workspace")
    return both.select("workspace", T.health_class("hit_rate", F.col("hit_rate")).alias("hit_rate"), T.health_class("net", F.col("net")).alias("net"), T.health_class("timeouts", F.col("timeouts")).alias("timeouts"))


def guardrail(s: SparkSession, d: str) -> DataFrame:
    """What each mode would decide for every guarded event, a tool's name standing for its kind."""
    kind = F.when(F.col("tool") == "find", "walk").when(F.col("tool") == "impact", "shell").otherwise("read")
    modes = events_of(s, d).where("event_type = 'guardrail'").select(kind.alias("kind"), F.explode(F.array(*[F.lit(m) for m in ("off", "warn", "auto", "all")])).alias("mode"), (F.col("event_id") % 2 == 0).alias("scoped"), (F.col("event_id") % 3 == 0).alias("discovery"))
    decided = modes.withColumn("decision", journal.guardrail_decision(F.col("mode"), F.col("kind"), F.col("scoped"), F.col("discovery")))
    return decided.groupBy("mode", "kind", "decision").agg(F.count("*").alias("n"))


def scoped_walks(s: SparkSession, d: str) -> DataFrame:
    folder = F.regexp_replace("path", "[^/]*$", "")
    asked = F.array(folder, F.concat(folder, F.lit("**")), F.concat(F.lit("./"), folder), F.lit("."))
    walks = files_of(s, d).select("workspace", "path", F.posexplode(asked).alias("depth", "walk"))
    return walks.select("workspace", "path", "walk", "depth", T.is_scoped_walk(F.col("walk"), F.col("depth")).alias("scoped"))


def shell_discovery(s: SparkSession, d: str) -> DataFrame:
    """Commands built around every file's path, with whether each searches the tree."""
    p, folder = F.col("path"), F.regexp_replace("path", "/[^/]*$", "")
    commands = F.array(F.concat(F.lit("grep -rn token "), folder), F.concat(F.lit("grep token "), p), F.concat(F.lit("rg token "), folder), F.concat(F.lit("rg token "), p), F.concat(F.lit("cat "), p, F.lit(" | rg token")), F.concat(F.lit("find "), folder, F.lit(" -name '*.ts'")), F.concat(F.lit("ls "), folder, F.lit(" | grep ts")), F.concat(F.lit("git grep token")))
    asked = files_of(s, d).select("path", F.posexplode(commands).alias("shape", "command"))
    return asked.select("path", "shape", T.is_shell_discovery(F.col("command")).alias("discovery"))


def turn_state(s: SparkSession, d: str) -> DataFrame:
    return journal.turn_state(events_of(s, d))


def journal_lines(s: SparkSession, d: str) -> DataFrame:
    """The journal written as JSON lines and read again: events and tokens by type."""
    back = read_lines(to_lines(events_of(s, d)))
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.size(F.coalesce("paths", F.array().cast("array<string>")))).alias("n_paths"), F.sum("response_tokens").alias("response_tokens"))


def token_estimates(s: SparkSession, d: str) -> DataFrame:
    """What each file costs to read whole, capped, and what a window of 3,500 characters saves."""
    cost = F.least(T.token_estimate(F.coalesce("size", F.lit(0))), F.lit(8000))
    return files_of(s, d).select("workspace", "path", cost.alias("file_tokens"), F.greatest(cost - 875, F.lit(0)).alias("saved"))


def recall_score(s: SparkSession, d: str) -> DataFrame:
    lexical = search.ranked(search.bm25(notes_of(s, d), "id", "text", TERMS), "id", 20)
    return notes.recall(notes_of(s, d), hash_embedding_of(RECALL_QUERY).tolist(), lexical, AS_OF, ["libs/lazy-budget/lib/collectManifest.js"], 10)


def recall_updates(s: SparkSession, d: str) -> DataFrame:
    return notes.mark_recalled(recall_score(s, d), notes_of(s, d), AS_OF).select("id", "use_count")


def exact_duplicates(s: SparkSession, d: str) -> DataFrame:
    return notes.exact_duplicates(notes_of(s, d))


def near_duplicates(s: SparkSession, d: str) -> DataFrame:
    return notes.close_notes(notes_of(s, d), notes_of(s, d).where("id % 50 = 0"))


def decay_prune(s: SparkSession, d: str) -> DataFrame:
    return notes.decayed(notes_of(s, d), AS_OF)


def session_cap(s: SparkSession, d: str) -> DataFrame:
    return notes.session_overflow(notes_of(s, d), 5)


def distilled(s: SparkSession, d: str) -> DataFrame:
    return notes.distilled(notes_of(s, d))


def stale(s: SparkSession, d: str) -> DataFrame:
    return notes.stale_notes(notes_of(s, d), files_of(s, d))


def session_notes(s: SparkSession, d: str) -> DataFrame:
    """Automatic notes of what each session touched; of a session's paths only the first five are gathered."""
    touched = events_of(s, d).select(journal.scope_key().alias("scope"), F.explode("paths").alias("path")).where("scope is not null and path is not null").distinct()
    first = Window.partitionBy("scope").orderBy("path")
    shown = touched.withColumn("r", F.row_number().over(first)).where("r <= 5").groupBy("scope").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    counted = touched.groupBy("scope").agg(F.count("*").alias("n"))
    return shown.join(counted, "scope").select("scope", notes.session_note(F.col("paths"), F.array().cast("array<string>"), F.col("n")).alias("text"))


def hourly_events(s: SparkSession, d: str) -> DataFrame:
    """Extension: events and their value in hourly windows."""
    return table(s, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def event_sessions(s: SparkSession, d: str) -> DataFrame:
    """Extension: sessions of each user, ended by 30 idle minutes."""
    events = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def props_hits(s: SparkSession, d: str) -> DataFrame:
    """Fields of JSON payloads: the ``k`` of every event's props by type."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(s, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


def queries() -> dict:
    return {
        "token_ledger": token_ledger, "ledger_by_mode": ledger_by_mode, "event_summary": event_summary, "latency_percentiles": latency_percentiles, "hits_histogram": hits_histogram, "inject_summary": inject_summary, "workspace_rollup": workspace_rollup,
        "event_mix": event_mix, "dual_scope": dual_scope, "session_claims": session_claims, "locate_credit": locate_credit, "notes_markdown": notes_text, "repeat_reads": repeat_reads, "prior_reads": prior_reads, "hook_liveness": liveness, "usage_advice": usage_advice, "health_classes": health_classes,
        "guardrail_decision": guardrail, "scoped_walk": scoped_walks, "shell_discovery": shell_discovery, "turn_state": turn_state, "journal_lines": journal_lines, "token_estimates": token_estimates, "recall_score": recall_score,
        "recall_updates": recall_updates, "exact_duplicate_notes": exact_duplicates, "near_duplicate_notes": near_duplicates, "decay_prune": decay_prune, "session_cap": session_cap, "distill_notes": distilled, "stale_notes": stale,
        "session_notes": session_notes, "hourly_events": hourly_events, "event_sessions": event_sessions, "props_hits": props_hits,
    }


_LEDGER = """count(*) FILTER (WHERE event_type = 'inject') AS injects, coalesce(sum(injected_tokens) FILTER (WHERE event_type = 'inject'), 0)::BIGINT AS injected_tokens, coalesce(sum(response_tokens) FILTER (WHERE event_type = 'mcp'), 0)::BIGINT AS response_tokens,
coalesce(sum(window_vs_file_tokens) FILTER (WHERE event_type IN ('inject', 'mcp')), 0)::BIGINT AS avoided_window, coalesce(sum(discovery_tokens) FILTER (WHERE event_type IN ('inject', 'mcp')), 0)::BIGINT AS avoided_discovery,
coalesce(sum(tokens_avoided) FILTER (WHERE event_type = 'guardrail'), 0)::BIGINT AS avoided_blocked, count(*) FILTER (WHERE event_type = 'mcp') AS calls, count(*) FILTER (WHERE event_type = 'mcp' AND ok) AS calls_ok,
count(*) FILTER (WHERE event_type = 'guardrail') AS walks, count(*) FILTER (WHERE event_type = 'guardrail' AND blocked) AS walks_blocked"""
_DERIVED = "injected_tokens + response_tokens AS spent, avoided_window + avoided_discovery + avoided_blocked AS avoided, avoided_window + avoided_discovery + avoided_blocked - injected_tokens - response_tokens AS net"
_SUMMARY = """count(*) AS events, count(*) FILTER (WHERE event_type = 'inject') AS injects, count(*) FILTER (WHERE event_type = 'inject' AND NOT coalesce(no_prompt, FALSE)) AS asked,
round(count(*) FILTER (WHERE event_type = 'inject' AND NOT coalesce(no_prompt, FALSE) AND hits > 0)::DOUBLE / nullif(count(*) FILTER (WHERE event_type = 'inject' AND NOT coalesce(no_prompt, FALSE)), 0), 6) AS hit_rate,
round(count(*) FILTER (WHERE event_type = 'inject' AND intent = 'code' AND hits > 0)::DOUBLE / nullif(count(*) FILTER (WHERE event_type = 'inject' AND intent = 'code'), 0), 6) AS code_hit_rate,
list_sort(list(delta_ms) FILTER (WHERE event_type = 'inject' AND delta_ms IS NOT NULL))[count(delta_ms) FILTER (WHERE event_type = 'inject') // 2 + 1] AS p50_delta_ms, count(*) FILTER (WHERE event_type = 'inject' AND (coalesce(timed_out_delta, FALSE) OR coalesce(timed_out_retrieve, FALSE))) AS timeouts,
count(*) FILTER (WHERE event_type = 'index') AS indexes, count(*) FILTER (WHERE event_type = 'doctor') AS doctors"""
_AGE = f"CASE WHEN {{0}} IS NULL THEN 1e9 ELSE greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({{0}}), 0) / 86400000000.0 END"
_USED = "coalesce(last_used_at, created_at)"


def _recall_sql() -> str:
    return f"""{hash_vector_sql(RECALL_QUERY, 'qv')}, {bm25_sql('memories', 'id', 'text', TERMS)}, lx AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round(score, 6) AS score FROM bm) ORDER BY score DESC, id LIMIT 20),
b AS (SELECT m.id, coalesce(CASE WHEN len(embedding) = 256 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 THEN list_inner_product(embedding::DOUBLE[], (SELECT v FROM qv)) END, 0) AS cos, pow(0.5, coalesce({_AGE.format(_USED)}, 1e9) / 30.0) AS rec, least(1.0, coalesce(use_count, 0) / 5.0) AS us,
 list_filter(string_split(coalesce(paths, ''), ','), lambda x: x <> '') AS own, coalesce(60.0 / (60 + rank), 0) AS lex FROM memories m LEFT JOIN lx USING (id)),
sc AS (SELECT id, list_contains(own, 'libs/lazy-budget/lib/collectManifest.js') AS inside, len(own) > 0 AS declared, 0.6 * greatest(cos, lex) + 0.25 * rec + 0.15 * us AS raw FROM b),
rc AS (SELECT id, round(CASE WHEN inside THEN raw * 1.5 ELSE raw END, 6) AS score FROM sc WHERE round(raw, 6) > 0 AND (inside OR NOT declared OR round(raw, 6) >= 0.08) ORDER BY score DESC, id LIMIT 10)"""


def oracle_sql() -> dict[str, str]:
    j = f"WITH {SQL_EVENTS}"
    known = str(tuple(journal.KNOWN_TYPES))
    kinds = ("inject", "guardrail", "mcp", "index", "doctor", "file-event", "session-start", "stop", "routing", "heartbeat")
    ws = f"{j}, w AS (SELECT * FROM j WHERE workspace IS NOT NULL), a AS (SELECT workspace, {_SUMMARY} FROM w GROUP BY workspace), b0 AS (SELECT workspace, {_LEDGER} FROM w GROUP BY workspace), b AS (SELECT *, {_DERIVED} FROM b0)"
    return {
        "token_ledger": f"{j}, x AS (SELECT {_LEDGER} FROM j) SELECT *, {_DERIVED} FROM x",
        "ledger_by_mode": f"{j} SELECT coalesce(mode, 'on') AS mode, count(*) AS injects, coalesce(sum(injected_tokens), 0)::BIGINT AS injected_tokens FROM j WHERE event_type = 'inject' GROUP BY 1",
        "event_summary": f"{j} SELECT workspace, {_SUMMARY} FROM j WHERE workspace IS NOT NULL GROUP BY workspace",
        "latency_percentiles": f"{j} SELECT event_type, count(*) AS n, quantile_disc(delta_ms, 0.5) AS p50_delta, quantile_disc(delta_ms, 0.95) AS p95_delta, quantile_disc(retrieve_ms, 0.5) AS p50_retrieve, quantile_disc(retrieve_ms, 0.95) AS p95_retrieve FROM j WHERE delta_ms IS NOT NULL OR retrieve_ms IS NOT NULL GROUP BY 1",
        "inject_summary": f"""{j}, i AS (SELECT *, NOT coalesce(no_prompt, FALSE) AS asked FROM j WHERE event_type = 'inject' AND workspace = '{WORKSPACE}'), h AS (SELECT coalesce(hits, 0) AS hits, count(*) AS n FROM i WHERE asked GROUP BY 1)
SELECT count(*) AS injects, count(*) FILTER (WHERE asked) AS asked, quantile_disc(delta_ms, 0.5) AS p50_delta, quantile_disc(delta_ms, 0.95) AS p95_delta, quantile_disc(retrieve_ms, 0.5) AS p50_retrieve, quantile_disc(retrieve_ms, 0.95) AS p95_retrieve, (SELECT coalesce(string_agg(hits || ':' || n, ' ' ORDER BY hits), '') FROM h) AS hits FROM i""",
        "hits_histogram": f"{j} SELECT coalesce(hits, 0) AS hits, count(*) AS n FROM j WHERE event_type IN ('inject', 'mcp') GROUP BY 1",
        "workspace_rollup": f"{j}, x AS (SELECT coalesce(nullif(workspace, ''), '(untagged)') AS workspace, {_LEDGER} FROM j GROUP BY 1) SELECT workspace, injects, calls, injected_tokens + response_tokens AS spent, avoided_window + avoided_discovery + avoided_blocked - injected_tokens - response_tokens AS net FROM x",
        "event_mix": f"{j} SELECT CASE WHEN event_type IN {known} THEN event_type ELSE 'other' END AS label, count(*) AS n FROM j GROUP BY 1",
        "dual_scope": f"{j}, m AS (SELECT 'global' AS scope, * FROM j UNION ALL SELECT 'project', * FROM j WHERE workspace = '{WORKSPACE}'), x AS (SELECT scope, count(*) AS events, count(*) FILTER (WHERE workspace IS NULL) AS untagged, {_LEDGER} FROM m GROUP BY scope), y AS (SELECT *, {_DERIVED} FROM x) SELECT scope, events, untagged, injects, spent, avoided, net FROM y",
        "session_claims": f"{j}, p AS (SELECT coalesce(session, workspace) AS scope, event_id, unnest(paths) AS path FROM j WHERE event_type = 'mcp' AND ok) SELECT scope, path, min(event_id) AS event_id FROM p WHERE scope IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2",
        "locate_credit": f"""{j}, {SQL_FILES}, h AS (SELECT DISTINCT coalesce(session, workspace) AS scope, event_id, workspace, unnest(paths) AS path, coalesce(response_tokens, 0) // len(paths) AS delivered FROM j WHERE event_type = 'mcp' AND ok AND len(paths) > 0 AND coalesce(response_tokens, 0) >= 6),
g AS (SELECT scope, event_id, workspace, trim(path) AS path, delivered FROM h WHERE scope IS NOT NULL AND trim(path) <> ''), fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, path ORDER BY event_id, workspace, delivered) AS r FROM g) WHERE r = 1),
w AS (SELECT fi.scope, fi.event_id, count(*) AS paths, sum(greatest(coalesce(least(ceil(coalesce(f.size, 0) / 4.0)::BIGINT, 8000) * (f.path IS NOT NULL)::INT, 0) - greatest(delivered, 0), 0))::BIGINT AS window_tokens FROM fi LEFT JOIN f ON f.workspace = fi.workspace AND f.path = fi.path GROUP BY ALL),
op AS (SELECT scope, event_id, workspace FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY event_id, workspace) AS r FROM g) WHERE r = 1), wl AS (SELECT workspace, ceil(count(*) * 40 / 4.0)::BIGINT AS walk FROM f GROUP BY workspace),
di AS (SELECT scope, event_id, coalesce(walk, 0) AS walk FROM op LEFT JOIN wl USING (workspace))
SELECT coalesce(w.scope, di.scope) AS scope, coalesce(w.event_id, di.event_id) AS event_id, coalesce(paths, 0) AS paths, coalesce(window_tokens, 0) AS window_tokens, coalesce(walk, 0) AS discovery_tokens FROM w FULL JOIN di ON w.scope = di.scope AND w.event_id = di.event_id""",
        "notes_markdown": """WITH k AS (SELECT id, lower(trim(kind)) AS kind, coalesce(use_count, 0) AS uses, text, tags, paths FROM memories WHERE lower(trim(kind)) <> 'session' AND trim(coalesce(text, '')) <> '' ORDER BY uses DESC, id DESC LIMIT 30)
SELECT '## notes' || chr(10) || chr(10) || coalesce(string_agg('- (#' || id || ' ' || coalesce(kind, '') || CASE WHEN coalesce(tags, '') <> '' THEN ' [' || replace(tags, ',', ', ') || ']' ELSE '' END || ') ' || text || CASE WHEN coalesce(paths, '') <> '' THEN ' — `' || replace(paths, ',', '`, `') || '`' ELSE '' END, chr(10) ORDER BY uses DESC, id DESC), '(no notes yet)') AS text FROM k""",
        "repeat_reads": f"{j}, p AS (SELECT DISTINCT workspace, event_id, unnest(paths) AS path FROM j WHERE event_type = 'mcp' AND workspace IS NOT NULL) SELECT workspace, path, count(*) AS reads FROM p GROUP BY 1, 2 HAVING count(*) >= 2",
        "prior_reads": f"{j}, p AS (SELECT DISTINCT coalesce(session, workspace) AS scope, event_id, unnest(paths) AS path FROM j WHERE event_type = 'mcp'), q AS (SELECT *, dense_rank() OVER (PARTITION BY scope ORDER BY event_id) AS seq FROM p WHERE scope IS NOT NULL) SELECT scope, event_id, path, count(*) OVER (PARTITION BY scope, path ORDER BY seq RANGE BETWEEN 500 PRECEDING AND 1 PRECEDING) AS prior FROM q",
        "hook_liveness": f"{j}, e AS (SELECT unnest({list(kinds)}) AS event_type), g AS (SELECT event_type, count(*) AS n, max(at_ts) AS last_at FROM j GROUP BY 1) SELECT e.event_type, coalesce(n, 0) AS n, last_at, CASE WHEN n IS NULL THEN 'never' WHEN last_at < TIMESTAMP '{AS_OF}' - INTERVAL 14 DAYS THEN 'stale' ELSE 'fired' END AS status FROM e LEFT JOIN g USING (event_type)",
        "usage_advice": f"{ws} SELECT workspace, array_to_string(list_filter([CASE WHEN events = 0 THEN 'no events' END, CASE WHEN asked > 0 AND hit_rate < 0.25 THEN 'reindex' END, CASE WHEN calls = 0 THEN 'tools unused' END, CASE WHEN net < 0 THEN 'prefer windows over files' END, CASE WHEN timeouts > 0 THEN 'index live' END], lambda x: x IS NOT NULL), '; ') AS advice FROM a JOIN b USING (workspace)",
        "health_classes": f"{ws} SELECT workspace, CASE WHEN hit_rate IS NULL THEN NULL WHEN hit_rate >= 0.5 THEN 'ok' WHEN hit_rate >= 0.25 THEN 'warn' ELSE 'bad' END AS hit_rate, CASE WHEN net > 0 THEN 'ok' WHEN net = 0 THEN 'warn' ELSE 'bad' END AS net, CASE WHEN timeouts = 0 THEN 'ok' WHEN timeouts <= 3 THEN 'warn' ELSE 'bad' END AS timeouts FROM a JOIN b USING (workspace)",
        "guardrail_decision": f"""{j}, g AS (SELECT CASE tool WHEN 'find' THEN 'walk' WHEN 'impact' THEN 'shell' ELSE 'read' END AS kind, unnest(['off', 'warn', 'auto', 'all']) AS mode, event_id % 2 = 0 AS scoped, event_id % 3 = 0 AS discovery FROM j WHERE event_type = 'guardrail')
SELECT mode, kind, CASE WHEN mode = 'off' OR kind = 'read' THEN 'allow' WHEN mode = 'warn' THEN 'log' WHEN mode = 'all' THEN 'block' WHEN kind = 'walk' AND NOT scoped THEN 'block' WHEN kind = 'shell' AND discovery THEN 'block' ELSE 'allow' END AS decision, count(*) AS n FROM g GROUP BY ALL""",
        "scoped_walk": f"WITH {SQL_FILES}, x AS (SELECT workspace, path, regexp_replace(path, '[^/]*$', '') AS d FROM f), y AS (SELECT workspace, path, unnest([d, d || '**', './' || d, '.']) AS walk, unnest([0, 1, 2, 3]) AS depth FROM x), z AS (SELECT *, regexp_replace(regexp_replace(walk, '^\\./', ''), '/+$', '') AS c FROM y) SELECT workspace, path, walk, depth, CASE WHEN c IN ('', '.', '*') OR contains(c, '**') THEN FALSE WHEN c = '.git' OR starts_with(c, '.git/') THEN TRUE ELSE depth <= 1 END AS scoped FROM z",
        "shell_discovery": f"WITH {SQL_FILES} SELECT path, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS shape, unnest([TRUE, FALSE, TRUE, FALSE, FALSE, TRUE, TRUE, TRUE]) AS discovery FROM f",
        "turn_state": f"""{j}, p AS (SELECT coalesce(session, workspace) AS scope, event_id, unnest(paths) AS path FROM j), l AS (SELECT scope, path, max(event_id) AS seen FROM p WHERE scope IS NOT NULL AND path IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seen DESC, path) AS r FROM l) SELECT scope, max(seen) AS last_event, string_agg(path, ',' ORDER BY r) AS paths FROM r WHERE r <= 20 GROUP BY scope""",
        "journal_lines": f"{j} SELECT event_type, count(*) AS n, sum(coalesce(len(paths), 0))::BIGINT AS n_paths, sum(response_tokens)::BIGINT AS response_tokens FROM j GROUP BY 1",
        "token_estimates": f"WITH {SQL_FILES}, x AS (SELECT workspace, path, least(ceil(coalesce(size, 0) / 4.0)::BIGINT, 8000) AS t FROM f) SELECT workspace, path, t AS file_tokens, greatest(t - 875, 0) AS saved FROM x",
        "recall_score": f"WITH {_recall_sql()} SELECT id, score::DOUBLE AS score FROM rc",
        "recall_updates": f"WITH {_recall_sql()} SELECT id, coalesce(use_count, 0) + 1 AS use_count FROM rc JOIN memories USING (id)",
        "exact_duplicate_notes": "SELECT lower(trim(kind)) AS kind, text, min(id) AS keep_id, count(*) AS n, (sum(coalesce(use_count, 0)) + count(*) - 1)::BIGINT AS uses FROM memories WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
        "near_duplicate_notes": """WITH m AS (SELECT id, lower(trim(kind)) AS kind, embedding::DOUBLE[] AS e FROM memories WHERE len(embedding) = 256 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
p AS (SELECT q.id, m.id AS near_id, round(list_inner_product(q.e, m.e) / nullif(sqrt(list_inner_product(q.e, q.e) * list_inner_product(m.e, m.e)), 0), 4) AS similarity FROM m q JOIN m ON q.id <> m.id AND q.kind IS NOT DISTINCT FROM m.kind WHERE q.id % 50 = 0)
SELECT id, near_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, near_id) AS r FROM p WHERE similarity >= 0.9) WHERE r = 1""",
        "decay_prune": f"SELECT id FROM (SELECT id, kind, use_count, coalesce({_AGE.format(_USED)}, 1e9) AS age FROM memories) WHERE lower(trim(kind)) <> 'session' AND age >= 60 AND 0.25 * pow(0.5, age / 30.0) + 0.15 * least(1.0, coalesce(use_count, 0) / 5.0) < 0.02",
        "session_cap": "SELECT workspace, id FROM (SELECT workspace, id, row_number() OVER (PARTITION BY workspace ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM memories WHERE lower(trim(kind)) = 'session') WHERE r > 5",
        "distill_notes": "SELECT id, lower(trim(kind)) AS kind, coalesce(use_count, 0) AS uses FROM memories WHERE lower(trim(kind)) <> 'session' AND trim(coalesce(text, '')) <> '' ORDER BY uses DESC, id DESC LIMIT 30",
        "stale_notes": f"""WITH {SQL_FILES}, p AS (SELECT id, workspace, unnest(string_split(path_hashes, ',')) AS pair FROM memories WHERE path_hashes IS NOT NULL), q AS (SELECT id, workspace, regexp_extract(pair, '^(.*):([^:]*)$', 1) AS path, regexp_extract(pair, '^(.*):([^:]*)$', 2) AS was FROM p WHERE contains(pair, ':')),
x AS (SELECT id, EXISTS (SELECT 1 FROM f WHERE f.workspace = q.workspace AND f.path = q.path AND starts_with(f.hash, q.was)) AS fresh FROM q) SELECT id, count(*) AS n_paths, count(*) FILTER (WHERE NOT fresh) AS n_stale FROM x GROUP BY id HAVING count(*) FILTER (WHERE NOT fresh) > 0""",
        "session_notes": f"""{j}, t AS (SELECT DISTINCT coalesce(session, workspace) AS scope, unnest(paths) AS path FROM j), g AS (SELECT scope, list_sort(list(path)) AS p FROM t WHERE path IS NOT NULL AND scope IS NOT NULL GROUP BY scope)
SELECT scope, 'edited ' || array_to_string(p[1:5], ', ') || CASE WHEN len(p) > 5 THEN ' (+' || (len(p) - 5) || ' more)' ELSE '' END AS text FROM g""",
        "hourly_events": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
        "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1",
        "props_hits": "SELECT event_type, (props ->> '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2",
    }
