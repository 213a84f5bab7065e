"""Analytics of the usage journal: token ledger, rollups, percentiles, repeats and claims.

Events are counted once each by event_id; an event delivered twice is the same row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNTAGGED = "(untagged)"
KNOWN_TYPES = ("inject", "mcp", "guardrail", "index", "doctor")


def events_once(journal: DataFrame) -> DataFrame:
    return journal.dropDuplicates(["event_id"])


def _of(kind: str, value: Column | None = None) -> Column:
    return F.when(F.col("event_type") == kind, F.lit(1) if value is None else value)


def _sum(*parts: Column) -> Column:
    total = F.lit(0)
    for p in parts:
        total = total + F.coalesce(F.sum(p), F.lit(0))
    return total


def ledger_columns() -> list[Column]:
    """Aggregates of the token ledger: what was measured as spent against what is estimated as avoided."""
    injected = _sum(_of("inject", F.col("injected_tokens")))
    answered = _sum(_of("mcp", F.col("response_tokens")))
    window = _sum(_of("inject", F.col("window_vs_file_tokens")), _of("mcp", F.col("window_vs_file_tokens")))
    discovery = _sum(_of("inject", F.col("discovery_tokens")), _of("mcp", F.col("discovery_tokens")))
    blocked = _sum(_of("guardrail", F.col("tokens_avoided")))
    spent, avoided = injected + answered, window + discovery + blocked
    return [
        F.count(_of("inject")).alias("injects"), injected.alias("injected_tokens"), answered.alias("response_tokens"), spent.alias("spent"), window.alias("avoided_window"),
        discovery.alias("avoided_discovery"), blocked.alias("avoided_blocked"), avoided.alias("avoided"), (avoided - spent).alias("net"), F.count(_of("mcp")).alias("calls"),
        F.count(F.when((F.col("event_type") == "mcp") & F.col("ok"), 1)).alias("calls_ok"), F.count(_of("guardrail")).alias("walks"), F.count(F.when((F.col("event_type") == "guardrail") & F.col("blocked"), 1)).alias("walks_blocked"),
    ]


def token_ledger(events: DataFrame, *keys: str) -> DataFrame:
    """The ledger over all events, or of each key."""
    return events.groupBy(*keys).agg(*ledger_columns()) if keys else events.agg(*ledger_columns())


def ledger_by_mode(events: DataFrame) -> DataFrame:
    """(mode, injects, injected_tokens): injects by mode; a missing mode counts as on."""
    mode = F.coalesce("mode", F.lit("on"))
    return events.where("event_type = 'inject'").groupBy(mode.alias("mode")).agg(F.count("*").alias("injects"), F.coalesce(F.sum("injected_tokens"), F.lit(0)).alias("injected_tokens"))


def event_summary(events: DataFrame, *keys: str) -> DataFrame:
    """Hit rates, delta percentiles, timeouts and counts; rates are null where nothing counts.

    The hit rate leaves out injects without a prompt, the code hit rate is of code injects. The p50 is the
    upper of two middle values: percentile_disc from above, which keeps counts of distinct values.
    """
    inject = F.col("event_type") == "inject"
    asked = inject & ~F.coalesce("no_prompt", F.lit(False))
    code = inject & (F.col("intent") == "code")
    hit = F.coalesce(F.col("hits") > 0, F.lit(False))
    rate = lambda c: F.round(F.count(F.when(c & hit, 1)) / F.nullif(F.count(F.when(c, 1)), F.lit(0)), 6)
    late = inject & (F.coalesce("timed_out_delta", F.lit(False)) | F.coalesce("timed_out_retrieve", F.lit(False)))
    columns = [
        F.count("*").alias("events"), F.count(F.when(inject, 1)).alias("injects"), F.count(F.when(asked, 1)).alias("asked"), rate(asked).alias("hit_rate"), rate(code).alias("code_hit_rate"),
        F.expr("percentile_disc(0.5) within group (order by case when event_type = 'inject' then delta_ms end desc)").alias("p50_delta_ms"), F.count(F.when(late, 1)).alias("timeouts"),
        F.count(_of("index")).alias("indexes"), F.count(_of("doctor")).alias("doctors"),
    ]
    return events.groupBy(*keys).agg(*columns) if keys else events.agg(*columns)


def summary_scope(events: DataFrame, workspace: str | None = None) -> DataFrame:
    """The injects that a summary of a workspace rests on: its own, where there are none those without a workspace, else all.

    Where that scope has injects without a prompt only, while others have one, all injects. One aggregate row decides.
    """
    injects = events.where("event_type = 'inject'")
    own = F.col("workspace") == workspace if workspace else F.lit(False)
    legacy = F.coalesce("workspace", F.lit("")) == ""
    asked = ~F.coalesce("no_prompt", F.lit(False))
    n = injects.agg(F.count_if(own).alias("own"), F.count_if(legacy).alias("legacy"), F.count_if(own & asked).alias("own_asked"), F.count_if(legacy & asked).alias("legacy_asked"), F.count_if(asked).alias("asked")).head()
    scope, in_scope = (own, n.own_asked) if n.own else (legacy, n.legacy_asked) if n.legacy else (F.lit(True), n.asked)
    return injects if not in_scope and n.asked else injects.where(scope)


def inject_summary(events: DataFrame, workspace: str | None = None) -> DataFrame:
    """(injects, asked, p50_delta, p95_delta, p50_retrieve, p95_retrieve, hits): nearest-rank percentiles of the scoped
    injects and a histogram of the hits of those with a prompt, as ``hits:n`` in order of hits.
    """
    scoped = summary_scope(events, workspace)
    asked = ~F.coalesce("no_prompt", F.lit(False))
    disc = lambda q, c: F.expr(f"percentile_disc({q}) within group (order by {c})")
    counts = scoped.where(asked).groupBy(F.coalesce("hits", F.lit(0)).alias("hits")).agg(F.count("*").alias("n"))  # one row for each number of hits
    text = counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hits", "n"))), lambda x: F.concat(x.hits.cast("string"), F.lit(":"), x.n.cast("string"))), " ").alias("hits"))
    figures = scoped.agg(F.count("*").alias("injects"), F.count_if(asked).alias("asked"), disc(0.5, "delta_ms").alias("p50_delta"), disc(0.95, "delta_ms").alias("p95_delta"), disc(0.5, "retrieve_ms").alias("p50_retrieve"), disc(0.95, "retrieve_ms").alias("p95_retrieve"))
    return figures.join(F.broadcast(text), F.lit(True))  # one row each


def latency_percentiles(events: DataFrame) -> DataFrame:
    """(event_type, n, p50_delta, p95_delta, p50_retrieve, p95_retrieve), nearest rank, of event types that have such times."""
    disc = lambda q, c: F.expr(f"percentile_disc({q}) within group (order by {c})")
    timed = events.where("delta_ms is not null or retrieve_ms is not null")
    return timed.groupBy("event_type").agg(F.count("*").alias("n"), disc(0.5, "delta_ms").alias("p50_delta"), disc(0.95, "delta_ms").alias("p95_delta"), disc(0.5, "retrieve_ms").alias("p50_retrieve"), disc(0.95, "retrieve_ms").alias("p95_retrieve"))


def hits_histogram(events: DataFrame) -> DataFrame:
    """(hits, n) of injects and calls; a missing count is 0."""
    return events.where("event_type in ('inject', 'mcp')").groupBy(F.coalesce("hits", F.lit(0)).alias("hits")).agg(F.count("*").alias("n"))


def workspace_rollup(events: DataFrame) -> DataFrame:
    """(workspace, injects, calls, spent, net) with events without a workspace under (untagged)."""
    return token_ledger(events.withColumn("workspace", F.coalesce(F.nullif("workspace", F.lit("")), F.lit(UNTAGGED))), "workspace").select("workspace", "injects", "calls", "spent", "net")


def event_mix(events: DataFrame) -> DataFrame:
    """(label, n): events by type, the rarer types as other."""
    label = F.when(F.col("event_type").isin(*KNOWN_TYPES), F.col("event_type")).otherwise("other")
    return events.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def dual_scope(events: DataFrame, workspace: str) -> DataFrame:
    """(scope, events, untagged, injects, spent, avoided, net) of one workspace and of everything, in one pass."""
    marked = events.withColumn("scope", F.explode(F.when(F.col("workspace") == workspace, F.array(F.lit("global"), F.lit("project"))).otherwise(F.array(F.lit("global")))))
    return marked.groupBy("scope").agg(F.count("*").alias("events"), F.count(F.when(F.col("workspace").isNull(), 1)).alias("untagged"), *ledger_columns()).select("scope", "events", "untagged", "injects", "spent", "avoided", "net")


def scope_key() -> Column:
    """What a claim or turn belongs to: the session, or the workspace where an event names none."""
    return F.coalesce("session", "workspace")


def session_claims(events: DataFrame) -> DataFrame:
    """(scope, path, event_id): the first time that a path was credited within a session; later ones earn nothing.

    Events with neither session nor workspace, failed calls and events without paths claim nothing. The
    least event_id is a map-side aggregate.
    """
    paths = events.where("event_type = 'mcp' and ok").select(scope_key().alias("scope"), "event_id", F.explode("paths").alias("path")).where("scope is not null and path is not null")
    return paths.groupBy("scope", "path").agg(F.min("event_id").alias("event_id"))


def locate_credit(hits: DataFrame, files: DataFrame, walk_chars: int = 40, cap: int = 8000) -> DataFrame:
    """(scope, event_id, paths, window_tokens, discovery_tokens): what the quality hits of each event are credited with.

    hits (scope, event_id, workspace, path, delivered, quality): only quality hits count, a path once in a session, at
    its first event; its credit is the file's tokens, at most ``cap``, less the delivered ones. The listing of the
    workspace is credited once in a session, at its first event with a quality hit. Unknown files give 0.
    """
    good = hits.where(F.col("quality") & F.col("scope").isNotNull() & (F.trim("path") != "")).select("scope", "event_id", "workspace", F.regexp_replace(F.trim("path"), r"\\\\", "/").alias("path"), "delivered")
    first = good.groupBy("scope", "path").agg(F.min(F.struct("event_id", "workspace", "delivered")).alias("f")).select("scope", "path", "f.*")
    tokens = F.least(F.ceil(F.coalesce("size", F.lit(0)) / 4).cast("bigint"), F.lit(cap)).alias("tokens")
    known = files.select("workspace", "path", tokens)
    credit = F.greatest(F.coalesce("tokens", F.lit(0)) - F.greatest("delivered", F.lit(0)), F.lit(0))
    windows = first.join(known, ["workspace", "path"], "left").groupBy("scope", "event_id").agg(F.count("*").alias("paths"), F.sum(credit).alias("window_tokens"))
    opened = good.groupBy("scope").agg(F.min(F.struct("event_id", "workspace")).alias("f")).select("scope", "f.*")
    listing = files.groupBy("workspace").agg(F.ceil(F.count("*") * walk_chars / 4).cast("bigint").alias("walk"))
    discovery = opened.join(listing, "workspace", "left").select("scope", "event_id", F.coalesce("walk", F.lit(0)).alias("discovery_tokens"))
    both = windows.join(discovery, ["scope", "event_id"], "full")
    return both.select("scope", "event_id", F.coalesce("paths", F.lit(0)).alias("paths"), F.coalesce("window_tokens", F.lit(0)).alias("window_tokens"), F.coalesce("discovery_tokens", F.lit(0)).alias("discovery_tokens"))


def repeat_reads(events: DataFrame, least: int = 2) -> DataFrame:
    """(workspace, path, reads): paths that calls of one workspace touched again and again, at least ``least`` times."""
    paths = events.where("event_type = 'mcp' and workspace is not null").select("workspace", F.explode(F.array_distinct("paths")).alias("path"))
    return paths.groupBy("workspace", "path").agg(F.count("*").alias("reads")).where(F.col("reads") >= least)


def prior_reads(events: DataFrame, within: int = 500, rows_a_range: int = 100_000) -> DataFrame:
    """(scope, event_id, path, prior): how many of the last 500 reads of a session before an event touched the same path.

    A session is its id, or the workspace where an event names none. Reads are numbered by ranges of
    event_id and by offsets of the ranges before, and counted in blocks of numbers that overlap by 500, so
    a session or path with a third of all events is spread over many tasks.
    """
    paths = events.where("event_type = 'mcp'").select(scope_key().alias("scope"), "event_id", F.explode(F.array_distinct("paths")).alias("path")).where("scope is not null and event_id is not null")
    ids = paths.select("scope", "event_id").distinct()
    ends = ids.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"), F.count("*").alias("n")).head()
    width = max(1, ((ends.b or 0) - (ends.a or 0) + 1) * rows_a_range // max(1, ends.n))
    ranged = ids.withColumn("range", F.floor((F.col("event_id") - (ends.a or 0)) / width))
    before = Window.partitionBy("scope").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = ranged.groupBy("scope", "range").agg(F.count("*").alias("c")).withColumn("offset", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    inside = F.row_number().over(Window.partitionBy("scope", "range").orderBy("event_id"))
    numbered = ranged.withColumn("place", inside).join(offsets, ["scope", "range"]).select("scope", "event_id", (F.col("place") + F.col("offset")).alias("seq"))
    block = 20 * within
    own = F.floor(F.col("seq") / block)
    blocks = F.array_distinct(F.array(own, F.floor((F.col("seq") + within) / block)))  # a read also stands before those of the next block
    placed = paths.join(numbered, ["scope", "event_id"]).select("scope", "event_id", "path", "seq", own.alias("own"), F.explode(blocks).alias("block"))
    counted = placed.withColumn("prior", F.count("*").over(Window.partitionBy("scope", "path", "block").orderBy("seq").rangeBetween(-within, -1)))
    return counted.where("own = block").select("scope", "event_id", "path", "prior")


def liveness(events: DataFrame, as_of: str, stale_days: int = 14, kinds: tuple[str, ...] = ("inject", "guardrail", "mcp", "index", "doctor", "file-event", "session-start", "stop", "routing", "heartbeat")) -> DataFrame:
    """(event_type, n, last_at, status): never, stale or fired for each kind that is expected."""
    expected = events.sparkSession.createDataFrame([(k,) for k in kinds], "event_type string")
    seen = events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("at_ts").alias("last_at"))
    old = F.col("last_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {stale_days} days")
    return expected.join(seen, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"), "last_at", F.when(F.col("n").isNull(), "never").when(old, "stale").otherwise("fired").alias("status"))


def advice(summary: DataFrame) -> DataFrame:
    """summary rows with ``advice``: hints that hold for the figures, as one text."""
    hints = F.array_compact(F.array(
        F.when(F.col("events") == 0, "no events"), F.when((F.col("asked") > 0) & (F.col("hit_rate") < 0.25), "reindex"), F.when(F.col("calls") == 0, "tools unused"),
        F.when(F.col("net") < 0, "prefer windows over files"), F.when(F.col("timeouts") > 0, "index live"),
    ))
    return summary.withColumn("advice", F.array_join(hints, "; "))


def guardrail_decision(mode: Column, kind: Column, scoped: Column, discovery: Column) -> Column:
    """allow, log or block: off allows, warn logs, all blocks; auto blocks unscoped walks and shell discovery; reads are never blocked."""
    return (
        F.when((mode == "off") | (kind == "read"), "allow").when(mode == "warn", "log").when(mode == "all", "block")
        .when((kind == "walk") & ~scoped, "block").when((kind == "shell") & discovery, "block").otherwise("allow")
    )


def turn_state(events: DataFrame, most: int = 20) -> DataFrame:
    """(scope, last_event, paths): each session's last 20 distinct paths, newest first, comma-joined."""
    touched = events.select(scope_key().alias("scope"), "event_id", F.explode("paths").alias("path")).where("scope is not null and path is not null")
    latest = touched.groupBy("scope", "path").agg(F.max("event_id").alias("seen"))
    order = Window.partitionBy("scope").orderBy(F.desc("seen"), "path")
    kept = latest.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x.path), ",")
    return kept.groupBy("scope").agg(F.max("seen").alias("last_event"), joined.alias("paths"))
