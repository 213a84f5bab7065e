"""Recall, decay and upkeep of notes. The clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import cosine, dot
from lodestone.operators.search import lsh_pairs

# Fixed values of the recall contract.
HALF_LIFE_DAYS, DECAY_AFTER_DAYS, DECAY_BELOW, SESSION_CAP, DUPLICATE_COSINE = 30.0, 60, 0.02, 50, 0.9
KINDS = ("decision", "preference", "fact", "session")


def note_kind(kind: Column) -> Column:
    """Spellings of a kind brought together; unknown kinds stay as they are, lower-cased."""
    return F.lower(F.trim(kind))


def age_days(at: Column, as_of: str) -> Column:
    """Days from a time to the clock, not below 0; a null time is infinitely old."""
    seconds = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.when(at.isNotNull(), F.greatest(seconds / 86_400_000_000.0, F.lit(0.0))).otherwise(1e9)


def recency(at: Column, as_of: str) -> Column:
    return F.pow(F.lit(0.5), age_days(at, as_of) / HALF_LIFE_DAYS)


def use_weight(use_count: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(use_count, F.lit(0)) / 5.0)


def csv_list(column: Column) -> Column:
    return F.filter(F.split(F.coalesce(column, F.lit("")), ","), lambda x: x != "")


def recall(notes: DataFrame, query: list[float], lexical: DataFrame | None, as_of: str, scope: list[str] | None = None, k: int = 10) -> DataFrame:
    """(id, score): the k notes to recall.

    0.6 times the better of cosine and 60 / (60 + lexical rank), 0.25 times recency, 0.15 times use; times
    1.5 for a note of a file in scope; a note of other files only is dropped below 0.08. lexical
    (id, rank) is optional. Unusable embeddings count as 0.
    """
    wanted = F.array(*[F.lit(float(x)) for x in query])
    cosine = F.when((F.size("embedding") == len(query)) & ~F.exists("embedding", lambda x: F.isnan(x)), dot(F.col("embedding"), wanted))
    base = notes.select("id", F.coalesce(cosine, F.lit(0.0)).alias("cos"), recency(F.coalesce("last_used_at", "created_at"), as_of).alias("rec"), use_weight(F.col("use_count")).alias("use"), csv_list(F.col("paths")).alias("own"))
    if lexical is not None:
        base = base.join(lexical.select("id", (60.0 / (60 + F.col("rank"))).alias("lex")), "id", "left")
    else:
        base = base.withColumn("lex", F.lit(None).cast("double"))
    score = 0.6 * F.greatest("cos", F.coalesce("lex", F.lit(0.0))) + 0.25 * F.col("rec") + 0.15 * F.col("use")
    inside = F.arrays_overlap("own", F.array(*[F.lit(s) for s in scope])) if scope else F.lit(False)
    scored = base.select("id", F.round(F.when(inside, score * 1.5).otherwise(score), 6).alias("score"), (F.lit(bool(scope)) & (F.size("own") > 0) & ~inside).alias("outside"))
    return scored.where((F.col("score") > 0) & (~F.col("outside") | (F.col("score") >= 0.08))).select("id", "score").orderBy(F.desc("score"), "id").limit(k)


def mark_recalled(recalled: DataFrame, notes: DataFrame, as_of: str) -> DataFrame:
    """(id, use_count, last_used_at): the updates that recalling brings; the caller writes them."""
    return notes.join(recalled.select("id"), "id").select("id", (F.coalesce("use_count", F.lit(0)) + 1).alias("use_count"), F.lit(as_of).cast("timestamp").alias("last_used_at"))


def exact_duplicates(notes: DataFrame) -> DataFrame:
    """(kind, text, keep_id, n, uses): notes of one kind and text saved more than once; saving again only counts a use."""
    kept = notes.where("text is not null").withColumn("kind", note_kind(F.col("kind")))
    grouped = kept.groupBy("kind", "text").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"), (F.sum(F.coalesce("use_count", F.lit(0))) + F.count("*") - 1).alias("uses"))
    return grouped.where("n > 1")


def close_notes(notes: DataFrame, queries: DataFrame, dim: int = 256, least: float = DUPLICATE_COSINE) -> DataFrame:
    """(id, near_id, similarity): for every query note the most similar other note of its kind, found by shared LSH buckets, at least 0.9.

    Queries are a stated set against all notes; vectors are fetched for the pairs nearest by sketch only.
    """
    side = lambda d: d.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))).select("id", note_kind(F.col("kind")).alias("kind"), "embedding")
    held, asked = side(notes), side(queries)
    pairs = lsh_pairs(asked, held, "id", "embedding", dim, 2, ["kind"])
    met = pairs.join(asked.toDF("query_id", "qkind", "qv"), "query_id").join(held, "id").where(F.col("kind").eqNullSafe(F.col("qkind")))
    scored = met.select("query_id", "id", F.round(cosine(F.col("qv"), F.col("embedding")), 4).alias("similarity")).where(F.col("similarity") >= least)
    best = scored.groupBy("query_id").agg(F.max_by(F.struct("id", "similarity"), F.struct("similarity", -F.col("id"))).alias("b"))
    return best.select(F.col("query_id").alias("id"), F.col("b.id").alias("near_id"), F.col("b.similarity").alias("similarity"))


def merged_notes(notes: DataFrame, close: DataFrame) -> DataFrame:
    """(id, text, use_count): what saving each note of ``close`` (id, near_id) makes of the note it is near to.

    The longer text stays, the kept note's own where they are as long; every note merged into one counts
    as a use. Notes that a kept note is itself merged into are followed one step only, as saving does.
    """
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    fresh = close.select("id", "near_id").join(notes.select("id", F.col("text").alias("fresh")), "id")
    longest = fresh.groupBy("near_id").agg(F.max_by("fresh", F.struct(size(F.col("fresh")), -F.col("id"))).alias("fresh"), F.count("*").alias("n"))
    kept = notes.select(F.col("id").alias("near_id"), "text", "use_count").join(longest, "near_id")
    text = F.when(size(F.col("fresh")) > size(F.col("text")), F.col("fresh")).otherwise(F.col("text"))
    return kept.select(F.col("near_id").alias("id"), text.alias("text"), (F.coalesce("use_count", F.lit(0)) + F.col("n")).alias("use_count"))


def decayed(notes: DataFrame, as_of: str) -> DataFrame:
    """(id): notes to forget: not of kind session, at least 60 days unused, and of weight below 0.02."""
    used = F.coalesce("last_used_at", "created_at")
    weight = 0.25 * recency(used, as_of) + 0.15 * use_weight(F.col("use_count"))
    return notes.where((note_kind(F.col("kind")) != "session") & (age_days(used, as_of) >= DECAY_AFTER_DAYS) & (weight < DECAY_BELOW)).select("id")


def session_overflow(notes: DataFrame, cap: int = SESSION_CAP) -> DataFrame:
    """(workspace, id): session notes beyond the newest 50 of their workspace; without a time they are the oldest.

    Only the newest 50 of each workspace are ranked, which is counted off before the shuffle; the others are those older than the last of them.
    """
    order = F.struct(F.coalesce(F.col("created_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), F.col("id"))
    held = notes.where(note_kind(F.col("kind")) == "session").select(F.col("workspace").alias("workspace"), "id", order.alias("o"))
    newest = Window.partitionBy("workspace").orderBy(F.desc("o"))
    last = held.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= cap).groupBy("workspace").agg(F.min("o").alias("least"))
    joined = held.alias("h").join(last.alias("l"), F.col("h.workspace").eqNullSafe(F.col("l.workspace"))).where("h.o < l.least")
    return joined.select("h.workspace", "h.id")


def distilled(notes: DataFrame, k: int = 30) -> DataFrame:
    """(id, kind, uses): the notes worth writing down, most used first, newest id first among equals; session notes are not."""
    return notes.where((note_kind(F.col("kind")) != "session") & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("id", note_kind(F.col("kind")).alias("kind"), F.coalesce("use_count", F.lit(0)).alias("uses")).orderBy(F.desc("uses"), F.desc("id")).limit(k)


def stale_notes(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, n_paths, n_stale): notes that recorded file hashes of which one is gone or differs now in the note's workspace.

    A recorded hash may be shorter than the current one and is compared with its beginning. Notes
    without a workspace know no files. ``files`` has one row for each (workspace, path).
    """
    pairs = notes.select("id", "workspace", F.explode(csv_list(F.col("path_hashes"))).alias("pair")).where(F.contains("pair", F.lit(":")))
    recorded = pairs.select("id", "workspace", F.regexp_extract("pair", "^(.*):([^:]*)$", 1).alias("path"), F.regexp_extract("pair", "^(.*):([^:]*)$", 2).alias("was"))
    checked = recorded.join(files.select("workspace", "path", "hash"), ["workspace", "path"], "left")
    fresh = F.coalesce(F.col("hash").startswith(F.col("was")), F.lit(False))
    counted = checked.groupBy("id").agg(F.count("*").alias("n_paths"), F.count_if(~fresh).alias("n_stale"))
    return counted.where("n_stale > 0")


def session_note(paths: Column, symbols: Column, total: Column | None = None) -> Column:
    """The text of an automatic note: ``changed a, b`` or ``edited x, y (+n more)``; null without paths.

    ``total`` is the number of paths where ``paths`` holds the first five only.
    """
    n = F.size(paths) if total is None else total
    shown = F.array_join(F.slice(paths, 1, 5), ", ")
    more = F.when(n > 5, F.concat(F.lit(" (+"), (n - 5).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(F.size(paths) > 0, F.when(F.size(symbols) > 0, F.concat(F.lit("changed "), F.array_join(F.slice(symbols, 1, 6), ", "))).otherwise(F.concat(F.lit("edited "), shown, more)))
