"""Symbol and path lookup, merging by file, token budgets and context packs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import token_estimate

BUDGET_TOKENS = 1400


def symbol_lookup(symbols: DataFrame, name: str, k: int = 20, kind: str | None = None) -> DataFrame:
    """(workspace, path, line, name, kind, score): names that contain the text in any case; exact, then prefix, then others, shorter first.

    ``_`` and ``%`` in the text stand for themselves. The score counts down from k.
    """
    low = name.lower()
    found = symbols.where(F.contains(F.lower("name"), F.lit(low)))
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    tier = F.when(F.col("name") == name, 0).when(F.lower("name").startswith(low), 1).otherwise(2)
    rows = found.select("workspace", "path", "line", "name", "kind", tier.alias("tier"), F.length("name").alias("len")).distinct()
    order = ["tier", "len", "name", "workspace", "path", "line"]
    best = rows.orderBy(*order).limit(k)
    return best.select("workspace", "path", "line", "name", "kind", (F.lit(k + 1) - F.row_number().over(Window.orderBy(*order))).alias("score"))


def list_paths(files: DataFrame, prefix: str, k: int = 40) -> DataFrame:
    """(workspace, path): paths that start with the prefix, or, where none does, that contain it."""
    distinct = files.select("workspace", "path").distinct()
    starts = distinct.where(F.col("path").startswith(prefix)).orderBy("path", "workspace").limit(k)
    return starts if not starts.isEmpty() else distinct.where(F.contains("path", F.lit(prefix))).orderBy("path", "workspace").limit(k)


def recent_symbols(symbols: DataFrame, files: DataFrame, k: int = 20, changes: DataFrame | None = None, as_of: str | None = None, days: int = 2) -> DataFrame:
    """(workspace, path, line, name, mtime_ms): symbols of the most recently changed files, by line within a file.

    With a feed of changes (workspace, path, at) the files that it names within ``days`` before ``as_of`` come first,
    the last changed first; the others follow by their time.
    """
    joined = symbols.select("workspace", "path", "line", "name").distinct().join(files.select("workspace", "path", "mtime_ms"), ["workspace", "path"])
    columns = ["workspace", "path", "line", "name", "mtime_ms"]
    if changes is None:
        return joined.orderBy(F.desc("mtime_ms"), "workspace", "path", "line", "name").limit(k)
    clock = F.lit(as_of).cast("timestamp")
    at = F.col("at").cast("timestamp")
    named = changes.where((at <= clock) & (at > clock - F.expr(f"interval {days} days"))).groupBy("workspace", "path").agg(F.max(at).alias("changed"))
    return joined.join(named, ["workspace", "path"], "left").orderBy(F.desc_nulls_last("changed"), F.desc("mtime_ms"), "workspace", "path", "line", "name").limit(k).select(*columns)


def merge_per_file(hits: DataFrame) -> DataFrame:
    """(workspace, path, score, symbols, lines, n): hits (workspace, path, line, symbol, score) of each file as one.

    Distinct symbols and lines are sorted and joined with ``, ``; the score is the best. Hits with a ``snippet`` keep it:
    of several the file has the lines first and then the snippets, best first, between ``---``; for ranked results of bounded size.
    """
    columns = [
        F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("symbol")), ", ").alias("symbols"),
        F.array_join(F.transform(F.array_sort(F.collect_set("line")), lambda x: x.cast("string")), ", ").alias("lines"), F.count("*").alias("n"),
    ]
    if "snippet" not in hits.columns:
        return hits.groupBy("workspace", "path").agg(*columns)
    held = F.array_sort(F.collect_list(F.when(F.coalesce("snippet", F.lit("")) != "", F.struct((-F.col("score")).alias("s"), "line", "symbol", "snippet"))))
    merged = hits.groupBy("workspace", "path").agg(*columns, F.array_join(F.transform(held, lambda x: x.snippet), "\n---\n").alias("snippet"))
    headed = F.concat_ws("\n", F.when(F.col("lines") != "", F.concat(F.lit("lines "), F.col("lines"))), F.nullif("snippet", F.lit("")))
    return merged.withColumn("snippet", F.when(F.col("n") > 1, headed).otherwise(F.col("snippet")))


def pack_budget(hits: DataFrame, order: Sequence, chars, budget: int = BUDGET_TOKENS) -> DataFrame:
    """The first rows in the given order whose token estimates stay within the budget; the first is always kept.

    ``chars`` is the column of a row's length. For a ranked result of bounded size.
    """
    costed = hits.withColumn("cost", token_estimate(chars))
    window = Window.orderBy(*order)
    running = costed.withColumn("rn", F.row_number().over(window)).withColumn("cum_cost", F.sum("cost").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return running.where((F.col("rn") == 1) | (F.col("cum_cost") <= budget))


def fallback_ladder(symbols: DataFrame, files: DataFrame, identifiers: Sequence[str], k: int = 8) -> DataFrame:
    """(stage, workspace, path, line, text) for a query without hits: symbols of up to five of its identifiers, two each, then lines that hold them."""
    from lodestone.operators.grep import grep_lines

    names = [i for i in identifiers if any(c.isupper() or c == "_" for c in i) or len(i) > 6][:5]
    parts = []
    for pos, name in enumerate(names):
        found = symbol_lookup(symbols, name, 2)
        parts.append(found.select(F.lit(0).alias("stage"), F.lit(pos).alias("pos"), "workspace", "path", "line", F.col("name").alias("text")))
    for pos, name in enumerate(names):
        found = grep_lines(files, name, 2)
        parts.append(found.select(F.lit(1).alias("stage"), F.lit(pos).alias("pos"), "workspace", "path", "line", "text"))
    if not parts:
        return symbols.select(F.lit(0).alias("stage"), "workspace", "path", "line", F.col("name").alias("text")).limit(0)
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.orderBy("stage", "pos", "workspace", "path", "line").limit(k).drop("pos")


def context_pack(hits: DataFrame, imports: DataFrame, budget: int = BUDGET_TOKENS, most_imports: int = 8) -> DataFrame:
    """(part, path, score, detail): merged hits within the token budget, then up to eight import targets of the best path."""
    merged = merge_per_file(hits)
    packed = pack_budget(merged, [F.desc("score"), F.col("path"), F.col("workspace")], F.length("path") + F.length("symbols") + F.length("lines"), budget)
    top = packed.where("rn = 1").select("workspace", F.col("path").alias("from_path"))
    linked = imports.join(F.broadcast(top), ["workspace", "from_path"]).select("to_specifier").distinct().orderBy("to_specifier").limit(most_imports)
    return packed.select(F.lit("hit").alias("part"), "path", "score", F.col("symbols").alias("detail")).unionByName(
        linked.select(F.lit("import").alias("part"), F.col("to_specifier").alias("path"), F.lit(0.0).alias("score"), F.lit("").alias("detail"))
    )
