"""Columns for people to read: numbers, percentages, places, hits as text, and fields of loose payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.search import terms


def short_number(n: Column) -> Column:
    """Numbers from a thousand on with one decimal and k or M; ``--`` for null."""
    size = F.abs(n)
    return (
        F.when(n.isNull(), "--").when(size >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000.0), F.lit("M")))
        .when(size >= 1_000, F.concat(F.format_string("%.1f", n / 1_000.0), F.lit("k"))).otherwise(n.cast("string"))
    )


def percent(share: Column) -> Column:
    """A share as whole per cent; ``--`` for null."""
    return F.when(share.isNull(), "--").otherwise(F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("%")))


def place(path: Column, first: Column, last: Column) -> Column:
    """path, path:line or path:first-last."""
    return F.when(first.isNull(), path).when(last.isNull() | (last == first), F.concat(path, F.lit(":"), first.cast("string"))).otherwise(F.concat(path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string")))


def first_field(payload: Column, *paths: str) -> Column:
    """The first non-blank text among fields of a JSON payload, tried in order; null for none and for what is no JSON."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(payload, p)), F.lit("")) for p in paths])


def redact_paths(message: Column, most: int = 500) -> Column:
    """A message with absolute paths replaced, at most 500 characters."""
    return F.substring(F.regexp_replace(message, r"(?<![\w.:/])(?:[A-Za-z]:\\|/)(?:[^\s:'\"()]+[/\\])+[^\s:'\"()]*", "<path>"), 1, most)


def snippet(text: Column, phrases: list[tuple[str, bool]], size: int = 24) -> Column:
    """``size`` terms around the first one that a phrase matches, with ``...`` where the text goes on; the beginning where none matches."""
    words = terms(text)
    hit = F.lit(False)

    def matches(x: Column) -> Column:
        found = hit
        for p, prefix in phrases:
            found = found | (x.startswith(p) if prefix else x == p)
        return found

    place_of = F.array_position(F.transform(words, lambda x: matches(x).cast("int")), F.lit(1)).cast("int")
    start = F.greatest(place_of - size // 2, F.lit(1))
    shown = F.array_join(F.slice(words, start, size), " ")
    return F.concat(F.when(start > 1, "... ").otherwise(""), shown, F.when(start + size - 1 < F.size(words), " ...").otherwise(""))


def hits_as_text(hits: DataFrame, group: str | None = None) -> DataFrame:
    """(group, text): hits (path, first, last, symbol, score, snippet, rank) as lines of Markdown in rank order; one row without a group.

    For ranked results of bounded size.
    """
    line = F.concat(F.lit("- "), F.when(F.coalesce("symbol", F.lit("")) != "", F.concat(F.lit("**"), "symbol", F.lit("** "))).otherwise(""), place(F.col("path"), F.col("first"), F.col("last")), F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("\n  "), F.regexp_replace("snippet", "\n", "\n  "))).otherwise(""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x.l), "\n").alias("text")
    return hits.groupBy(group).agg(text) if group else hits.agg(text)


def _as_list(df: DataFrame, order: Column, line: Column, group: str | None, title: str, none: str) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x.l), "\n")
    text = F.concat(F.lit(f"{title}\n\n"), F.when(body == "", none).otherwise(body)).alias("text")
    return df.groupBy(group).agg(text) if group else df.agg(text)


def notes_as_text(notes: DataFrame, title: str, group: str | None = None) -> DataFrame:
    """(group, text): notes (id, kind, text, tags, paths, rank) as a titled Markdown list in rank order; tags and paths are comma lists.

    For results of bounded size; one row, which says so where there are none, without a group.
    """
    tags = F.when(F.coalesce("tags", F.lit("")) != "", F.concat(F.lit(" ["), F.regexp_replace("tags", ",", ", "), F.lit("]"))).otherwise("")
    paths = F.when(F.coalesce("paths", F.lit("")) != "", F.concat(F.lit(" — `"), F.regexp_replace("paths", ",", "`, `"), F.lit("`"))).otherwise("")
    line = F.concat(F.lit("- (#"), F.col("id").cast("string"), F.lit(" "), F.coalesce("kind", F.lit("")), tags, F.lit(") "), F.coalesce("text", F.lit("")), paths)
    return _as_list(notes, F.col("rank"), line, group, title, "(no notes yet)")


def impact_as_text(impact: DataFrame, name: str) -> DataFrame:
    """(text): sections of an impact result (section, workspace, path, line, score) as Markdown, each sorted by score and place, ``(none)`` where empty."""
    line = F.concat(F.lit("- `"), place(F.col("path"), F.nullif("line", F.lit(0)), F.lit(None).cast("int")), F.lit("`"))
    listed = F.array_sort(F.collect_list(F.struct("section", (-F.col("score")).alias("s"), "workspace", "path", "line", line.alias("l"))))
    parts = [F.lit(f"## impact: {name}")]
    for section, title in (("definition", "definitions"), ("caller", "callers"), ("importer", "importers"), ("reference", "references")):
        rows = F.transform(F.filter("rows", (lambda s: lambda x: x.section == s)(section)), lambda x: x.l)
        parts.append(F.concat(F.lit(f"\n\n### {title}\n"), F.when(F.size(rows) == 0, "(none)").otherwise(F.array_join(rows, "\n"))))
    return impact.agg(listed.alias("rows")).select(F.concat(*parts).alias("text"))
