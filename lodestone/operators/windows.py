"""Line windows around hits: span lookup, ranges, clamping and reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import extension_class, ignore_rules, is_ignored

MOST_LINES, MOST_CHARS, PAD, ANCHOR, MOST_BYTES, QUALITY_CHARS = 80, 3500, 2, 40, 1_500_000, 24


def window_range(line: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """First and last line: the span if it has at most 80 lines, else 80 lines from 40 above the hit; without a span two lines around it."""
    long = end - start + 1 > MOST_LINES
    first = F.when(start.isNull() | end.isNull(), line - PAD).when(long, F.greatest(start, line - ANCHOR)).otherwise(start)
    last = F.when(start.isNull() | end.isNull(), line + PAD).when(long, F.least(first + (MOST_LINES - 1), end)).otherwise(end)
    return first, last


def clamp_range(first: Column, last: Column, total: Column) -> tuple[Column, Column, Column]:
    """(first, last, clamped) within 1..total and at most 80 lines."""
    a = F.least(F.greatest(first, F.lit(1)), F.greatest(total, F.lit(1)))
    b = F.least(F.greatest(last, a), F.greatest(total, F.lit(1)), a + (MOST_LINES - 1))
    return a, b, (a != first) | (b != last)


def cover_spans(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """hits (hit_id, workspace, path, line) with start_line and end_line of the span that covers each, if any.

    Spans with a null end do not count. A span that starts at the line wins, then the smallest covering one, then the first by start. An
    equi-join on the file with the range as residue; one row for each hit is kept by an aggregate, so a
    file with many spans gathers nothing.
    """
    known = spans.where("start_line is not null and end_line is not null")
    ranges = known.select("workspace", "path", F.least("start_line", "end_line").alias("s"), F.greatest("start_line", "end_line").alias("e")).distinct()
    met = hits.select("hit_id", "workspace", "path", "line").join(ranges, ["workspace", "path"]).where("line between s and e")
    order = F.struct(F.when(F.col("s") == F.col("line"), 0).otherwise(1), F.col("e") - F.col("s"), F.col("s"))
    best = met.groupBy("hit_id").agg(F.min_by(F.struct("s", "e"), order).alias("b"))
    return hits.join(best, "hit_id", "left").select(*hits.columns, F.col("b.s").alias("start_line"), F.col("b.e").alias("end_line"))


def read_windows(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """ranges (hit_id, workspace, path, first, last) with first, last, clamped and body of at most 3,500 characters.

    Unsafe, ignored and unknown paths, extensions that are not indexed and files above 1.5 MB give no row. A null text counts as empty.
    """
    served = (extension_class(F.col("path")) != "other") & ~is_ignored(F.col("path"), ignore_rules())
    known = files.where(served & (F.octet_length(F.coalesce("content", F.lit(""))) <= MOST_BYTES))
    lines = known.select("workspace", "path", F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x: F.rtrim(x, F.lit("\r"))).alias("lines"))
    joined = ranges.join(lines, ["workspace", "path"])
    a, b, clamped = clamp_range(F.col("first"), F.col("last"), F.size("lines"))
    body = F.substring(F.array_join(F.slice("lines", a, b - a + 1), "\n"), 1, MOST_CHARS)
    return joined.select("hit_id", "workspace", "path", a.alias("first"), b.alias("last"), clamped.alias("clamped"), body.alias("body"))


def enrich_hits(hits: DataFrame, spans: DataFrame, files: DataFrame) -> DataFrame:
    """hits (hit_id, workspace, path, line, snippet) with their window as snippet, where it is not blank."""
    covered = cover_spans(hits, spans)
    first, last = window_range(F.col("line"), F.col("start_line"), F.col("end_line"))
    windows = read_windows(covered.select("hit_id", "workspace", "path", first.alias("first"), last.alias("last")), files)
    joined = hits.join(windows.select("hit_id", "first", "last", "body"), "hit_id", "left")
    body = F.when(F.trim("body") != "", F.col("body"))
    return joined.select("hit_id", "workspace", "path", "line", "first", "last", F.coalesce(body, "snippet").alias("snippet"))


def is_quality_hit(snippet: Column, first: Column, score: Column | None = None, floor: float | None = None) -> Column:
    """Whether a hit is worth showing in full: a window and at least 24 characters; with a floor, also its score."""
    good = (F.length(F.trim(F.coalesce(snippet, F.lit("")))) >= QUALITY_CHARS) & first.isNotNull()
    return good if floor is None or score is None else good & (score >= floor)


def number_within(df: DataFrame, *order: str) -> DataFrame:
    """A hit_id from 1 in the given order, for a result of a few rows."""
    return df.withColumn("hit_id", F.row_number().over(Window.orderBy(*order)))
