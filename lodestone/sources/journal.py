"""The usage journal as JSON lines: schema, source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One wide row for all event types; fields that a type does not have are null.
SCHEMA = (
    "event_id bigint, event_type string, at_ts timestamp_ntz, session string, workspace string, agent string, mode string, intent string, no_prompt boolean, dirty int, delta_ms double, retrieve_ms double, hits int, injected_tokens int, "
    "response_tokens int, window_vs_file_tokens int, discovery_tokens int, timed_out_delta boolean, timed_out_retrieve boolean, tool string, ok boolean, blocked boolean, tokens_avoided int, paths array<string>, path_count int, files_indexed int, "
    "files int, ms double, action string, ready boolean, issue_count int, git_delta int, edited boolean, confidence string, reason string"
)


def to_lines(events: DataFrame) -> DataFrame:
    """(value): one JSON object for each event; nulls are left out."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def read_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON lines; a line that is no object, or has no event type, is skipped."""
    parsed = lines.select(F.from_json(column, SCHEMA, {"mode": "PERMISSIVE"}).alias("e"))
    return parsed.where("e is not null and e.event_type is not null").select("e.*")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON files; malformed lines are dropped."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)


def write_journal(events: DataFrame, path: str, rows_a_file: int = 1_000_000) -> None:
    """Append events as JSON files of at most ``rows_a_file`` rows: rotation by size."""
    events.write.mode("append").option("maxRecordsPerFile", rows_a_file).json(path)


def journal_tail(events: DataFrame, n: int = 10_000) -> DataFrame:
    """The last n events by order of arrival."""
    return events.orderBy(F.desc("event_id")).limit(n)
