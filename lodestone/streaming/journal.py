"""The journal as a stream: running ledger, first claims and late events; and upserts of changed files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.index import without_paths
from lodestone.operators.journal import ledger_columns, scope_key
from lodestone.sources.storage import cut_lineage, folder_exists, partition_folder, remove_folder


def with_event_time(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events with a watermark on ``at``; at_ts is without zone and is read as UTC."""
    return events.withColumn("at", F.col("at_ts").cast("timestamp")).withWatermark("at", delay)


def events_once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event_id once, repeats within the watermark dropped."""
    return with_event_time(events, delay).dropDuplicatesWithinWatermark(["event_id"])


def running_ledger(events: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """The token ledger of every workspace and window of event time."""
    return events_once(events, delay).groupBy(F.window("at", window).alias("w"), F.coalesce("workspace", F.lit("(untagged)")).alias("workspace")).agg(*ledger_columns())


def first_claims(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(scope, path, event_id): a path's first credit within its session; claims are remembered for the watermark's delay."""
    paths = with_event_time(events, delay).where("event_type = 'mcp' and ok").select("at", scope_key().alias("scope"), "event_id", F.explode("paths").alias("path")).where("scope is not null and path is not null")
    return paths.dropDuplicatesWithinWatermark(["scope", "path"])


def session_totals(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(workspace, start, end, n): runs of a workspace's events that no idle gap interrupts."""
    grouped = events_once(events, delay).where("workspace is not null").groupBy(F.session_window("at", gap).alias("w"), "workspace").agg(F.count("*").alias("n"))
    return grouped.select("workspace", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _remember(most: int, idle_ms: int) -> Callable:
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent, latest = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        last = 0
        for batch in batches:
            if latest and int(batch["at"].min().timestamp() * 1000) - latest > idle_ms:
                recent = []
            for event_id, path in batch.sort_values("event_id")[["event_id", "path"]].itertuples(index=False):
                recent = [path, *(p for p in recent if p != path)][:most]
                last = max(last, int(event_id))
            latest = max(latest, int(batch["at"].max().timestamp() * 1000))
        state.update((recent, latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"scope": [key[0]], "last_event": [last], "paths": [",".join(recent)]})

    return update


def turn_states(events: DataFrame, most: int = 20, delay: str = "1 hour", idle_hours: float = 24) -> DataFrame:
    """(scope, last_event, paths) after every batch: each session's last 20 distinct paths, kept as state of that size.

    A session without events for a day of event time is forgotten. Events without a time are left out.
    """
    timed = with_event_time(events, delay).where("at is not null")
    paths = timed.select("at", scope_key().alias("scope"), "event_id", F.explode("paths").alias("path")).where("scope is not null and path is not null")
    schema = "scope string, last_event bigint, paths string"
    return paths.groupBy("scope").applyInPandasWithState(_remember(most, int(idle_hours * 3_600_000)), schema, "paths array<string>, latest bigint", "update", GroupStateTimeout.EventTimeTimeout)


def upsert_files(changes: DataFrame, build: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, every: str | None = None, parts: int = 64):
    """Keep an index table in step with a stream of changes (workspace, path, op, seq, content, ...): op is upsert or delete.

    The table (workspace, path, ...) lies at ``table`` in folders by workspace and ``part``, a hash of the
    path. In each micro-batch the last change of a path counts (by ``seq``); of the folders that changed paths
    lie in, and of no others, the rows of these paths are replaced by what ``build`` makes of them. A batch
    that is run again gives the same table. A null workspace is written as an empty one.
    """
    placed = lambda df: df.withColumn("workspace", F.coalesce("workspace", F.lit(""))).withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int"))

    def apply(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in ("workspace", "path")]
        last = cut_lineage(placed(batch.groupBy("workspace", "path").agg(F.max_by(F.struct(*rest), "seq").alias("v")).select("workspace", "path", "v.*")))
        fresh = placed(build(last.where("op = 'upsert'").drop("part")))
        touched = [(r.workspace, r.part) for r in last.select("workspace", "part").distinct().collect()]  # folders of one micro-batch
        held = [(w, p) for w, p in touched if folder_exists(spark, f"{table}/{partition_folder(workspace=w, part=p)}")]
        new = fresh
        if held:
            old = spark.read.schema(fresh.schema).option("basePath", table).parquet(*[f"{table}/{partition_folder(workspace=w, part=p)}" for w, p in held])
            new = without_paths(old.select(*fresh.columns), last).unionByName(fresh)
        new = cut_lineage(new)
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace", "part").parquet(table)
        filled = {(r.workspace, r.part) for r in new.select("workspace", "part").distinct().collect()}
        for w, p in held:
            if (w or "", p) not in {(a or "", b) for a, b in filled}:
                remove_folder(spark, f"{table}/{partition_folder(workspace=w, part=p)}")

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
