"""Streams against the batch results over the same rows."""

from pyspark.sql import functions as F

from lodestone.operators import journal
from lodestone.sources.tables import table
from lodestone.sources.walk import walk_corpus
from lodestone.streaming import journal as stream


def drain(df, mode, name):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def events(spark, data, tmp_path):
    rows = table(spark, data, "journal")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def test_running_ledger_sums_to_the_batch_ledger(spark, data, tmp_path):
    rows, live = events(spark, data, tmp_path)
    drain(stream.running_ledger(live, "1 day", "3650 days"), "complete", "ledger")
    total = spark.sql("select sum(spent) s, sum(avoided) a, sum(calls) c from ledger").head()
    want = journal.token_ledger(journal.events_once(rows).where("at_ts is not null")).head()
    assert (total.s, total.a, total.c) == (want.spent, want.avoided, want.calls)


def test_first_claims_equal_batch_claims(spark, data, tmp_path):
    rows, live = events(spark, data, tmp_path)
    drain(stream.first_claims(live, "3650 days"), "append", "claims")
    got = {(r.scope, r.path) for r in spark.sql("select scope, path from claims").collect()}
    assert got == {(r.scope, r.path) for r in journal.session_claims(journal.events_once(rows)).collect()}


def test_turn_states_hold_the_newest_paths(spark, data, tmp_path):
    rows, live = events(spark, data, tmp_path)
    drain(stream.turn_states(live, 20, "3650 days"), "update", "turns")
    last = spark.sql("select scope, max_by(paths, last_event) p from turns group by scope")
    want = {r.scope: set(r.paths.split(",")) for r in journal.turn_state(journal.events_once(rows).where("at_ts is not null")).collect()}
    assert {r.scope: set(r.p.split(",")) for r in last.collect() if len(want[r.scope]) < 20} == {k: v for k, v in want.items() if len(v) < 20}


def test_idle_sessions_are_forgotten(spark, tmp_path):
    schema = "event_id bigint, at_ts timestamp_ntz, session string, workspace string, paths array<string>"
    days = [(1, "2026-01-01", "s", "a"), (2, "2026-01-09", "t", "b"), (3, "2026-01-20", "t", "c"), (4, "2026-01-21", "s", "d"), (5, "2026-01-21", "t", "e")]
    for i, (event, day, session, path) in enumerate(days):
        rows = spark.createDataFrame([(event, day, session, None, [path])], "event_id bigint, at_ts string, session string, workspace string, paths array<string>")
        rows.withColumn("at_ts", F.col("at_ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(stream.turn_states(live, 20, "1 hour", 48), "update", "idle")
    got = {(r.scope, r.last_event): r.paths for r in spark.sql("select * from idle").collect()}
    assert got[("s", 4)] == "d" and got[("t", 5)] == "e,c"


def test_upserts_equal_a_rebuild(spark, tmp_path):
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "cp")
    build = lambda df: df.select("workspace", "path", F.length("content").alias("n"))
    schema = "workspace string, path string, op string, seq int, content string"
    batches = [
        [("w", "a", "upsert", 1, "x"), ("w", "b", "upsert", 2, "xx"), ("w", "c", "upsert", 3, "xxx"), ("v:1", "a", "upsert", 4, "zz"), (None, "n", "upsert", 5, "q")],
        [("w", "a", "upsert", 11, "xx"), ("w", "a", "upsert", 12, "xxxx"), ("w", "b", "delete", 13, None), ("w", "d", "upsert", 14, "y"), ("v:1", "a", "delete", 15, None)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ch"))
        live = spark.readStream.schema(schema).parquet(str(tmp_path / "ch"))
        stream.upsert_files(live, build, table, checkpoint, parts=4).awaitTermination()
    assert {(r.path, r.n) for r in spark.read.parquet(table).collect()} == {("a", 4), ("c", 3), ("d", 1), ("n", 1)}


def test_walk(spark, tmp_path):
    for name, text in {"src/a.ts": "let a", "node_modules/x.js": "x", "src/b.min.js": "x", "README.md": "# hi", "bin.exe": "x"}.items():
        path = tmp_path / "ws" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    got = walk_corpus(spark, str(tmp_path / "ws"), "w")
    assert {(r.path, r.content) for r in got.collect()} == {("src/a.ts", "let a"), ("README.md", "# hi")}
