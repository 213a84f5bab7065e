"""Operators on small tables made here: exact numbers, ties, nulls and empty input."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import components, evaluation, extract, graph, grep, index, journal, lookup, notes, search, windows
from lodestone.sources import journal as journal_io
from lodestone.sources.storage import cut_lineage
from lodestone.sources.tables import latest_versions, table
from lodestone.sources.versioned import current_version, read_version, write_version


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# a ledger with known sums

EVENTS = "event_id bigint, event_type string, workspace string, mode string, injected_tokens int, window_vs_file_tokens int, discovery_tokens int, response_tokens int, ok boolean, tokens_avoided int, blocked boolean, session string, paths array<string>, hits int, intent string, no_prompt boolean, delta_ms double, timed_out_delta boolean, timed_out_retrieve boolean, at_ts timestamp_ntz"


def event(**fields):
    names = [p.split()[0] for p in EVENTS.split(", ")]
    return tuple(fields.get(n) for n in names)


def ledger_events(spark):
    return frame(spark, [
        event(event_id=1, event_type="inject", mode="on", injected_tokens=100, window_vs_file_tokens=500, discovery_tokens=200),
        event(event_id=2, event_type="mcp", ok=True, response_tokens=50, window_vs_file_tokens=300),
        event(event_id=3, event_type="mcp", ok=False, response_tokens=10),
        event(event_id=4, event_type="guardrail", blocked=True, tokens_avoided=1200),
        event(event_id=4, event_type="guardrail", blocked=True, tokens_avoided=1200),
    ], EVENTS)


def test_ledger_exact(spark):
    r = journal.token_ledger(journal.events_once(ledger_events(spark))).head()
    assert (r.injected_tokens, r.response_tokens, r.spent, r.avoided_window, r.avoided_discovery, r.avoided_blocked, r.avoided, r.net, r.calls, r.calls_ok, r.walks_blocked) == (100, 60, 160, 800, 200, 1200, 2200, 2040, 2, 1, 1)


def test_ledger_of_nothing(spark):
    r = journal.token_ledger(frame(spark, [], EVENTS)).head()
    assert (r.injects, r.spent, r.net) == (0, 0, 0)
    s = journal.event_summary(frame(spark, [], EVENTS)).head()
    assert s.events == 0 and s.hit_rate is None and s.p50_delta_ms is None


def test_summary_null_rules(spark):
    r = journal.event_summary(frame(spark, [event(event_id=1, event_type="inject", no_prompt=True, delta_ms=12.0, hits=0)], EVENTS)).head()
    assert r.hit_rate is None and r.p50_delta_ms == 12.0 and r.injects == 1 and r.asked == 0


def test_claims_and_turns(spark):
    events = frame(spark, [event(event_id=i, event_type="mcp", ok=True, session="s", paths=p) for i, p in [(1, ["a", "b"]), (2, ["b", "c"]), (3, None), (4, ["a"])]] + [event(event_id=9, event_type="mcp", ok=True, paths=["z"])], EVENTS)
    assert {(r.path, r.event_id) for r in journal.session_claims(events).collect()} == {("a", 1), ("b", 1), ("c", 2)}
    assert [(r.scope, r.paths) for r in journal.turn_state(events, 2).collect()] == [("s", "a,b")]


def test_guardrail(spark):
    df = frame(spark, [("off", "walk", False, False), ("warn", "walk", False, False), ("all", "walk", True, False), ("auto", "walk", False, False), ("auto", "walk", True, False), ("auto", "shell", False, True), ("all", "read", False, False)], "m string, k string, s boolean, d boolean")
    got = [r[0] for r in df.select(journal.guardrail_decision(F.col("m"), F.col("k"), F.col("s"), F.col("d"))).collect()]
    assert got == ["allow", "log", "block", "block", "allow", "block", "allow"]


def test_journal_lines_round_trip(spark):
    lines = journal_io.to_lines(ledger_events(spark)).unionByName(frame(spark, [("no json",), ("{}",), ('{"event_type": 3',)], "value string"))
    back = journal_io.read_lines(lines)
    assert back.count() == 5 and back.agg(F.sum("tokens_avoided")).head()[0] == 2400


def test_journal_files(spark, tmp_path):
    journal_io.write_journal(ledger_events(spark), str(tmp_path / "j"), 2)
    (tmp_path / "j" / "broken.json").write_text("not json\n")
    assert journal_io.read_journal(spark, str(tmp_path / "j")).count() == 5
    assert [r.event_id for r in journal_io.journal_tail(journal_io.read_journal(spark, str(tmp_path / "j")).distinct(), 2).collect()] == [4, 3]


# files

VERSION = "workspace string, path string, hash string, mtime_ms bigint, size bigint"


def test_latest_versions(spark):
    rows = [("w", "a", "h1", 1, 1), ("w", "a", "h2", 2, 1), ("w", "a", "h2", 2, 1), ("w", "b", "h3", None, None), (None, "a", "h4", 5, 1)]
    got = {(r.workspace, r.path): r.hash for r in latest_versions(frame(spark, rows, VERSION)).collect()}
    assert got == {("w", "a"): "h2", ("w", "b"): "h3", (None, "a"): "h4"}
    assert latest_versions(frame(spark, [], VERSION)).count() == 0


def test_dirty_and_versions(spark):
    old = frame(spark, [("w", "same", "1", 1, 1), ("w", "touched", "2", 1, 1), ("w", "changed", "3", 1, 1), ("w", "gone", "4", 1, 1), ("w", "moved", "5", 1, 1)], VERSION)
    new = frame(spark, [("w", "same", "1", 1, 1), ("w", "touched", "2", 9, 1), ("w", "changed", "x", 9, 1), ("w", "new", "6", 1, 1), ("w", "there", "5", 1, 1)], VERSION)
    assert {(r.path, r.status) for r in index.dirty_files(old, new).collect()} == {("changed", "changed"), ("gone", "removed"), ("new", "added"), ("moved", "removed"), ("there", "added")}
    assert {(r.path, r.change) for r in index.version_diff(old, new).collect()} == {("changed", "M"), ("gone", "D"), ("new", "A"), ("there", "R")}


def test_replace_paths_equals_rebuild(spark):
    table = frame(spark, [("w", "a", 1), ("w", "a", 2), ("w", "b", 3), ("v", "a", 4)], "workspace string, path string, x int")
    fresh = frame(spark, [("w", "a", 7)], "workspace string, path string, x int")
    assert {tuple(r) for r in index.replace_paths(table, fresh).select("workspace", "path", "x").collect()} == {("w", "a", 7), ("w", "b", 3), ("v", "a", 4)}


def test_versioned_table(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        read_version(spark, root)
    first = write_version(spark.range(3).toDF("x"), root)
    second = write_version(spark.range(5).toDF("x"), root)
    assert first != second == current_version(spark, root) and read_version(spark, root).count() == 5
    spark.range(9).write.parquet(f"{root}/crashed")  # written, never switched to
    assert read_version(spark, root).count() == 5


def test_status_lines(spark):
    df = frame(spark, [(" M a.ts",), ("R  old.ts -> new.ts",), ('?? "sp ace.ts"',), (" D x",), ("",)], "line string")
    assert [(r.status, r.path, r.deleted) for r in index.parse_status(df).collect()] == [("M", "a.ts", False), ("R", "new.ts", False), ("??", "sp ace.ts", False), ("D", "x", True)]


# extraction

SOURCES = [
    ("w", "src/billing.py", "class InvoiceService:\n    def create_invoice(self):\n        return calculate_tax(1)\n\n\ndef calculate_tax(x):\n    return x\n"),
    ("w", "src/app.ts", "import { A } from './auth';\n\nconst svc = new A();\n\nexport function boot() {\n  svc.login();\n}\n"),
    ("w", "src/auth.ts", "export interface Credentials {\n  user: string;\n}\nexport class A {}\n"),
    ("w", "m.go", 'package m\nimport (\n\t"a/b"\n\t"c/d"\n)\nfunc (s *S) Run(x int) {\n\tcall(x)\n}\ntype S struct {}\n'),
    ("w", "none.py", None),
    ("w", "crlf.py", "def f():\r\n    g()\r\n"),
]


def sources(spark):
    return frame(spark, SOURCES, "workspace string, path string, content string")


def test_symbols(spark):
    s = sources(spark)
    assert {(r.path, r.name, r.kind, r.line) for r in extract.python_symbols(s).collect()} == {("src/billing.py", "InvoiceService", "class", 1), ("src/billing.py", "create_invoice", "function", 2), ("src/billing.py", "calculate_tax", "function", 6), ("crlf.py", "f", "function", 1)}
    assert {(r.name, r.kind) for r in extract.go_symbols(s).collect()} == {("Run", "function"), ("S", "type")}
    assert {(r.name, r.kind, r.line) for r in extract.script_symbols(s).collect()} == {("svc", "const", 3), ("boot", "function", 5), ("Credentials", "interface", 1), ("A", "class", 4)}
    code = "export class Desk {\n  private open = 1;\n  constructor(a) {\n  }\n  async lend(book: Book): Promise<void> {\n    if (ready(book)) {\n      this.shelf.find(book.id).mark(new Slip(), `x ${y()}`);\n    }\n  }\n  static back() { return super.back(lend(1), 'no()'); } // gone()\n}\nlet late = run(a?.b(), c.d.e());\nfunction alone(x) {\n  return (x);\n}\n"
    desk = frame(spark, [("w", "desk.ts", code), ("v", "desk.ts", "function other() {}\r\n")], "workspace string, path string, content string")
    got = {(r.workspace, r.name, r.kind, r.line) for r in extract.script_symbols(desk).collect()}
    assert got == {("w", "Desk", "class", 1), ("w", "Desk.lend", "method", 5), ("w", "Desk.back", "method", 10), ("w", "late", "variable", 12), ("w", "alone", "function", 13), ("v", "other", "function", 1)}
    calls = [(r.line, r.to_name) for r in extract.call_edges(desk).orderBy("line").collect()]
    assert sorted(calls) == sorted([(6, "ready"), (7, "find"), (7, "mark"), (10, "back"), (10, "lend"), (12, "run"), (12, "a.b"), (12, "e")])


def test_imports_resolve_to_files(spark):
    s = sources(spark)
    got = {(r.from_path, r.to_specifier, r.to_path) for r in extract.resolve_imports(extract.import_edges(s), s).collect()}
    assert ("src/app.ts", "./auth", "src/auth.ts") in got and ("m.go", "a/b", None) in got


def test_ambiguous_call_goes_to_the_imported_file(spark):
    symbols = frame(spark, [("w", "left.ts", "handle"), ("w", "right.ts", "handle"), ("w", "own.ts", "handle2"), ("w", "x.ts", "handle2"), ("w", "u.ts", "S.only")], "workspace string, path string, name string")
    calls = frame(spark, [("w", "caller.ts", "handle", 3), ("w", "own.ts", "handle2", 1), ("w", "caller.ts", "only", 4), ("w", "caller.ts", "nowhere", 5)], "workspace string, from_path string, to_name string, line int")
    imports = frame(spark, [("w", "caller.ts", "left.ts")], "workspace string, from_path string, to_path string")
    got = {(r.to_name, r.to_path) for r in extract.resolve_calls(calls, symbols, imports).collect()}
    assert got == {("handle", "left.ts"), ("handle2", "own.ts"), ("only", "u.ts"), ("nowhere", None)}


def test_chunks_take_the_comments_above(spark):
    files = frame(spark, [("w", "s.ts", "import x\n\n// Rejects a session\n// once expired\n\nfunction checkStale() {\n  return 1;\n}\n")], "workspace string, path string, content string")
    symbols = frame(spark, [(1, "w", "s.ts", "checkStale", 6, 8, None)], "id bigint, workspace string, path string, name string, line int, end_line int, signature string")
    r = extract.build_chunks(symbols, files).head()
    assert r.header == "s.ts > checkStale()" and r.text == "s.ts > checkStale()\n// Rejects a session\n// once expired\nfunction checkStale() {\n  return 1;\n}"


def test_changed_symbols(spark):
    symbols = frame(spark, [("w", "a", "f", 1, 5), ("w", "a", "g", 6, 9), ("w", "b", "h", 1, 9)], "workspace string, path string, name string, line int, end_line int")
    changes = frame(spark, [("w", "a", 2), ("w", "a", 3), ("w", "a", 99), ("v", "b", 1)], "workspace string, path string, line int")
    assert [r.name for r in extract.changed_symbols(changes, symbols).collect()] == ["f"]


def test_changed_lines_and_hunks(spark):
    old = frame(spark, [("w", "a.py", "x\ny\nz"), ("w", "gone.py", "x")], "workspace string, path string, content string")
    new = frame(spark, [("w", "a.py", "x\nnew\nz\nlast"), ("w", "fresh.py", "x"), ("v", "a.py", "q")], "workspace string, path string, content string")
    assert {(r.workspace, r.path, r.line) for r in extract.changed_lines(old, new, "py").collect()} == {("w", "a.py", 2), ("w", "a.py", 4)}
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,2 @@ def f\n-a\n+b\n@@ -9 +12 @@\n-c\n+d\n@@ -20,2 +21,0 @@\n-e\n--- a/y.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n"
    got = extract.hunk_lines(frame(spark, [("w", diff), ("w", None), ("w", "")], "workspace string, diff string")).collect()
    assert {(r.path, r.line) for r in got} == {("x.py", 3), ("x.py", 4), ("x.py", 12), ("x.py", 21)}


# graphs

def test_importers_have_a_visited_set(spark):
    edges = frame(spark, [("w", "b", "a"), ("w", "c", "b"), ("w", "a", "c"), ("w", "d", "c"), ("w", "e", "d"), ("w", "x", None)], "workspace string, from_path string, to_path string")
    start = frame(spark, [("w", "a")], "workspace string, path string")
    assert {(r.path, r.depth) for r in graph.importers(edges, start, 3).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert graph.importers(edges, start, 99).agg(F.max("depth")).head()[0] == 3 and graph.importers(edges.limit(0), start).count() == 0


def test_useful_callees(spark):
    df = frame(spark, [("a",), ("go",), ("console.log",), ("Map",), ("(anon)",), ("Get",), ("loadPolicy",)], "n string")
    assert [r[0] for r in df.select(graph.useful_callee(F.col("n"))).collect()] == [False, True, False, False, False, False, True]


@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=18))
@settings(max_examples=4, deadline=None)
def test_components_equal_union_find(spark, edges):
    parent = list(range(15))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {(r.node, r.component) for r in components.connected_components(frame(spark, [*edges, (3, None)], "u bigint, v bigint")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {(x, root(x)) for x in linked}


def test_components_of_a_long_path(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    got = components.connected_components(frame(spark, list(zip(order, order[1:])), "u bigint, v bigint"))
    assert got.select("component").distinct().collect()[0][0] == 0 and got.count() == n


# windows, lookup, search

def test_smallest_cover_wins(spark):
    hits = frame(spark, [(1, "w", "a", 5), (2, "w", "a", 50), (3, "w", "b", 1)], "hit_id int, workspace string, path string, line int")
    spans = frame(spark, [("w", "a", 1, 20), ("w", "a", 4, 8), ("w", "a", 8, 4), ("w", "a", 5, 30), ("w", "a", None, 9)], "workspace string, path string, start_line int, end_line int")
    assert {(r.hit_id, r.start_line, r.end_line) for r in windows.cover_spans(hits, spans).collect()} == {(1, 5, 30), (2, None, None), (3, None, None)}


def test_window_reading(spark):
    files = frame(spark, [("w", "f.md", "\n".join(f"line{i}" for i in range(1, 6))), ("w", "../up.md", "x"), ("w", "long.md", "\n".join("l" for _ in range(300)))], "workspace string, path string, content string")
    ranges = frame(spark, [(1, "w", "f.md", 2, 4), (2, "w", "../up.md", 1, 1), (3, "w", "f.md", 4, 99), (4, "w", "long.md", 10, 200)], "hit_id int, workspace string, path string, first int, last int")
    got = {r.hit_id: r for r in windows.read_windows(ranges, files).collect()}
    assert got[1].body == "line2\nline3\nline4" and not got[1].clamped and 2 not in got
    assert (got[3].first, got[3].last, got[3].clamped) == (4, 5, True) and got[4].last - got[4].first == 79


def test_budget_keeps_the_first(spark):
    df = frame(spark, [(1, 9.0, 8000), (2, 8.0, 4), (3, 7.0, 4)], "id int, score double, n int")
    assert [r.id for r in lookup.pack_budget(df, [F.desc("score")], F.col("n"), 100).collect()] == [1]
    assert [r.id for r in lookup.pack_budget(df.where("id > 1"), [F.desc("score")], F.col("n"), 1).collect()] == [2]


def test_grep_prefilter_equals_scan(spark):
    rows = [("v", "a", "x loadPolicy y\nz"), ("w", "a", "other loadPolicy"), ("w", "b", "loadPolic"), ("w", "c", None), ("w", "d", "\nreload loadPolicy(loadPolicy)")]
    files = frame(spark, rows, "workspace string, path string, content string")
    scan = grep.grep_lines(files, "loadPolicy", None)
    fast = grep.grep_fast(files, grep.ngram_postings(files), "loadPolicy", None)
    assert {tuple(r) for r in scan.collect()} == {tuple(r) for r in fast.collect()} and scan.count() == 3
    assert {(r.workspace, r.path) for r in scan.collect()} == {("v", "a"), ("w", "a"), ("w", "d")}


def test_postings_of_a_batch_are_not_held_at_once(spark, monkeypatch):
    """Few of the more than a million postings of the batch are there at any time; all would take 100 MB."""
    import tracemalloc

    import pyarrow as pa

    run = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, f, schema: run.append(f) or df)
    grep.ngram_postings(frame(spark, [], "workspace string, path string, content string"), settled=True)
    rng = random.Random(3)
    texts = ["\n".join("".join(rng.choices("abcdefghij_(). ", k=60)) for _ in range(50)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(["w"] * 400), pa.array([f"p{i}" for i in range(400)]), pa.array(texts)], names=["workspace", "path", "content"])
    wanted = sum(len(grep.sparse_ngrams(t.encode())) for t in texts)
    tracemalloc.start()
    found = sum(part.num_rows for part in run[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == wanted > 1_000_000 and peak < 50_000_000


def test_ngram_counts_shuffle_no_postings(spark, monkeypatch):
    monkeypatch.setattr(grep, "HELD", 50)
    files = frame(spark, [("w", f"p{i}", None if i == 7 else f"let loadPolicy = {i % 5}\nreturn\n") for i in range(200)], "workspace string, path string, content string").coalesce(2)
    counted = grep.ngram_counts(files)
    want = grep.ngram_postings(files).groupBy("hash").count()
    assert {tuple(r) for r in counted.collect()} == {tuple(r) for r in want.collect()}
    monkeypatch.undo()
    assert shuffled_rows(spark, grep.ngram_counts(files)) < 200 < shuffled_rows(spark, want)


def test_ngram_postings_name_the_file_of_every_ngram(spark, tmp_path):
    """Current versions only, the same path in two workspaces, texts that are null or empty, and many in one batch."""
    from lodestone.plans import search as plans

    rows = [("v", "a", "let loadPolicy = 3\r\n", 1), ("w", "a", "old text", 1), ("w", "a", "new loadPolicy\nline", 2), ("w", "b", None, 1), ("w", "c", "", 1), (None, "d", "ünï\n\nx", 1)]
    rows += [("u", f"p{i}", f"def f{i % 7}(x):\n    return {i}\n", 1) for i in range(300)]
    frame(spark, rows, "workspace string, path string, content string, mtime_ms bigint").write.parquet(str(tmp_path / "corpus.parquet"))
    got = [(r.hash, r.workspace, r.path) for r in plans.queries()["ngram_postings"](spark, str(tmp_path)).collect()]
    current = {(w, p): t for w, p, t, _ in rows}
    want = {(grep.gram_hash(g), w, p) for (w, p), t in current.items() for g in grep.sparse_ngrams((t or "").encode())}
    assert len(got) == len(set(got)) and set(got) == want
    counts = {(r.hash, r.n_paths) for r in plans.queries()["ngram_sizes"](spark, str(tmp_path)).collect()}
    assert counts == set(Counter(h for h, _, _ in want).items())


def test_ngrams_of_many_texts_equal_those_of_each():
    import pyarrow as pa

    rng = random.Random(6)
    texts = [bytes(rng.choice(b"abcdeXY_ \n\x00\xc3") for _ in range(rng.randrange(0, 60))) for _ in range(500)]
    texts += [None, b"", b"\n", b"a", bytes(rng.choice(b"abcXY_ \n") for _ in range(grep.BYTES + 70_000)), b"ab" * grep.BYTES]
    rng.shuffle(texts)
    got = []
    for grams, sizes, which in grep.ngrams_of_texts(pa.array(texts, pa.binary())):
        ends = [0, *sizes.cumsum().tolist()]
        got += [[grams[i] for i in which[b:e]] for b, e in zip(ends, ends[1:])]
    assert len(got) == len(texts)
    for found, text in zip(got, texts):
        assert len(found) == len(set(found)) and set(found) == set(grep.sparse_ngrams(text or b""))


def test_ngrams_equal_their_definition():
    import hashlib

    rng = random.Random(4)
    weight = lambda pair: int.from_bytes(hashlib.sha256(pair).digest()[:4], "big")
    for _ in range(30):
        data = bytes(rng.choice(b"abcdeXY_ \n\xc3") for _ in range(rng.randrange(0, 60)))
        want = set()
        for line in data.split(b"\n"):
            for i in range(len(line)):
                for j in range(i + 2, min(len(line), i + 12) + 1):
                    w = [weight(line[k : k + 2]) for k in range(i, j - 1)]
                    if len(w) == 1 or all(min(w[0], w[-1]) > x for x in w[1:-1]):
                        want.add(line[i:j])
        assert set(grep.sparse_ngrams(data)) == want


def test_bm25_edges(spark):
    docs = frame(spark, [(1, "cache cache token"), (2, None), (3, ""), (4, "cachet"), (5, "the cache")], "id bigint, text string")
    assert {r.id for r in search.bm25(docs, "id", "text", ["cache"]).collect()} == {1, 5}
    assert {r.id for r in search.bm25(docs, "id", "text", [("cache", True)]).collect()} == {1, 4, 5}
    assert search.bm25(docs.limit(0), "id", "text", ["cache"]).count() == 0 and search.bm25(docs, "id", "text", ["no such"]).count() == 0


def shuffled_rows(spark, df):
    """Rows that the stages of one run of ``df`` write to their shuffles."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    before = written()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for stage, n in written().items() if stage not in before)


def batch_by_definition(queries, docs, k):
    cut = lambda text: [t for t in re.split("[^a-z0-9]+", (text or "").lower()) if t]
    texts = {i: cut(t) for i, t in docs}
    average, out = sum(map(len, texts.values())) / len(texts), set()
    df = {t: sum(t in x for x in texts.values()) for x in texts.values() for t in x}
    for q, query in queries:
        scores = {}
        for i, x in texts.items():
            if parts := [max(math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / average)) for t in set(cut(query)) if t in x]:
                scores[i] = round(sum(parts), 6)
        out |= {(q, i, scores[i], r) for r, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:k], 1)}
    return out


@pytest.mark.parametrize("block", [3, 40, 10_000])
def test_batch_bm25_equals_its_definition(spark, block):
    rng = random.Random(6)
    docs = [(i, rng.choice([None, "", "Zeta-eta", " ".join(rng.choices("ab ab cd ef gh ij kl x1 x2 rare".split(), k=rng.randrange(1, 7)))])) for i in rng.sample(range(1000), 300)]
    queries = [(1, "ab cd"), (2, "AB, cd"), (3, ""), (4, None), (5, "nowhere"), (6, "rare x1 x1 ab"), (7, "zeta nowhere"), (8, "gh ij kl ef"), (9, "x2")]
    got = search.bm25_batch(frame(spark, queries, "query_id int, query string"), frame(spark, docs, "id bigint, text string"), 4, block=block)
    assert {tuple(r) for r in got.collect()} == batch_by_definition(queries, docs, 4) and got.count() == len(set(map(tuple, got.collect())))
    none = frame(spark, [], "id string, text string")
    assert search.bm25_batch(frame(spark, queries, "query_id int, query string"), none).count() == 0
    named = search.bm25_batch(frame(spark, queries, "query_id int, query string"), frame(spark, [(f"d{i}", t) for i, t in docs], "id string, text string"), 4, block=block)
    assert {tuple(r) for r in named.collect()} == batch_by_definition(queries, [(f"d{i}", t) for i, t in docs], 4)


def test_batch_bm25_shuffles_no_pairs_of_queries_and_texts(spark):
    docs = frame(spark, [(i, f"common w{i}") for i in range(3000)], "id bigint, text string")
    queries = docs.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("text").alias("query"))
    assert shuffled_rows(spark, search.bm25_batch(queries, docs)) < 50_000  # of 900,000 pairs


@pytest.mark.parametrize("name", ["ir_metrics", "golden_metrics", "ir_gate"])
def test_graded_queries_shuffle_no_pairs(spark, tmp_path, name):
    from lodestone.plans import search as plans

    rows = frame(spark, [(50 * i, "w", f"p{i}", f"commonW{i}") for i in range(1000)], "id bigint, workspace string, path string, name string")
    rows.write.parquet(f"{tmp_path}/symbols.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        assert shuffled_rows(spark, plans.queries()[name](spark, str(tmp_path))) < 100_000  # of a million pairs
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["ir_metrics", "golden_metrics", "ir_gate"])
def test_graded_queries_meet_no_more_blocks_for_copies(spark, tmp_path, monkeypatch, name):
    from functools import partial

    from lodestone.plans import search as plans

    rows = frame(spark, [(5 * i, "w", f"p{i}", f"commonW{i // 10 % 60}") for i in range(6000)], "id bigint, workspace string, path string, name string")
    rows.write.parquet(f"{tmp_path}/symbols.parquet")
    monkeypatch.setattr(search, "bm25_batch", partial(search.bm25_batch, block=100))  # 60 names, so one block of texts and one of queries
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled_rows(spark, plans.queries()[name](spark, str(tmp_path))) < 40_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["golden_metrics", "ir_gate"])
def test_graded_queries_read_symbols_once(spark, data, name):
    from lodestone.plans import search as plans

    assert not any("symbols.parquet" in file for file in plans.queries()[name](spark, data).inputFiles())  # all from the split texts


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_texts_are_split_and_gathered_across_batches(spark, rows):
    rng = random.Random(10)
    made = {i: rng.choice(["ab cd", "Cd-AB", "x", "x x", "", None]) for i in [*range(200), None]}
    docs = frame(spark, [(i, f"p{i}", t) for i, t in made.items() for _ in range(rng.randrange(1, 6))], "id int, path string, text string").repartition("id").sortWithinPartitions("id")
    want = {}
    for i, t in made.items():
        want.setdefault(" ".join(sorted((t or "").lower().replace("-", " ").split())), []).append(i)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        texts = search.split_texts(docs, search.terms_of, 4, once=True)
        got, counts = search.gather_texts(texts, 4)
        assert sorted((r.id or -1, r.path) for r in texts.collect()) == sorted((i or -1, f"p{i}") for i in made)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first = {b: sorted(ids, key=lambda i: (i is not None, i))[:4] for b, ids in want.items()}
    assert {r.bag: (r.copies, r.length) for r in got.collect()} == {b: (len(ids), len(b.split())) for b, ids in want.items()} and got.count() == len(want)
    assert all(r.ids == first[r.bag] for r in got.collect() if None not in want[r.bag])
    assert counts == {"n": 201, "dl": sum(len(b.split()) * len(ids) for b, ids in want.items()), "bags": len(want) - 1}


def test_gate_shuffles_each_symbol_once(spark, tmp_path):
    from lodestone.plans import search as plans

    rows = frame(spark, [(5 * i, "w", f"p{i}", f"commonW{i // 10}") for i in range(6000)], "id bigint, workspace string, path string, name string")
    rows.write.parquet(f"{tmp_path}/symbols.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled_rows(spark, plans.queries()["ir_gate"](spark, str(tmp_path))) < 34_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rrf_does_not_depend_on_the_order_of_lists(spark):
    a = frame(spark, [(1, 1), (2, 2)], "id int, rank int")
    b = frame(spark, [(2, 1), (3, 2)], "id int, rank int")
    assert search.rrf([a, b], "id").collect() == search.rrf([b, a], "id").collect()
    assert [r.id for r in search.rrf([a, b], "id").collect()] == [2, 1, 3]


def test_lsh_tables_differ_and_find_copies(spark):
    planes = search.hyperplanes(8, 4, 3)
    assert not (planes[0] == planes[1]).all()
    rng = random.Random(5)
    made = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    rows = [(i, [x / sum(y * y for y in v) ** 0.5 for x in v]) for i, v in enumerate(made)]
    rows += [(100 + i, rows[7][1]) for i in range(300)]
    vectors = frame(spark, rows, "id int, v array<float>")
    got = search.lsh_neighbours(vectors.where("id in (7, 100, 399)"), vectors, "id", "v", 8, 3).collect()
    assert {(r.query_id, r.rank, r.id) for r in got} == {(7, 1, 100), (7, 2, 101), (7, 3, 102), (100, 1, 7), (100, 2, 101), (100, 3, 102), (399, 1, 7), (399, 2, 100), (399, 3, 101)}
    assert search.lsh_neighbours(vectors.limit(0), vectors, "id", "v", 8).count() == 0 and search.lsh_neighbours(vectors, vectors.limit(0), "id", "v", 8).count() == 0


def test_lsh_recall(spark):
    """Of the true top 8 of rows whose id is divisible by 50, and of the nearest notes at 0.9 or more, against brute force."""
    import numpy as np

    rows = table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").collect()
    at = np.array([r.embedding for r in rows], dtype=np.float64)
    ids = np.array([r.vec_id for r in rows])
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = {(r.query_id, r.vec_id) for r in search.lsh_neighbours(vectors.where("vec_id % 50 = 0"), vectors, "vec_id", "embedding", 64).collect()}
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        score = np.round(at @ at[q], 4)
        order = [j for j in np.lexsort((ids, -score)) if j != q and score[j] >= 0.12][:8]
        want |= {(int(ids[q]), int(ids[j])) for j in order}
    assert len(got & want) >= 0.9 * len(want)


def test_near_notes_recall_and_merge(spark):
    import numpy as np

    held = table(spark, "/root/testdata/sf0.1", "memories").where("size(embedding) = 256").select("id", "kind", "text", "use_count", "embedding")
    rows = [r for r in held.select("id", "kind", "embedding").collect() if np.isfinite(r.embedding).all() and np.any(r.embedding)]
    unit = np.array([np.array(r.embedding) / np.linalg.norm(r.embedding) for r in rows])
    kinds = np.array([(r.kind or "").strip().lower() for r in rows])
    ids = np.array([r.id for r in rows])
    want = {}
    for q in np.flatnonzero(ids % 50 == 0):
        score = np.where((kinds == kinds[q]) & (ids != ids[q]), unit @ unit[q], -9)
        if score.max().round(4) >= 0.9:
            want[int(ids[q])] = round(float(score.max()), 3)
    close = notes.close_notes(held, held.where("id % 50 = 0"))
    got = {r.id: round(r.similarity, 3) for r in close.collect()}
    assert want and sum(abs(got.get(i, 0) - s) < 0.002 for i, s in want.items()) >= 0.95 * len(want)
    small = frame(spark, [(1, "short", 2), (2, "much longer", 0), (3, "tiny!", None)], "id bigint, text string, use_count int")
    pairs = frame(spark, [(2, 1, 0.95), (3, 1, 0.95)], "id bigint, near_id bigint, similarity double")
    assert [tuple(r) for r in notes.merged_notes(small, pairs).collect()] == [(1, "much longer", 4)]


# evaluation and notes

def test_ideal_ranking_scores_one(spark):
    qrels = frame(spark, [("q", "a", 3), ("q", "b", 1), ("r", "c", 2)], "query_id string, item string, grade int")
    hits = frame(spark, [("q", "a", 1), ("q", "b", 2), ("q", "b", 3)], "query_id string, item string, rank int")
    got = {r.query_id: r for r in evaluation.ir_metrics(hits, qrels).collect()}
    assert (got["q"].recall5, got["q"].rr, got["q"].ndcg10) == (1.0, 1.0, 1.0) and (got["r"].recall5, got["r"].rr, got["r"].ndcg10) == (0.0, 0.0, 0.0)
    assert [r.passed for r in evaluation.gate(evaluation.mean_metrics(evaluation.ir_metrics(hits, qrels))).orderBy("metric").collect()] == [False, True, True]


def test_recall_prefers_scope_and_copes_with_bad_vectors(spark):
    rows = [(1, "fact", "x", [1.0, 0.0], "2026-01-01 00:00:00", 0, "a.ts"), (2, "fact", "x", None, "2026-01-01 00:00:00", 0, ""), (3, "fact", "x", [float("nan"), 1.0], None, None, None), (4, "fact", "x", [1.0, 0.0], "2026-01-01 00:00:00", 0, "b.ts")]
    n = frame(spark, rows, "id bigint, kind string, text string, embedding array<float>, at string, use_count int, paths string").withColumn("created_at", F.col("at").cast("timestamp_ntz")).withColumn("last_used_at", F.col("created_at"))
    got = notes.recall(n, [1.0, 0.0], None, "2026-01-01 00:00:00", ["a.ts"]).collect()
    assert got[0].id == 1 and {r.id for r in got} == {1, 2, 4}
    assert notes.decayed(n, "2027-01-01 00:00:00").count() == 4
    assert notes.mark_recalled(notes.recall(n, [1.0, 0.0], None, "2026-01-01 00:00:00"), n, "2026-01-02 00:00:00").where("id = 1").head().use_count == 1


def test_stale_notes(spark):
    n = frame(spark, [(1, "w", "a:12,b:99"), (2, "w", "a:12"), (3, "w", None), (4, "w", "gone:1"), (5, "v", "a:12"), (6, None, "a:12")], "id bigint, workspace string, path_hashes string")
    files = frame(spark, [("w", "a", "1234"), ("w", "b", "0000"), ("v", "a", "9999")], "workspace string, path string, hash string")
    assert {(r.id, r.n_paths, r.n_stale) for r in notes.stale_notes(n, files).collect()} == {(1, 2, 1), (4, 1, 1), (5, 1, 1), (6, 1, 1)}


def test_prior_reads_by_ranges_equal_one_pass(spark):
    rng = random.Random(6)
    rows = [(i * 7 % 1009, "mcp", rng.choice(["s", "s", "s", "t", None]), rng.choice(["w", None]), [rng.choice("abcd") for _ in range(rng.randrange(0, 3))] or None) for i in range(900)]
    events = frame(spark, rows, "event_id bigint, event_type string, session string, workspace string, paths array<string>")
    want = []
    for scope in ("s", "t", "w"):
        reads = sorted((e, sorted(set(p))) for e, _, s, w, p in rows if (s or w) == scope and p)
        for i, (e, paths) in enumerate(reads):
            want += [(scope, e, p, sum(p in q for _, q in reads[max(0, i - 20) : i])) for p in paths]
    for size in (100_000, 7):
        got = [(r.scope, r.event_id, r.path, r.prior) for r in journal.prior_reads(events, 20, size).collect()]
        assert sorted(got) == sorted(want)
    assert journal.prior_reads(events.limit(0)).count() == 0


def test_cut_lineage_keeps_rows_and_schema(spark):
    df = frame(spark, [(1, [1, 2], None), (2, None, "x")], "a int, b array<int>, c string")
    cut = cut_lineage(df)
    assert cut.schema == df.schema and sorted(cut.collect()) == sorted(df.collect())


def test_golden_items_by_symbol_then_path(spark):
    golden = frame(spark, [("q", "a.ts#f"), ("q", "a.ts"), ("q", "b.ts"), ("r", "a.ts")], "query_id string, item string")
    hits = frame(spark, [("q", 1, "a.ts", "f"), ("q", 2, "a.ts", "g"), ("q", 3, "b.ts", None), ("q", 4, "c.ts", "f"), ("r", 1, "a.ts", "f")], "query_id string, rank int, path string, symbol string")
    got = {tuple(r) for r in evaluation.graded_hits(hits, golden).collect()}
    assert got == {("q", "a.ts#f", 1), ("q", "a.ts", 2), ("q", "b.ts", 3), ("r", "a.ts", 1)}


def test_locate_credit_once_and_for_quality_only(spark):
    files = frame(spark, [("w", "a", 4000), ("w", "b", 100_000), ("w", "c", None)], "workspace string, path string, size bigint")
    hits = frame(spark, [("s", 1, "w", "a", 10, False), ("s", 2, "w", "a", 10, True), ("s", 3, "w", "a", 0, True), ("s", 3, "w", "b", 100, True), ("s", 3, "w", "gone", 0, True), ("t", 4, "w", "a", 2000, True), (None, 5, "w", "a", 0, True)], "scope string, event_id bigint, workspace string, path string, delivered bigint, quality boolean")
    got = {tuple(r) for r in journal.locate_credit(hits, files).collect()}
    assert got == {("s", 2, 1, 990, 30), ("s", 3, 2, 7900, 0), ("t", 4, 1, 0, 30)}
    assert journal.locate_credit(hits.limit(0), files).count() == 0


def test_recent_changes_come_first(spark):
    symbols = frame(spark, [("w", "old", 1, "a"), ("w", "new", 1, "b"), ("w", "fed", 2, "c"), ("w", "fed", 1, "d")], "workspace string, path string, line int, name string")
    files = frame(spark, [("w", "old", 1), ("w", "new", 9), ("w", "fed", 2)], "workspace string, path string, mtime_ms bigint")
    changes = frame(spark, [("w", "fed", "2026-05-31 12:00:00"), ("w", "old", "2026-05-01 12:00:00")], "workspace string, path string, at string")
    assert [r.name for r in lookup.recent_symbols(symbols, files, 4).collect()] == ["b", "d", "c", "a"]
    assert [r.name for r in lookup.recent_symbols(symbols, files, 4, changes, "2026-06-01 00:00:00").collect()] == ["d", "c", "b", "a"]


def test_enclosing_symbol_is_the_innermost(spark):
    symbols = frame(spark, [("w", "a", "C", 1, 9, "class"), ("w", "a", "C.m", 2, 5, "method"), ("v", "a", "other", 1, 9, "class")], "workspace string, path string, name string, line int, end_line int, kind string").withColumn("signature", F.lit("s"))
    calls = frame(spark, [("w", "a", "run", 3), ("w", "a", "run", 3), ("w", "a", "x.run", 7), ("w", "a", "run", 20)], "workspace string, from_path string, to_name string, line int")
    held = graph.enclosing(calls, symbols)
    assert {(r.to_name, r.line, r.n, r.from_symbol) for r in held.collect()} == {("run", 3, 2, "C.m"), ("x.run", 7, 1, "C"), ("run", 20, 1, None)}
    (node,) = graph.node_details(held, symbols).collect()
    assert (node.name, node.kind, node.callers, node.callees, node.top_callers) == ("run", None, 2, 0, "C.m")


def test_merged_snippets(spark):
    hits = frame(spark, [("w", "a", 9, "g", 1.0, "late"), ("w", "a", 2, "f", 2.0, "first"), ("w", "a", 2, "f", 0.5, None), ("w", "b", 1, "h", 3.0, "only"), ("v", "a", 1, "x", 1.0, "")], "workspace string, path string, line int, symbol string, score double, snippet string")
    got = {(r.workspace, r.path): (r.symbols, r.snippet) for r in lookup.merge_per_file(hits).collect()}
    assert got == {("w", "a"): ("f, g", "lines 2, 9\nfirst\n---\nlate"), ("w", "b"): ("h", "only"), ("v", "a"): ("x", "")}


def test_summary_scopes(spark):
    schema = "event_type string, workspace string, no_prompt boolean, hits int, delta_ms double, retrieve_ms double"
    own, legacy, other = ("inject", "w", None, 2, 5.0, 1.0), ("inject", None, None, 1, 6.0, 1.0), ("inject", "v", None, 0, 7.0, 1.0)
    rows = frame(spark, [own, own, legacy, other, ("mcp", "w", None, 3, None, None)], schema)
    assert tuple(journal.inject_summary(rows, "w").head()) == (2, 2, 5.0, 5.0, 1.0, 1.0, "2:2")
    assert journal.summary_scope(rows, "u").count() == 1 and journal.summary_scope(frame(spark, [other], schema), "u").count() == 1
    silent = frame(spark, [("inject", "w", True, None, 1.0, None), other], schema)
    assert journal.summary_scope(silent, "w").count() == 2 and journal.inject_summary(rows.limit(0), "w").head().injects == 0


def test_windows_of_ignored_files_are_not_served(spark):
    files = frame(spark, [("w", "src/a.ts", "x\ny"), ("w", "node_modules/a.ts", "x"), ("w", "a.exe", "x"), ("w", "../a.ts", "x")], "workspace string, path string, content string")
    ranges = files.select(F.monotonically_increasing_id().alias("hit_id"), "workspace", "path", F.lit(1).alias("first"), F.lit(1).alias("last"))
    assert [r.path for r in windows.read_windows(ranges, files).collect()] == ["src/a.ts"]


def test_spans_with_a_null_end_cover_nothing(spark):
    hits = frame(spark, [(1, "w", "a", 5)], "hit_id int, workspace string, path string, line int")
    spans = frame(spark, [("w", "a", 5, None), ("w", "a", None, 5), ("w", "a", 9, 2)], "workspace string, path string, start_line int, end_line int")
    assert [(r.start_line, r.end_line) for r in windows.cover_spans(hits, spans).collect()] == [(2, 9)]
