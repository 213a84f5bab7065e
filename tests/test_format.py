"""Formatting, snippets, packs, golden cases and the index build."""

import json

from pyspark.sql import functions as F

from lodestone.functions import format as fm
from lodestone.operators.pack import prompt_pack
from lodestone.plans.build import build_index
from lodestone.sources.golden import read_golden
from lodestone.sources.versioned import read_version


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).head()[0]


def test_numbers(spark):
    assert [one(spark, v, "bigint", fm.short_number) for v in (None, 7, 1500, -2_500_000)] == ["--", "7", "1.5k", "-2.5M"]
    assert [one(spark, v, "double", fm.percent) for v in (None, 0.256)] == ["--", "26%"]


def test_payload_fields_and_redaction(spark):
    payload = json.dumps({"prompt": " ", "input": {"text": "hello"}})
    assert one(spark, payload, "string", lambda c: fm.first_field(c, "$.prompt", "$.input.text", "$.x")) == "hello"
    assert one(spark, "no json", "string", lambda c: fm.first_field(c, "$.a")) is None
    assert one(spark, "cannot open /home/me/x/y.ts: denied", "string", fm.redact_paths) == "cannot open <path>: denied"
    assert len(one(spark, "x" * 900, "string", fm.redact_paths)) == 500


def test_snippet(spark):
    text = " ".join(f"w{i}" for i in range(50)) + " cache " + " ".join(f"v{i}" for i in range(50))
    got = one(spark, text, "string", lambda c: fm.snippet(c, [("cache", False)], 10))
    assert got.startswith("... w45") and " cache " in got and got.endswith(" ...") and len(got.split()) == 12
    assert one(spark, "a b", "string", lambda c: fm.snippet(c, [("zz", True)], 10)) == "a b"


def test_hits_as_text(spark):
    hits = spark.createDataFrame([("b.ts", 3, 3, "g", 0.5, None, 2), ("a.ts", 1, 4, "f", 0.9, "x\ny", 1), ("c.ts", None, None, None, 0.1, "", 3)], "path string, first int, last int, symbol string, score double, snippet string, rank int")
    assert fm.hits_as_text(hits).head().text == "- **f** a.ts:1-4\n  x\n  y\n- **g** b.ts:3\n- c.ts"
    assert fm.hits_as_text(hits.limit(0)).head().text == ""


HITS = "path string, line int, first int, score double, snippet string"


def test_prompt_pack(spark):
    recent = spark.createDataFrame([("r.ts", 1, "a", 5), ("s.ts", 2, "b", 9)], "path string, line int, name string, mtime_ms bigint")
    long = "x" * 2000
    hits = spark.createDataFrame([("a", 1, 1, 1.0, long), ("b", 2, None, 0.9, long), ("c", 3, 1, 0.2, long)], HITS)
    got = {(r.part, r.pos): (r.path, len(r.text)) for r in prompt_pack(hits, recent).collect()}
    assert got == {("strong", 1): ("a", 720), ("weak", 1): ("b", 0), ("weak", 2): ("c", 0)}
    none = prompt_pack(hits.where("path = 'b'"), recent).collect()
    assert {(r.part, r.path) for r in none} == {("weak", "b"), ("recent", "s.ts"), ("recent", "r.ts")}
    assert {(r.part, r.pos) for r in prompt_pack(hits.limit(0), recent).collect()} == {("recent", 1), ("recent", 2)}


def test_golden(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"query": "q", "expect": {"x": 2, "y#f": 1}}]))
    (tmp_path / "b.json").write_text(json.dumps({"tasks": [{"query": "r", "expect": {"z": 3}}]}))
    assert {(r.query, r.item, r.grade) for r in read_golden(spark, str(tmp_path / "a.json")).collect()} == {("q", "x", 2), ("q", "y#f", 1)}
    assert [(r.query, r.item) for r in read_golden(spark, str(tmp_path / "b.json")).collect()] == [("r", "z")]
    builtin = spark.createDataFrame([("1", "b", "c", 1)], "query_id string, query string, item string, grade int")
    assert read_golden(spark, str(tmp_path / "none.json"), builtin).count() == 1


def test_index_build(spark, tmp_path):
    corpus = spark.createDataFrame([("w", "a.py", "# doc\ndef load_policy(x):\n    return save(x)\n"), ("w", "b.ts", "import { x } from './c';\nexport function f() {}\n"), ("v", "c.ts", "let y = 1\n"), ("w", "c.ts", "const z = 2\n")], "workspace string, path string, content string")
    build_index(corpus, corpus, str(tmp_path / "index"))
    read = lambda name: read_version(spark, str(tmp_path / "index" / name))
    assert {r.name for r in read("symbols").collect()} == {"load_policy", "f", "y", "z"}
    assert read("chunks").where("path = 'a.py'").head().text.startswith("a.py > load_policy") and read("imports").head().to_path == "c.ts"
    assert {r.workspace for r in read("ngrams").select("workspace").distinct().collect()} == {"w", "v"}
    assert read("postings").where("term = 'policy'").count() == 1 and read("vectors").count() > 0 and read("calls").where("to_name = 'save'").count() == 1


def test_notes_and_impact_as_text(spark):
    notes = spark.createDataFrame([(2, "fact", "b", "x,y", "p,q", 2), (1, "decision", "a", None, None, 1)], "id bigint, kind string, text string, tags string, paths string, rank int")
    assert fm.notes_as_text(notes, "## n").head().text == "## n\n\n- (#1 decision) a\n- (#2 fact [x, y]) b — `p`, `q`"
    assert fm.notes_as_text(notes.limit(0), "## n").head().text == "## n\n\n(no notes yet)"
    impact = spark.createDataFrame([("definition", "w", "a.ts", 3, 1.0), ("importer", "w", "b.ts", 0, 2.0)], "section string, workspace string, path string, line int, score double")
    assert fm.impact_as_text(impact, "f").head().text == "## impact: f\n\n### definitions\n- `a.ts:3`\n\n### callers\n(none)\n\n### importers\n- `b.ts`\n\n### references\n(none)"
