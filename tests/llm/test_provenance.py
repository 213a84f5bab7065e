"""Generated, minified, vendored and data files, and look-alikes that are none of these."""

import pytest

from lodestone.llm.provenance import inspect, merkle_nodes, not_hand_written, shared_nodes

CODE = "import x\n\n\ndef f%d(a):\n    return a + %d\n\n\nclass C%d:\n    pass\n"
LIB = "\n".join(f"export function lib{i}(a) {{ return a * {i} + {i * 7} }}" for i in range(30))
MIN = "var a=function(t){for(var n=0;n<t.length;n++)if(t[n]===10)return!0;return!1};" * 30
DATA = "export const D = [\n" + "".join(f'  "{"QWErtyUIOpasDFGhjk" * 4}{i}",\n' for i in range(40)) + "];\n"


def reason(path, text):
    return inspect(path, text)[0]


@pytest.mark.parametrize("notice", ["// Code generated by protoweave. DO NOT EDIT.", "/*\n * @generated by x v1\n */", "// <auto-generated>", "# This file was automatically generated by x; changes will be lost.", "// DO NOT MODIFY! Produced from a.yaml", "// Diese Datei wurde automatisch erzeugt (x).", "// AUTO-GENERATED FILE - do not modify by hand"])
def test_notices(notice):
    assert reason("a.ts", notice + "\nlet a = 1;\n") == "generated"
    assert reason("a.ts", "let a = 1;\n\n" + notice) == "generated"
    assert reason("a.ts", "let a = 1;\n" + notice + "\nlet b = 2;\n") is None


def test_look_alikes():
    for line in ('// writes the "do not edit" banner of the files we emit', "// please do not edit the cache by hand, call x instead", "// the report is generated by f at night, see a.ts", "// Copyright 2025 the keen team, all rights reserved"):
        assert reason("a.ts", line + "\nlet a = 1;\n") is None
    table = "X = {\n" + "".join(f'    "k{i}": "some words for key {i}",\n' for i in range(40)) + "}\n"
    assert reason("a.py", table) is None
    assert reason("a.ts", 'const a = "' + "x y " * 500 + '";\nexport function f() { return a }\n') is None


def test_layout():
    assert reason("a.js", MIN) == "minified" and reason("a.js", "/*! x */\n" + MIN) == "minified" and reason("a.css", ".a{margin:0 1px;color:#123456}" * 40) == "minified"
    assert reason("a.ts", DATA) == "data" and reason("a.py", "X = [" + ", ".join(str(i * 37) for i in range(400)) + "]\n") == "data"
    assert reason("a.go", "package a\n\nvar X = []int{\n" + "".join(f"\t{i}, {i * 3},\n" for i in range(200)) + "}\n") == "data"
    assert reason("a.py", None) is None and reason("a.py", "") is None


def test_merkle_ignores_names_and_sees_content(spark):
    leaves = spark.createDataFrame([("a/x", "v/lib/f.js", 1, 500), ("a/x", "v/lib/g.js", 2, 500), ("b/y", "w/q/r.js", 2, 500), ("b/y", "w/q/s.js", 1, 500), ("c/z", "w/q/s.js", 3, 500), ("c/w", "w/q/s.js", 3, 500)], "workspace string, path string, content bigint, chars bigint")
    nodes = {(r.workspace, r.node): r.hash for r in merkle_nodes(leaves).collect()}
    assert nodes["a/x", "v/lib"] == nodes["b/y", "w/q"] != nodes["c/z", "w/q"] and nodes["a/x", "v"] == nodes["b/y", "w"]
    shared = {(r.workspace, r.node) for r in shared_nodes(merkle_nodes(leaves)).collect()}
    assert ("a/x", "v/lib") in shared and ("b/y", "w/q/s.js") in shared and not any(w.startswith("c/") for w, _ in shared)
    assert merkle_nodes(leaves.limit(0)).count() == 0


def test_files(spark):
    patched = LIB.replace("lib7(a) { return a * 7", "lib7(a) { return a * 8")
    corpus = [
        ("a/x", "src/own.py", CODE % (1, 1, 1)), ("a/x", "src/copy.js", LIB), ("b/y", "core/tool.js", LIB), ("c/z", "core/patched.js", patched), ("a/x", "src/again.js", CODE % (2, 2, 2)), ("a/y", "src/again.js", CODE % (2, 2, 2)),
        ("a/x", "vendor/lib/x.go", "package x\n"), ("a/x", "vendor/lib/config.json", "{}"), ("a/x", "src/vendors/x.go", "package y\n"), ("a/x", "src/gen/x.ts", "let a = 1"), ("a/x", "src/x_pb2.py", "a = 1\n"), ("a/x", "src/generators/g.py", "a = 1\n"),
        ("a/x", "src/empty.py", ""), ("b/y", "src/empty.py", ""), ("a/x", "src/null.py", None), (None, "src/n.min.js", "x"), ("a/x", "doc/vendor/readme.md", "hello"),
    ]
    files = [("a/x", "node_modules/never/read.ts"), ("a/x", "src/own.py"), ("a/x", None)]
    got = {(r.workspace, r.path): r.reason for r in not_hand_written(spark.createDataFrame(files, "workspace string, path string"), spark.createDataFrame(corpus, "workspace string, path string, content string")).collect()}
    assert got == {
        ("a/x", "src/copy.js"): "third-party", ("b/y", "core/tool.js"): "third-party", ("c/z", "core/patched.js"): "third-party", ("a/x", "vendor/lib/x.go"): "third-party", ("a/x", "node_modules/never/read.ts"): "third-party",
        ("a/x", "src/gen/x.ts"): "generated", ("a/x", "src/x_pb2.py"): "generated", ("", "src/n.min.js"): "minified",
    }


def test_patched_copies_among_many_holders_of_their_lines(spark):
    def lib(name, lines):
        return "\n".join(f"export function {name}{i}(a) {{ return a * {i} + {i * 7} }}" for i in range(lines))

    def judge(corpus):
        return {(r.workspace, r.path): r.reason for r in not_hand_written(spark.createDataFrame([], "workspace string, path string"), spark.createDataFrame(corpus, "workspace string, path string, content string")).collect()}

    base = lib("f", 40)
    copies = [("a/x", "src/one.js", base.replace("a * 7 ", "a * 8 ")), ("b/x", "src/two.js", base.replace("a * 31 ", "a * 32 "))]
    copied = {("a/x", "src/one.js"): "third-party", ("b/x", "src/two.js"): "third-party"}
    # bundles hold the same lines but are no partners of like size
    assert judge(copies + [(f"o{i}/x", "src/bundle.js", base + "\n" + lib(f"b{i}_", 150)) for i in range(20)]) == copied
    # older versions share half of the lines, with the copies and with one another, and their own half with none
    assert judge(copies + [(f"o{i}/x", "src/older.js", "\n".join(base.split("\n")[20 * (i % 2) :][:20]) + "\n" + lib(f"old{i}_", 20)) for i in range(20)]) == copied


def test_a_chain_of_versions_is_found_whole(spark):
    """Twelve owners hold successive versions of one file: each shares enough with its neighbours only."""
    lines = [f"export function step{i}(a) {{ return a * {i} + {i * 7} }}" for i in range(80)]
    corpus = []
    for owner in range(12):
        for k in range(4):
            lines[(owner * 4 + k) * 7 % 80] = f"export function step{owner}_{k}(b) {{ return b - {owner * 5 + k} }}"
        corpus.append((f"o{owner}/x", f"src/v{owner}.js", "\n".join(lines)))
    shingles = [{tuple(t.split("\n")[i : i + 3]) for i in range(78)} for _, _, t in corpus]
    want = {c[:2] for i, c in enumerate(corpus) if any(i != j and len(shingles[i] & shingles[j]) >= 0.7 * len(shingles[i]) for j in range(12))}
    # a popular library of other lines, and a bundle that holds the whole first version and much else
    library = "\n".join(f"function lib{i}(x) {{ return x + {i} }}" for i in range(60))
    others = [(f"p{i}/x", "src/lib.js", library + f"\n// {i}") for i in range(6)] + [("q/x", "src/bundle.js", corpus[0][2] + "\n" + "\n".join(f"let z{i} = {i * 3}" for i in range(400)))]
    got = {(r.workspace, r.path) for r in not_hand_written(spark.createDataFrame([], "workspace string, path string"), spark.createDataFrame(corpus + others, "workspace string, path string, content string")).collect()}
    assert len(want) >= 11 and got == want | {o[:2] for o in others[:6]}


def test_spread_shingles_are_held_by_the_same_texts(spark, monkeypatch):
    import random

    from lodestone.llm import provenance as pv

    rng = random.Random(2)
    rows = [(i, 500, i % 3 if i % 5 else 7, i % 3 if i % 5 else 7, sorted({1, *(rng.randrange(2, 90) for _ in range(4))})) for i in range(700)]
    texts = spark.createDataFrame(rows, "content bigint, chars bigint, lo bigint, hi bigint, shingles array<bigint>")
    of = {}
    for content, _, lo, hi, shingles in rows:
        for x in shingles:
            of.setdefault(x, []).append((content, lo))
    want = sorted((content, x, len(held)) for x, held in of.items() if len({o for _, o in held}) > 1 for content, _ in held)
    for often in (10**9, 1):
        monkeypatch.setattr(pv, "SAMPLED_OFTEN", often)
        assert sorted((r.content, r.shingle, r.n) for r in pv._held_between_owners(texts).collect()) == want
