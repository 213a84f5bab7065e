"""Recognition of source files: truth tables, Python and JSON against their own parsers."""

import ast
import json
import random
import warnings

import pytest

from lodestone.llm import grammars
from lodestone.llm.gll import Grammar
from lodestone.llm.syntax import invalid_rates, is_valid, judge_files
from lodestone.sources.tables import current_corpus

GOOD = {
    "a.py": ["", "\n", "x = 1\n", "def f(a, *b, c=1, **d) -> int:\n    return a if b else c\n", "@deco(1)\nasync def f():\n    async with a as b, c:\n        await d\n", "match x:\n    case [1, *_]:\n        pass\n    case {'a': b} | C(d=1) if e:\n        pass\n", "try:\n    a\nexcept (A, B) as e:\n    b\nelse:\n    c\nfinally:\n    d\n", "x: int = [y for y in z if y]\n", "a, *b = c = d\n", "print('a' 'b', *c, **d)\n", "if x: y\nelif z: w\nelse: v\n", "lambda x, *y: (yield)\n", "x[1:2, ::3] += 1; del y[0], z\n", "from . import (a as b, c,)\n", "f'{a!r} {b}'\n", "type X[T] = list[T]\n", "class A[T](B, metaclass=C): pass\n", "if a:\n\tb\n", "f(a, *b, c=1, *d, **e, g=2)\n", "def f(a, /, b=1, *, c, d=2, **e,): pass\n", "def f(*a, b): pass\n", "x = (\n  1\n\n  # c\n)\n", "s = '''a\n\nb'''\n", "a = b if c else lambda: d\n", "\ufeffx = 1\n"],
    "a.ts": ["let x: Map<string, number[]> = new Map<string, number[]>();", "export async function f<T extends A = B>(a?: T, ...b: string[]): Promise<Array<T>> { return a as unknown as T[]; }", "interface A<T> extends B { a: string; b?(x: number): void; readonly [k: string]: any; new (x: A): B }", "type A = { [K in keyof B]?: B[K] } | (C & D) | `a${string}` | ((x: A) => B);", "enum E { A = 1, B, 'c' }", "abstract class A<T> extends B<T> implements C, D { private x?: string = 'a'; constructor(private readonly y: A) { super(); } static get z(): number { return 1 } abstract w(): void; }", "declare module 'x' { export const a: number; }", "const a = b! as const; const c = <T>(x: T) => x;", "function f(this: A): asserts x is B {}", "import type { A } from './a'; export type { A };", "namespace A.B { export const c = 1 }", "let f: new (...a: any[]) => B; let t: [a: string, b?: number, ...c: D[]];", "type X = A extends infer U ? U : never"],
    "a.js": ["", "import a, { b as c } from 'd';\nexport default class extends a {}", "const { a, ...b } = c, [d = 1, , e] = f;", "for (const [k, v] of m) if (k) continue; else break;", "x = a ? b : c => ({ d: e });", "let r = /[\"'{(]+/g.test(`a${b + `c${d}`}e`);", "label: for (;;) { break label }", "async () => { for await (const x of y) await z; }", "a\n++b\nc", "class A { #x = 1; static { this.y = 2 } get z() { return this.#x } *g() { yield* h } async *[i]() {} }", "do x++; while (x < 5)\ny", "switch (a) { case 1: return_(); default: { b } }", "var a = { get: 1, set b(c) {}, async *d() {}, [e]: f, 'g': 1, 2: 3, h() {} }", "!function () { return 1 }()", "a?.b?.[c]?.(d) ?? e", "if (a) { b } /re/.test(c)", "export * as ns from 'x'; import('y').then(z); import.meta.url", "x = a / b / c; y = (a) / b", "try { a } catch { b }"],
    "a.cjs": ["return 1", "module.exports = { a }"],
    "a.go": ["package a\n", 'package a\n\nimport (\n\t"b"\n\t. "c"\n)\n\nfunc (s *T[K]) F(a, b int, c ...string) (d error) {\n\tif x := y(); x != nil {\n\t\treturn x\n\t} else if z {\n\t}\n\tfor i, v := range w {\n\t\t_ = v[i:]\n\t}\n\tswitch t := u.(type) {\n\tcase int, string:\n\t\tbreak\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase d := <-e:\n\t}\n\tdefer func() {}()\n\tgo f(a, b...)\n\tl := map[string][]int{"a": {1, 2}}\n\treturn\n}\n', "package a\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"x\"`\n\t*C\n}\n\ntype I interface {\n\tF(int) string\n\t~int | string\n}\n\nconst (\n\tX = iota\n\tY\n)\n\nvar f = func(a int) int { return a }\n", "package a\nfunc f() { x := []int{1, 2}; for ; ; { break }; L: goto L }\n"],
    "a.json": ['{"a": [1, -2.5e3, true, null, "\\u00e9"], "b": {}}', "[]", '"x"', " 1 "],
}
BAD = {
    "a.py": ["def f(:\n    pass\n", "if x\n    y\n", "if x:\ny\n", "  x\n", "x = (1\n", "x = 1)\n", "a b\n", "x = 'abc\n", "def f():\n    a\n  b\n", "f() = 1\n", "<<<<<<< ours\nx = 1\n", "x = 5f6d\n", "x = 012\n", "class A\n    pass\n", "{1: 2, 3}\n", "try:\n    a\n", "else:\n    a\n", "a → b\n", "x = \x01\n", "'''abc\n", "import\n", "for x y: z\n", "f(a=1, b)\n", "def f(a=1, b): pass\n", "f(**a, *b)\n"],
    "a.ts": ["let x: = 1", "interface A { b: }", "package main\nfunc f() {}", "function f( {}", "type = = 1", "class A { b c d }", "let a = {"],
    "a.js": ["let x: number = 1", "function f( {", "a b", "if (a {", "`abc", "'abc\n'", "x = ;", "}", "<<<<<<< HEAD", "return 1", "let a = /abc", "def f():\n    pass", "class { }", "import { a from 'b'", "a = { b: 1, : 2 }", "a = b /* c", "x /* y"],
    "a.cjs": ["import a from 'b'"],
    "a.go": ["", "func f() {}\n", "package a\nfunc f( {\n}\n", "package a\nvar x = \n", "package a\nfunc f() { if x { }\n", "package a\nfunc f() {\n\tx = (1\n}\n", "package a\nimport b\n", "package a\nfunc f() { a b }\n", "package a\nvar x = y /* z\n"],
    "a.json": ["", "{", '{"a" 1}', "{'a': 1}", "[1,]", "{a: 1}", "NaN", '{"a": 1} x', "// c\n{}", '"a\nb"'],
}


@pytest.mark.parametrize("path", sorted(GOOD))
def test_valid(path):
    assert [t for t in GOOD[path] if not is_valid(path, t)] == []


@pytest.mark.parametrize("path", sorted(BAD))
def test_invalid(path):
    assert [t for t in BAD[path] if is_valid(path, t)] == []


def test_nested_f_strings():
    good = ['f"{a["b"]:{c}} {{x}} {f"{d["e"]}"}"\n', "x = f\'\'\'{a\n}\'\'\' + rf'\\d{1}'\n"]
    assert [t for t in good if not is_valid("a.py", t)] == [] and [t for t in ('f"{a["zz"} c"\n', 'f"{a\n') if is_valid("a.py", t)] == []


def test_other_extensions_are_not_judged():
    assert is_valid("a.md", "(") is None and is_valid("Makefile", "(") is None and is_valid("a.py", None) is True and is_valid("a.go", None) is False


def test_mutations_agree_with_the_parsers(spark, data):
    """Files with a piece cut out, doubled or replaced: the same verdict as Python's and JSON's own parsers."""
    rng = random.Random(11)
    texts = [(r.path, r.content) for r in current_corpus(spark, data).where("path like '%.py' or path like '%.json'").collect() if r.content]
    assert texts
    wrong = []
    for _ in range(400):
        path, text = rng.choice(texts)
        at = rng.randrange(len(text))
        cut = text[:at] + rng.choice(["", ")", ":", "\n", "    ", "def ", "'", ",", "=", "x "]) + text[at + rng.choice([0, 1, 1, 3, 400]) :]
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(cut.lstrip("\ufeff")) if path.endswith(".py") else json.loads(cut.lstrip("\ufeff"))
            valid = True
        except (SyntaxError, ValueError):
            valid = False
        if is_valid(path, cut) != valid:
            wrong.append((path, at, valid))
    assert len(wrong) <= 4, wrong  # checks beyond the grammar, such as a keyword argument given twice


def test_judging_and_rates(spark):
    rows = [("w", "a.py", "x = (", 1), ("w", "b.PY", "x", 1), ("w", "c.md", "(", 1), (None, "d.json", None, 1), ("w", None, "x", 1), ("w", "e.py", "y", 1)]
    df = spark.createDataFrame(rows, "workspace string, path string, content string, valid int")
    got = {(r.workspace, r.path, r.language, r.valid) for r in judge_files(df).collect()}
    assert got == {("w", "a.py", "python", False), ("w", "b.PY", "python", True), (None, "d.json", "json", False), ("w", "e.py", "python", True)}
    assert {(r.workspace, r.language, r.n_files, r.n_invalid) for r in invalid_rates(judge_files(df)).collect()} == {("w", "python", 3, 1), (None, "json", 1, 1)}
    assert judge_files(df.limit(0)).count() == 0


def test_nested_f_strings_end_at_pythons_own_limit():
    quotes = ["'", '"']
    nested = lambda n: "".join(f"f{quotes[i % 2]}{{" for i in range(n)) + "1" + "".join(f"}}{quotes[i % 2]}" for i in reversed(range(n)))
    assert is_valid("a.py", f"x = {nested(40)}\n") and not is_valid("a.py", f"x = {nested(2000)}\n")


def test_automata_have_no_two_states_for_the_same_symbols():
    assert len(Grammar("A = ('a' | 'b')*").edges) == 1
    assert len(Grammar(grammars.TYPESCRIPT).edges) < 4_000  # every worker compiles them
