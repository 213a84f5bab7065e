"""Splitting: natural boundaries of small symbols, and what holds for all pieces."""

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.splitting import chunk_boundaries, chunk_pieces, grade_lines, split_text
from lodestone.sources.tables import table

PY = """a.py > C()
# a comment

class C:
    def f(self):
        x = '''

    not here
        '''

        return (

            x)

    # between

    def g(self):
        if x:

            y

        z

    @deco
    def h(self): pass
"""
TS = """a.ts > C()
class C {
  async f(a: string) {

    const s = `

  not here ${a}
`;
  }

  /* comment

  not here */
  x = {

    y: 1,
  };

  g() {}

}
"""


def natural(path, text):
    return [i + 1 for i, g in enumerate(grade_lines(path, text.split("\n")[0], text)[1]) if g == 4]


def lines(text, *starts):
    return [i for i, line in enumerate(text.split("\n"), 1) if line.strip() in starts]


def test_python_boundaries():
    assert natural("a.py", PY) == lines(PY, "# between", "def g(self):", "@deco")


def test_typescript_boundaries():
    assert natural("a.ts", TS) == lines(TS, "/* comment", "g() {}")


def test_go_struct_and_function():
    text = "a.go > T\ntype T struct {\n\tA int\n\n\tB map[string]struct {\n\n\t\tC int\n\t}\n\n\t// c\n\tD int\n}"
    assert natural("a.go", text) == [5, 10]
    text = "a.go > f\nfunc f(\n\ta int,\n) {\n\tx := `\n\n\tno\n`\n\n\tif x {\n\n\t\ty()\n\t}\n}"
    assert natural("a.go", text) == [10]


def test_crlf_and_module_level_data():
    text = "a.py > X\r\nX = {\r\n    'a': 1,\r\n\r\n    'b': [\r\n\r\n        2],\r\n}"
    assert natural("a.py", text) == [5]


def check(text, pieces, limit, overlap):
    assert "".join(p["text"][p["overlap"] :] for p in pieces) == text
    assert all(len(p["text"]) <= limit and 0 <= p["overlap"] <= overlap for p in pieces)
    for before, piece in zip(pieces, pieces[1:]):
        assert before["text"].endswith(piece["text"][: piece["overlap"]])


@given(st.lists(st.sampled_from(["", "  ", "def f():", "    x = 1", "    '''", "}", "{", "\U0001f9ea" * 40, "word " * 30, "\r"]), max_size=120), st.integers(40, 400))
@settings(max_examples=150, deadline=None)
def test_pieces_rejoin(parts, limit):
    text = "\n".join(parts)
    for path in ("a.py", "a.ts", "a.txt"):
        if text:
            check(text, split_text(path, None, text, 1, 9, limit, limit // 4)[1], limit, limit // 4)


def test_one_long_line():
    text = "x" * 50_000
    pieces = split_text("a.ts", None, text, 3, 3)[1]
    check(text, pieces, 1000, 100)
    assert {p["start_line"] for p in pieces} == {3}


def test_tables(spark, data):
    chunks = table(spark, data, "chunks")
    pieces = chunk_pieces(chunks).collect()
    by = {}
    for p in pieces:
        by.setdefault(p.symbol_id, []).append(p)
    texts = {r.symbol_id: r.text for r in chunks.where("length(text) > 0").collect()}
    assert set(by) == set(texts)
    for key, parts in by.items():
        parts = sorted((p.asDict() for p in parts), key=lambda p: p["piece"])
        assert [p["piece"] for p in parts] == list(range(1, len(parts) + 1))
        check(texts[key], parts, 1000, 100)
    long = {k for k, t in texts.items() if len(t) > 1000}
    found = chunk_boundaries(chunks).collect()
    assert {r.symbol_id for r in found} == long and len({tuple(r) for r in found}) == len(found)


def test_edges(spark):
    schema = "symbol_id bigint, path string, header string, text string, start_line int, end_line int, piece int"
    long = "p > f\ndef f():\n" + "".join(f"    x{i} = {i}\n" for i in range(200))
    rows = [(1, "p", None, None, 1, 2, 0), (2, "p", None, "", 1, 2, 0), (3, None, None, "short", None, None, 0), (4, "p.py", "p > f", long, 230, 30, 0), (4, "p.py", "p > f", long, 230, 30, 0), (5, "p.py", "p > f", long, None, 210, 0)]
    df = spark.createDataFrame(rows, schema)
    got = chunk_pieces(df)
    assert {r.symbol_id for r in got.collect()} == {3, 4, 5} and got.count() == got.select("symbol_id", "piece").distinct().count()
    first = got.where("symbol_id = 4 and piece = 1").head()
    assert first.start_line == 29 and got.where("symbol_id = 3").head().start_line is None
    assert {(r.symbol_id, r.text_line) for r in chunk_boundaries(df).collect()} == {(4, 0), (5, 0)}
    assert chunk_pieces(df.limit(0)).count() == 0
