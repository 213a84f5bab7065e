"""Line scanners that turn source text into symbols, import edges and call edges, and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import extension, identifier_tokens

MAX_SIGNATURE = 240
_NAME = "[A-Za-z_][A-Za-z0-9_]*"
_CALL = rf"(?:^|[^A-Za-z0-9_])({_NAME}(?:\.{_NAME})?)[ \t]*\("
SCRIPTS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
# Extensions tried for a relative import, in this order.
IMPORT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".json")


def source_lines(files: DataFrame, *extensions: str) -> DataFrame:
    """(workspace, path, ext, line, text, before) of the files with these extensions, ``before`` being the line above;
    lines keep no carriage return. The texts are split once, and no line is shuffled.
    """
    ext = extension(F.col("path"))
    lines = F.transform(F.split("content", "\n"), lambda x: F.rtrim(x, F.lit("\r")))
    zipped = F.arrays_zip(lines.alias("text"), F.concat(F.array(F.lit("")), lines).alias("before"))
    rows = files.where(ext.isin(*extensions)).select("workspace", "path", ext.alias("ext"), F.posexplode(zipped).alias("i", "x"))
    return rows.select("workspace", "path", "ext", (F.col("i") + 1).alias("line"), "x.text", "x.before").where("text is not null")


def _symbols(lines: DataFrame, cases: list[tuple[str, str, int]]) -> DataFrame:
    """The first case (regex, kind, group) that a line matches names its symbol."""
    kind = name = None
    for regex, label, group in cases:
        hit = F.col("text").rlike(regex)
        kind = F.when(hit, label) if kind is None else kind.when(hit, label)
        found = F.regexp_extract("text", regex, group)
        name = F.when(hit, found) if name is None else name.when(hit, found)
    return _described(lines.withColumn("kind", kind).withColumn("name", name).where("kind is not null"))


def _described(named: DataFrame) -> DataFrame:
    return named.select("workspace", "path", "name", "kind", "line", F.col("line").alias("end_line"), F.substring(F.trim("text"), 1, MAX_SIGNATURE).alias("signature"), identifier_tokens(F.col("name")).alias("tokens"))


_PY_DEF = rf"^[ \t]*(?:async[ \t]+)?def[ \t]+({_NAME})[ \t]*\("
_PY_CLASS = rf"^[ \t]*class[ \t]+({_NAME})[ \t]*[:(]"
_GO_FUNC = rf"^func[ \t]+(?:\([^)]+\)[ \t]*)?({_NAME})[ \t]*\("
_GO_TYPE = rf"^type[ \t]+({_NAME})[ \t]+"
_TS = [
    (rf"^(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*({_NAME})", "function", 1),
    (rf"^(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+({_NAME})", "class", 1),
    (rf"^(?:export[ \t]+)?interface[ \t]+({_NAME})", "interface", 1),
    (rf"^(?:export[ \t]+)?type[ \t]+({_NAME})[^=]*=", "type", 1),
    (rf"^(?:export[ \t]+)?const[ \t]+({_NAME})", "const", 1),
    (rf"^(?:export[ \t]+)?(?:let|var)[ \t]+({_NAME})", "variable", 1),
]


def python_symbols(files: DataFrame) -> DataFrame:
    """Functions and classes of Python files, one for each line that defines one."""
    return _symbols(source_lines(files, "py"), [(_PY_DEF, "function", 1), (_PY_CLASS, "class", 1)])


def go_symbols(files: DataFrame) -> DataFrame:
    """Functions, methods and types of Go files."""
    return _symbols(source_lines(files, "go"), [(_GO_FUNC, "function", 1), (_GO_TYPE, "type", 1)])


_TS_CLASS = _TS[1][0]
#: A method: at most four blanks or one tab deep, modifiers, its name and parameters, and an opening brace.
_MEMBER = rf"^(?: {{1,4}}|\t)(?:(?:public|private|protected|static|async|override|readonly)[ \t]+)*\*?({_NAME})[ \t]*(?:<[^<>()]*>)?\(.*\)[ \t]*(?::[^={{]+)?\{{"
#: Words that stand before a parenthesis without being called.
KEYWORDS = "if for while switch catch with function return typeof await async export default else do case throw yield void delete in of import super new get set static const let var class extends instanceof constructor".split()


def script_symbols(files: DataFrame) -> DataFrame:
    """Functions, classes, interfaces, types, constants and variables at the top level of JavaScript and TypeScript
    files, and methods of top-level classes as ``Class.method``, each by its line.

    Of all lines only those that open or close a class and those that look like a method meet in the
    window that finds a method's class.
    """
    lines = source_lines(files, *SCRIPTS)
    opened, closed = F.regexp_extract("text", _TS_CLASS, 1), F.col("text").startswith("}")
    member = F.regexp_extract("text", _MEMBER, 1)
    marked = lines.select("workspace", "path", "line", "text", F.when(opened != "", opened).when(closed, F.lit("")).alias("holder"), member.alias("member"))
    marked = marked.where("holder is not null or member != ''").where(~F.col("member").isin(*KEYWORDS))
    within = Window.partitionBy("workspace", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    methods = marked.withColumn("class", F.last("holder", True).over(within)).where("member != '' and class != ''")
    named = methods.withColumn("name", F.concat("class", F.lit("."), "member")).withColumn("kind", F.lit("method"))
    return _symbols(lines, _TS).unionByName(_described(named))


def import_edges(files: DataFrame) -> DataFrame:
    """(workspace, from_path, to_specifier, line) of Python, Go, JavaScript and TypeScript imports, in one pass over the lines.

    Python gives the module of a from-import, else the rest of the line; Go the first quoted line
    after ``import (``; scripts the quoted specifier of import and re-export lines.
    """
    text, ext = F.col("text"), F.col("ext")
    regex = r"^[ \t]*(?:from[ \t]+([^ \t]+)[ \t]+)?import[ \t]+(.+)$"
    module = F.nullif(F.regexp_extract("text", regex, 1), F.lit(""))
    python = F.when(text.rlike(regex) & ~text.rlike(_PY_DEF) & ~text.rlike(_PY_CLASS), F.trim(F.coalesce(module, F.regexp_extract("text", regex, 2))))
    quoted = r'^[ \t]*"([^"]+)"[ \t]*$'
    go = F.when(text.rlike(quoted) & F.col("before").rlike(r"import[ \t]*\("), F.regexp_extract("text", quoted, 1))
    spec = r"""^(?:import|export)[ \t{*].*?["']([^"']+)["'];?[ \t]*$"""
    script = F.when(text.rlike(spec) & text.rlike("(from|import)[ \t]*[\"']"), F.regexp_extract("text", spec, 1))
    found = F.when(ext == "py", python).when(ext == "go", go).otherwise(script)
    lines = source_lines(files, "py", "go", *SCRIPTS)
    return lines.select("workspace", F.col("path").alias("from_path"), found.alias("to_specifier"), "line").where("to_specifier is not null")


#: What a script line loses before its calls are read, in this order: strings, comments, optional chaining, functions and
#: constructors that are named but not called; and a blank behind every parenthesis, so that one match does not take the next one's start.
_STRIPPED = [
    (r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`\\]|\\.)*`", "''"), (r"//.*$|/\*.*?\*/", ""), (r"^[ \t]*/?\*.*$", ""), (r"\?\.", "."),
    (rf"(^|[^A-Za-z0-9_$.])(?:function[ \t]*\*?[ \t]*(?:{_NAME})?|new[ \t]+[A-Za-z0-9_$.]+)", "$1"), (r"\(", "( "),
]
#: A called name with what stands before its dots; behind a closing parenthesis or bracket the name alone.
_SCRIPT_CALL = r"(?:^|[^A-Za-z0-9_$.]|[)\]]\.)([A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*)[ \t]*(?:<[^<>()]*>)?\("


def _stripped(text: Column) -> Column:
    for pattern, instead in _STRIPPED[:-1]:
        text = F.regexp_replace(text, pattern, instead)
    return text


def _called_names(chains: Column) -> Column:
    """``a`` or ``a.b``; of longer chains and of ``this`` the last name; keywords are left out."""
    parts = F.transform(chains, lambda c: F.split(c, r"\."))
    called = F.filter(parts, lambda x: ~F.element_at(x, -1).isin(*KEYWORDS) & ((F.size(x) > 1) | (x[0] != "this")))
    return F.transform(called, lambda x: F.when((F.size(x) == 2) & ~x[0].isin("this", "super"), F.array_join(x, ".")).otherwise(F.element_at(x, -1)))


def call_edges(files: DataFrame) -> DataFrame:
    """(workspace, from_path, to_name, line): calls, in one pass over the lines.

    Of each Python and Go line that defines nothing the first call, of a JavaScript or TypeScript line all. A line
    scanner: calls within template strings are not seen, nor is a method's definition, and block comments are
    known by their leading asterisk.
    """
    text, ext = F.col("text"), F.col("ext")
    lines = source_lines(files, "py", "go", *SCRIPTS).where(F.contains("text", F.lit("(")))
    # step by step, so that what a script line is stripped to is worked out once
    coded = lines.select("workspace", "path", "line", "text", "ext", F.when(ext.isin(*SCRIPTS), _stripped(text)).alias("code"))
    headed = coded.withColumn("head", F.regexp_extract("code", _MEMBER, 1))
    head = rf"^[ \t]*(?:[a-z]+[ \t]+)*\*?{_NAME}[ \t]*(?:<[^<>()]*>)?\("
    bodied = headed.withColumn("code", F.when((F.col("head") != "") & ~F.col("head").isin(*KEYWORDS), F.regexp_replace("code", head, "(")).otherwise(F.col("code")))
    chained = bodied.withColumn("chains", F.regexp_extract_all(F.regexp_replace("code", *_STRIPPED[-1]), F.lit(_SCRIPT_CALL), F.lit(1))).withColumn("name", F.when(F.col("code").isNull(), F.regexp_extract("text", _CALL, 1)))
    name = F.col("name")
    python = F.when(~name.isin("", "def", "class", "if", "for", "while", "return") & ~text.rlike(_PY_DEF) & ~text.rlike(_PY_CLASS), F.array(name))
    go = F.when(~name.isin("", "func") & ~text.rlike(_GO_FUNC), F.array(name))
    found = F.when(ext == "py", python).when(ext == "go", go).otherwise(_called_names(F.col("chains")))
    return chained.select("workspace", F.col("path").alias("from_path"), F.explode(found).alias("to_name"), "line")


def _normal(path: Column) -> Column:
    """A slash-joined path without ``.`` and with ``..`` resolved."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = lambda a: F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", up(a)).otherwise(F.concat(a, F.array(x)))), "/")


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(workspace, from_path, to_specifier, line, to_path): relative imports resolved to known files; others null.

    Candidates in order: the path itself, with each extension, with a script extension replaced, and
    its index files; the first that is a known file of the workspace.
    """
    folder = F.regexp_replace("from_path", "[^/]*$", "")
    joined = F.when(F.col("to_specifier").startswith("/"), F.col("to_specifier")).otherwise(F.concat(folder, "to_specifier"))
    keyed = edges.withColumn("base", F.when(F.col("to_specifier").rlike(r"^(/|\.\.?/|\.\.?$)"), _normal(joined)))
    bare = F.regexp_replace("base", r"\.(js|jsx|mjs|cjs)$", "")
    candidates = [F.col("base"), *[F.concat("base", F.lit(e)) for e in IMPORT_EXTENSIONS], *[F.when(bare != F.col("base"), F.concat(bare, F.lit(e))) for e in IMPORT_EXTENSIONS], *[F.concat("base", F.lit("/index" + e)) for e in IMPORT_EXTENSIONS]]
    tried = keyed.where("base is not null").select("workspace", "from_path", "to_specifier", "line", F.posexplode(F.array(*candidates)).alias("ord", "path")).where("path is not null")
    known = tried.join(files.select("workspace", "path").distinct(), ["workspace", "path"])
    first = known.groupBy("workspace", "from_path", "to_specifier", "line").agg(F.min_by("path", "ord").alias("to_path"))
    return edges.join(first, ["workspace", "from_path", "to_specifier", "line"], "left")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, most: int = 8) -> DataFrame:
    """(workspace, from_path, to_name, line, to_path): the file that a call most likely enters, or null.

    Candidates define the called name or a member of that name, within the workspace. The only candidate
    wins; of several the caller's own file, then an imported one. A name with more than ``most``
    candidate files is resolved by the same two rules, through joins instead of a list.
    """
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    asked = calls.withColumn("key", last(F.col("to_name")))
    own = symbols.select("workspace", F.col("path").alias("to_path"), F.col("name").alias("symbol"), last(F.col("name")).alias("key")).distinct()
    # sizes first: a name that thousands of files define is never expanded against all its calls
    matching = (F.col("symbol") == F.col("to_name")) | F.col("symbol").endswith(F.concat(F.lit("."), F.col("to_name")))
    names = asked.select("workspace", "to_name", "key").distinct().join(own, ["workspace", "key"]).where(matching)
    only = names.groupBy("workspace", "to_name").agg(F.countDistinct("to_path").alias("n"), F.min("to_path").alias("single"))
    pairs = names.select("workspace", "to_name", "to_path").distinct()
    called = asked.select("workspace", "from_path", "to_name").distinct()
    same = called.join(pairs.withColumnRenamed("to_path", "from_path"), ["workspace", "from_path", "to_name"]).withColumn("same", F.col("from_path"))
    reached = imports.where("to_path is not null").select("workspace", "from_path", "to_path").distinct()
    imported = called.join(reached, ["workspace", "from_path"]).join(pairs, ["workspace", "to_name", "to_path"]).groupBy("workspace", "from_path", "to_name").agg(F.min("to_path").alias("imported"))
    out = asked.join(only, ["workspace", "to_name"], "left").join(same, ["workspace", "from_path", "to_name"], "left").join(imported, ["workspace", "from_path", "to_name"], "left")
    return out.select("workspace", "from_path", "to_name", "line", F.when(F.col("n") == 1, F.col("single")).otherwise(F.coalesce("same", "imported")).alias("to_path"))


def build_chunks(symbols: DataFrame, files: DataFrame, most_doc: int = 8, most_body: int | None = None) -> DataFrame:
    """(id, workspace, path, start_line, end_line, header, text) of every symbol.

    Text: ``path > name(signature)`` of at most 300 characters, up to 8 comment lines that stand above the
    symbol (blank ones between it and them are passed over), and its lines; the body may be capped.
    """
    lines = files.select("workspace", "path", F.transform(F.split("content", "\n"), lambda x: F.rtrim(x, F.lit("\r"))).alias("lines"))
    joined = symbols.join(lines, ["workspace", "path"])
    header = F.substring(F.concat("path", F.lit(" > "), "name", F.lit("("), F.coalesce("signature", F.lit("")), F.lit(")")), 1, 300)
    above = F.reverse(F.slice("lines", F.greatest(F.col("line") - 16, F.lit(1)), F.least(F.col("line") - 1, F.lit(16))))
    # state: taken comment lines (nearest first), whether a comment was met, whether the run has ended
    start = F.struct(F.array().cast("array<string>").alias("doc"), F.lit(False).alias("begun"), F.lit(False).alias("ended"))

    def step(a: Column, x: Column) -> Column:
        comment = F.trim(x).rlike(r"^(//|#|/\*|\*|\"\"\")")
        blank = F.trim(x) == ""
        takes = ~a.ended & comment & (F.size(a.doc) < most_doc)
        return F.struct(F.when(takes, F.concat(a.doc, F.array(x))).otherwise(a.doc).alias("doc"), (a.begun | takes).alias("begun"), (a.ended | (~comment & ~(blank & ~a.begun))).alias("ended"))

    doc = F.array_join(F.reverse(F.aggregate(above, start, step, lambda a: a.doc)), "\n")
    body = F.array_join(F.slice("lines", "line", F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(1))), "\n")
    body = body if most_body is None else F.substring(body, 1, most_body)
    text = F.array_join(F.filter(F.array(header, doc, body), lambda x: x != ""), "\n")
    return joined.select("id", "workspace", "path", F.col("line").alias("start_line"), "end_line", header.alias("header"), text.alias("text"))


def changed_lines(old: DataFrame, new: DataFrame, *extensions: str) -> DataFrame:
    """(workspace, path, line) of lines of the new texts that the old text of the same file does not hold; of files that have both."""
    before, after = (source_lines(df, *extensions).select("workspace", "path", "line", "text") for df in (old, new))
    both = after.join(old.select("workspace", "path").distinct(), ["workspace", "path"], "left_semi")
    return both.join(before.select("workspace", "path", "text"), ["workspace", "path", "text"], "left_anti").select("workspace", "path", "line")


def hunk_lines(diffs: DataFrame, text_col: str = "diff") -> DataFrame:
    """(workspace, path, line) of the new lines that unified diffs without context name; a hunk that only removes names the line before it.

    diffs (workspace, diff) hold one text each: ``+++ b/path`` lines and ``@@ -a,b +c,d @@`` headers; removed
    files (``+++ /dev/null``) give nothing.
    """
    parts = F.split(F.col(text_col), r"(?m)^(?=\+\+\+ )")
    files = diffs.select("workspace", F.explode(parts).alias("part")).select("workspace", "part", F.regexp_extract("part", r"^\+\+\+ b/([^\t\r\n]+)", 1).alias("path")).where("path != ''")
    header = r"(?m)^@@ -\d+(?:,\d+)? (\+\d+(?:,\d+)?) @@"
    hunks = files.select("workspace", "path", F.explode(F.regexp_extract_all("part", F.lit(header), F.lit(1))).alias("h"))
    start = F.regexp_extract("h", r"\+(\d+)", 1).cast("int")
    size = F.coalesce(F.nullif(F.regexp_extract("h", r",(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    return hunks.select("workspace", "path", F.explode(F.sequence(start, start + F.greatest(size, F.lit(1)) - 1)).alias("line")).distinct()


def changed_symbols(changes: DataFrame, symbols: DataFrame, most: int = 6) -> DataFrame:
    """(workspace, path, name, line): symbols whose lines hold a changed line, at most ``most`` for each file.

    changes (workspace, path, line) are points, symbols ranges: an equi-join on the file with the range as residue.
    """
    met = symbols.join(changes.select("workspace", "path", F.col("line").alias("at")), ["workspace", "path"]).where("at between line and end_line")
    distinct = met.select("workspace", "path", "name", "line").distinct()
    order = Window.partitionBy("workspace", "path").orderBy("line", "name")
    return distinct.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
