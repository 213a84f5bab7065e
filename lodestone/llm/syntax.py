"""Source files that do not parse: recognition of whole files by generalised LL.

A file is scanned once, its brackets (Python: also its lines and blocks) are nested, and each group
is recognised on its own as everything it could be; the result stands for the group one level up.
Groups with the same inside are recognised once for each worker: most lines of most files have been
seen before. The dialects of a language (module, script, CommonJS) start together on one stack
graph, and a file counts as invalid when none of them accepts it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import grammars, scanners
from lodestone.llm.gll import LINE_START, Grammar

#: Tokens that the memory of recognised groups may hold for each language before it is emptied.
MEMORY_TOKENS = 6_000_000
#: Longer groups are first tried piece by piece at their separators.
SPLIT_FROM = 16

# The language that an extension claims, and its dialects.
LANGUAGE_OF = {"py": "python", "ts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "json": "json"}
DIALECTS = {"ts": ("Items", "Script"), "js": ("Items", "Script"), "mjs": ("Items",), "cjs": ("CommonScript", "Script"), "py": ("File",), "go": ("File",), "json": ("File",)}

_JS_INSIDE = {
    "(": {"Args": ["(Args"], "Paren": ["(Paren"], "Params": ["(Params"], "ForHead": ["(For"], "Catch": ["(Catch"]},
    "[": {"Array": ["[Array"], "Index": ["[Index"], "Pat_list": ["[Pat"]},
    "{": {"Object": ["{Object"], "Pat_object": ["{Pat"], "Specs": ["{Specs"], "ClassBody": ["{Class"], "Stmts": ["{Fn", "{Block", "{BlockFn"], "StmtsFn": ["{Fn", "{BlockFn"], "Switch": ["{Switch", "{SwitchFn"], "SwitchFn": ["{SwitchFn"]},
    "`": {"Template": ["Tpl"]},
}
_TS_INSIDE = {
    "(": _JS_INSIDE["("] | {"PType": ["(PType"]},
    "[": _JS_INSIDE["["] | {"Tuple": ["[Tuple"], "IndexType": ["[IndexType"], "IndexSig": ["[IndexSig"], "MapKey": ["[MapKey"]},
    "{": _JS_INSIDE["{"] | {"TypeBody": ["{Type"], "MappedBody": ["{Mapped"], "EnumBody": ["{Enum"], "Items": ["{Module"]},
    "`": {"Template": ["Tpl"], "Type_template": ["TypeTpl"]},
}
_PY_LINES = {"Simple_line": "Simple", "If_line": "If", "Elif_line": "Elif", "Else_line": "Else", "While_line": "While", "For_line": "For", "Try_line": "Try", "Except_line": "Except", "Finally_line": "Finally", "With_line": "With", "Def_line": "Def", "Class_line": "Class", "Deco_line": "Deco", "Match_line": "Match", "Case_line": "Case"}
_PY_INSIDE = {
    "(": {"Group": ["(Group"], "Args": ["(Args"], "Params": ["(Params"], "Target": ["(Target"], "Names": ["(Names"], "With": ["(With"], "Gpat": ["(Gpat"], "Cpat": ["(Cpat"]},
    "[": {"List": ["[List"], "Index": ["[Index"], "Target": ["[Target"], "TypeParams": ["[TypeParams"], "Gpat": ["[Gpat"]},
    "{": {"Dict": ["{Set"], "Set": ["{Set"], "Mpat": ["{Mpat"]},
    "IN": {"Block": ["Blk"], "Cases": ["CaseBlk"]},
}
_GO_INSIDE = {
    "(": {x: [f"({x}"] for x in ("Params", "Args", "Paren", "TypeParen", "TypeKey", "Imports", "Vars", "Consts", "Types")},
    "[": {x: [f"[{x}"] for x in ("Len", "Auto", "TypeArgs", "Index", "TypeParams")},
    "{": {x: ["{" + x] for x in ("Block", "Struct", "Interface", "Composite", "Cases")},
}
_JSON_INSIDE = {"{": {"Object": ["{Object"]}, "[": {"Array": ["[Array"]}}
#: Rules whose strings stay in the rule when joined behind a separator.
_SPLIT = {
    "Stmts": ";", "StmtsFn": ";", "Items": ";", "Script": ";", "CommonScript": ";", "Block": ";", "Array": ",", "Object": ",", "Args": ",", "List": ",", "Dict": ",", "Set": ",", "Composite": ",",
}
_SETUP = {
    "javascript": (grammars.JAVASCRIPT, _JS_INSIDE, scanners.scan_js, {"[": "[Empty"}),
    "typescript": (grammars.TYPESCRIPT, _TS_INSIDE, scanners.scan_js, {"[": "[Empty"}),
    "python": (grammars.PYTHON, _PY_INSIDE, scanners.scan_python, {}),
    "go": (grammars.GO, _GO_INSIDE, scanners.scan_go, {"[": "[Empty"}),
    "json": (grammars.JSON, _JSON_INSIDE, scanners.scan_json, {}),
}


class Recogniser:
    """Recognises files of one language; remembers the groups it has seen."""

    def __init__(self, language: str):
        text, self.inside, self.scan, self.empty = _SETUP[language]
        self.grammar = Grammar(text)
        self.language = language
        self.token_class: dict[tuple[str, bool], int] = {}
        self.clear()
        self.separators = {mark: frozenset((self._class(mark, False), self._class(mark, True))) for mark in (";", ",")}
        self.colon = self._class(":", False)
        self.comprehension = self._class("for", False)
        self.ordered = frozenset((self._class("=", False), self._class("**", False)))

    def clear(self) -> None:
        self.memory: dict[tuple, object] = {}
        self.held = 0

    def _class(self, kind: str, newline: bool) -> int:
        key = (kind, newline)
        number = self.token_class.get(key)
        if number is None:
            number = self.token_class[key] = self.grammar.cls(frozenset([kind, LINE_START] if newline else [kind]))
        return number

    def _accepts(self, names: tuple[str, ...], inside: tuple[int, ...]) -> frozenset[str]:
        """The rules among ``names`` that derive ``inside``; long ones piece by piece where that decides."""
        done = set()
        if len(inside) > SPLIT_FROM:
            for name in names:
                mark = _SPLIT.get(name)
                if mark and self._by_pieces(name, inside, self.separators[mark]):
                    done.add(name)
        rest = tuple(n for n in names if n not in done and not (n == "StmtsFn" and "Stmts" in done))
        return frozenset(done) | (self.grammar.recognise(rest, inside) if rest else frozenset())

    def _by_pieces(self, name: str, inside: tuple[int, ...], marks: frozenset[int]) -> bool:
        if self.language == "python" and (self.comprehension in inside or name == "Args" and not self.ordered.isdisjoint(inside)):
            return False  # what may follow depends on what came before
        memory, begin = self.memory, 0
        for at, token in enumerate(inside):
            if token in marks or at == len(inside) - 1:
                piece = inside[begin : at + 1]
                begin = at + 1
                key = (name, piece)
                known = memory.get(key)
                if known is None:
                    known = memory[key] = bool(self.grammar.recognise((name,), piece))
                    self.held += len(piece)
                if not known:
                    return False
        return True

    def group(self, bracket: str, inside: tuple[int, ...], newline: bool) -> int:
        """The class of a bracketed group."""
        key = (bracket, inside)
        terms = self.memory.get(key)
        if terms is None:
            rules = self.inside[bracket]
            names = tuple(rules)
            if "StmtsFn" in rules and not any(self._returns(t) for t in inside):
                names = tuple(n for n in names if n not in ("StmtsFn", "SwitchFn"))
            found = {t for rule in self._accepts(names, inside) for t in rules[rule]} | {bracket}
            if not inside and bracket in self.empty:
                found.add(self.empty[bracket])
            terms = self.memory[key] = (self.grammar.cls(frozenset(found)), self.grammar.cls(frozenset(found | {LINE_START})))
            self.held += len(inside)
        return terms[newline]

    def _returns(self, token: int) -> bool:
        terms = self.grammar.classes[token]
        return "return" in terms or ("{Fn" in terms or "{SwitchFn" in terms) and "{Block" not in terms and "{Switch" not in terms

    def line(self, inside: tuple[int, ...]) -> int:
        """The class of a logical line of Python; a header that ends in its colon needs a block."""
        key = ("line", inside)
        known = self.memory.get(key)
        if known is None:
            bare = inside[-1] == self.colon
            found = self._accepts(tuple(_PY_LINES), inside)
            known = self.memory[key] = self.grammar.cls(frozenset(_PY_LINES[x] + ("" if bare or x in ("Simple_line", "Deco_line", "Match_line") else "1") for x in found) | {"line"})
            self.held += len(inside)
        return known

    def accepted_by(self, text: str, dialects: tuple[str, ...]) -> frozenset[str]:
        """The dialects that accept the text."""
        if self.held > MEMORY_TOKENS:
            self.clear()
        found = self._accepted(text, dialects, self.scan)
        if not found and self.language == "python" and _F_STRING.search(text):
            found = self._accepted(text, dialects, lambda t: scanners.scan_python(t, nested=True))
        return found

    def _accepted(self, text: str, dialects: tuple[str, ...], scan: Callable[[str], list]) -> frozenset[str]:
        try:
            tokens = scan(text)
        except scanners.ScanError:
            return frozenset()
        classes = self.token_class
        stack: list[list[int]] = [[]]
        opened: list[tuple[str, bool]] = []
        top = stack[0]
        python = self.language == "python"
        for kind, _, newline in tokens:
            if kind in _OPENS:
                opened.append((kind, newline))
                top = []
                stack.append(top)
            elif kind in _SHUTS:
                inside = stack.pop()
                bracket, began = opened.pop()
                if kind == "tpl`":
                    inside = inside[:-1]
                top = stack[-1]
                if kind == "tpl`" and not inside:
                    top.append(self._template(began))
                else:
                    top.append(self.group(bracket, tuple(inside), began))
            elif kind == "NL":
                # the line's tokens stand behind the lines and blocks of its block
                first = len(top)
                while first and top[first - 1] not in self.rows:
                    first -= 1
                row = self.line(tuple(top[first:]))
                self.rows.add(row)
                del top[first:]
                top.append(row)
            elif kind == "${":
                continue
            else:
                token = classes.get((kind, newline))
                top.append(self._class(kind, newline) if token is None else token)
            if python and kind == "OUT":
                self.rows.add(top[-1])
        whole = tuple(stack[0])
        if self.language == "go" or python or self.language == "json":
            return self.grammar.recognise(dialects, whole)
        return self._accepts(dialects, whole)

    @property
    def rows(self) -> set[int]:
        """Classes of finished lines and blocks."""
        if not hasattr(self, "_rows"):
            self._rows: set[int] = set()
        return self._rows

    def _template(self, newline: bool) -> int:
        return self.grammar.cls(frozenset(["Tpl", "TypeTpl", LINE_START] if newline else ["Tpl", "TypeTpl"]))


_F_STRING = re.compile(r"\b[rR]?[fFtT][rR]?[\"']")
_OPENS = frozenset(["(", "[", "{", "`", "IN"])
_SHUTS = frozenset([")", "]", "}", "tpl`", "OUT"])
_RECOGNISERS: dict[str, Recogniser] = {}


def extension(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower()


def is_valid(path: str, text: str | None) -> bool | None:
    """Whether the text is a program of the language of the path's extension; None where that is not judged.

    A null text counts as empty; empty and blank texts are valid except as Go or JSON.
    """
    kind = extension(path)
    language = LANGUAGE_OF.get(kind)
    if language is None:
        return None
    if language not in _RECOGNISERS:
        _RECOGNISERS[language] = Recogniser(language)
    return bool(_RECOGNISERS[language].accepted_by(text or "", DIALECTS[kind]))


def judge_files(corpus: DataFrame, path_col: str = "path", text_col: str = "content", key_cols: tuple[str, ...] = ("workspace",)) -> DataFrame:
    """(keys, path, language, valid) of every file whose extension claims a judged language.

    One row for each input row; give it current versions only. Null paths are not judged, a null
    text counts as empty, and further columns are not read. Files go to the tasks as they are
    stored; nothing is shuffled.
    """
    ext = F.lower(F.regexp_extract(F.col(path_col), r"\.([^./]+)$", 1))
    chosen = corpus.where(ext.isin(*LANGUAGE_OF)).select(*key_cols, F.col(path_col).alias("path"), F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(batch.num_columns - 2).to_pylist()
            valid = [is_valid(p, t) for p, t in zip(paths, batch.column(batch.num_columns - 1).to_pylist())]
            languages = [LANGUAGE_OF[extension(p)] for p in paths]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(languages), pa.array(valid, pa.bool_())], names=[*batch.schema.names[:-1], "language", "valid"])

    return chosen.mapInArrow(run, f"{kinds}, language string, valid boolean")


def invalid_rates(judged: DataFrame) -> DataFrame:
    """(workspace, language, n_files, n_invalid, rate): rates of invalid files; rate has six decimals."""
    invalid = F.sum(F.when(F.col("valid"), 0).otherwise(1))
    return judged.groupBy("workspace", "language").agg(F.count("*").alias("n_files"), invalid.alias("n_invalid"), F.round(invalid / F.count("*"), 6).alias("rate"))
