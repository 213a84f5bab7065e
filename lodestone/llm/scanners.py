"""Lexical scanners for Python, JavaScript/TypeScript, Go and JSON source text.

Each scanner turns a text into tokens ``(kind, start, newline_before)``; brackets, Python's
indentation and JavaScript's template substitutions come as opening and closing tokens that the
caller nests. Comments and white space give no token. ``ScanError`` carries the place where the
text cannot be a program of the language. ``spans`` collects (start, end) of multi-line tokens;
``into`` receives the tokens, also those before an error.
"""

from __future__ import annotations

import re

Token = tuple[str, int, bool]


class ScanError(ValueError):
    def __init__(self, at: int, why: str):
        super().__init__(f"{why} at {at}")
        self.at = at


# The words of each language.
JS_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
JS_CONTEXTUAL = frozenset(
    "async await of get set static let yield as from type interface namespace module declare abstract readonly keyof is infer satisfies public private protected override accessor implements unique asserts out target using global require".split()
)
PY_RESERVED = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
GO_RESERVED = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)

_JS_TOKEN = re.compile(
    r"""([ \t\r\v\f ﻿  -   　]+)   # 1 white space
    |(\n| | )                                                    # 2 line end
    |((?:[^\W\d]|\$)(?:\w|[$‌‍])*)                               # 3 word
    |(//[^\n  ]*)                                                # 4 line comment
    |(/\*[\s\S]*?\*/)                                                      # 5 block comment
    |("(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')   # 6 string
    |((?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*)n?(?![\w$])
      |(?:(?:0[0-9]+|[0-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?(?![\w$])
      |[0-9](?:_?[0-9])*n(?![\w$]))                                        # 7 number
    |(\#(?:[^\W\d]|\$)(?:\w|\$)*)                                          # 8 private name
    |([(\[{])|([)\]}])                                                     # 9 open, 10 close
    |(=>|\.\.\.|\?\.(?![0-9])|>>>=|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|[+\-*/%&|^]=|==|!=|<=|>=|&&|\|\||\?\?|\*\*|\+\+|--|<<|>>>|>>|[;,<>+\-*/%&|^!~?:=.@])  # 11
    |(`)                                                                   # 12 template
    """,
    re.X,
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/(?:\w|\$)*")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_JS_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_JS_BINARY = frozenset("== != === !== <= >= && || ?? ** << / %  ^".split())
_CLOSES = {")": "(", "]": "[", "}": "{"}
#: After these a slash divides; after anything else it starts a regular expression.
_JS_OPERAND_END = frozenset(["id", "num", "str", "tpl`", "regex", "#priv", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"]) | JS_CONTEXTUAL


def scan_js(text: str, spans: list | None = None, into: list | None = None) -> list[Token]:
    """Tokens of JavaScript or TypeScript. Operators of one role share a kind (``aop`` assigns, ``bop`` joins)."""
    out: list[Token] = [] if into is None else into
    at, end, newline, last = 0, len(text), False, ""
    opened: list[tuple[str, bool]] = []  # bracket, and whether what it closes is an operand
    match, add = _JS_TOKEN.match, out.append
    if text.startswith("#!") or text.startswith("﻿#!"):
        at = text.find("\n") if "\n" in text else end
    operand_end = _JS_OPERAND_END
    ended_operand = False
    while at < end:
        m = match(text, at)
        if m is None:
            raise ScanError(at, "no token")
        which, stop = m.lastindex, m.end()
        if which == 1:
            at = stop
            continue
        if which == 2:
            newline = True
            at = stop
            continue
        if which == 3:
            word = m.group(3)
            kind = word if word in JS_RESERVED or word in JS_CONTEXTUAL else "id"
            if last == "." or last == "?.":
                add(("id" if kind in JS_RESERVED else kind, at, newline))
                ended_operand = True
            else:
                add((kind, at, newline))
                ended_operand = kind in operand_end
            last = kind
        elif which == 4:
            at = stop
            continue
        elif which == 5:
            if "\n" in m.group(5):
                newline = True
                if spans is not None:
                    spans.append((at, stop))
            at = stop
            continue
        elif which == 9:
            bracket = m.group(9)
            # a brace after an operator or an opening bracket is an operand, elsewhere a block
            opened.append((bracket, bracket != "{" or (not ended_operand and last in _JS_BEFORE_OBJECT)))
            add((bracket, at, newline))
            last, ended_operand = bracket, False
        elif which == 10:
            bracket = m.group(10)
            if not opened:
                raise ScanError(at, "nothing to close")
            kind, operand = opened.pop()
            if kind == "${":
                if bracket != "}":
                    raise ScanError(at, "mismatched bracket")
                part = _JS_TEMPLATE.match(text, stop)
                if part is None:
                    raise ScanError(at, "template without end")
                if spans is not None:
                    spans.append((stop, part.end()))
                add(("}$", at, newline))
                if part.group(1) == "`":
                    add(("tpl`", part.end() - 1, False))
                    last, ended_operand = "tpl`", True
                else:
                    add(("${", part.end() - 2, False))
                    opened.append(("${", True))
                    last, ended_operand = "${", False
                newline, at = False, part.end()
                continue
            if _CLOSES[bracket] != kind:
                raise ScanError(at, "mismatched bracket")
            add((bracket, at, newline))
            last, ended_operand = bracket, operand
        elif which == 6:
            add(("str", at, newline))
            if spans is not None and "\n" in m.group(6):
                spans.append((at, stop))
            last, ended_operand = "str", True
        elif which == 7:
            add(("num", at, newline))
            last, ended_operand = "num", True
        elif which == 11:
            op = m.group(11)
            if text.startswith("/*", at):
                raise ScanError(at, "comment without end")
            if op[0] == "/" and not ended_operand:
                r = _JS_REGEX.match(text, at)
                if r is None:
                    raise ScanError(at, "regular expression without end")
                add(("regex", at, newline))
                last, ended_operand, stop = "regex", True, r.end()
            elif op in (">>", ">>>"):  # also closes type arguments
                add((">", at, newline))
                for _ in op[1:]:
                    add((">+", at, False))
                last, ended_operand = op, False
            else:
                kind = op if op == "=" else "aop" if op in _JS_ASSIGN else "bop" if op in _JS_BINARY else op
                add((kind, at, newline))
                last = op
                ended_operand = op in ("++", "--") and ended_operand
        elif which == 8:
            add(("#priv", at, newline))
            last, ended_operand = "#priv", True
        else:
            part = _JS_TEMPLATE.match(text, stop)
            if part is None:
                raise ScanError(at, "template without end")
            if spans is not None:
                spans.append((at, part.end()))
            add(("`", at, newline))
            if part.group(1) == "`":
                add(("tpl`", part.end() - 1, False))
                last, ended_operand = "tpl`", True
            else:
                add(("${", part.end() - 2, False))
                opened.append(("${", True))
                last, ended_operand = "${", False
            stop = part.end()
        newline, at = False, stop
    if opened:
        raise ScanError(end, "bracket without end")
    return out


_JS_BEFORE_OBJECT = frozenset("( [ , = : ? ?? && || ! ~ + - * / % return typeof void delete new in of instanceof case ... == === != !== < > <= >= | & ^ += -= *= ${ yield await default throw ??= ||= &&=".split())

_GO_TOKEN = re.compile(
    r"""([ \t\r﻿]+)                                                    # 1
    |(\n)                                                                  # 2
    |([^\W\d]\w*)                                                          # 3 word
    |(//[^\n]*)                                                            # 4
    |(/\*[\s\S]*?\*/)                                                      # 5
    |("(?:[^"\\\n]|\\(?:[abfnrtv\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"|`[^`]*`)   # 6 string
    |('(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')            # 7 rune
    |((?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|0[oO]?[0-7_]+|[0-9](?:_?[0-9])*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9_]+)?|\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?)i?(?!\w))   # 8
    |([(\[{])|([)\]}])                                                     # 9 10
    |(<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[;,<>+\-*/%&|^!=:.~])  # 11
    """,
    re.X,
)
_GO_ENDS = frozenset(["id", "num", "str", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_GO_BINARY = frozenset("&& || == != < <= > >= / % << >> &^ |".split())
_GO_ASSIGN = frozenset("+= -= *= /= %= &= |= ^= <<= >>= &^=".split())


def scan_go(text: str, spans: list | None = None, into: list | None = None) -> list[Token]:
    """Tokens of Go, with the semicolons that line ends stand for."""
    out: list[Token] = [] if into is None else into
    at, end, last = 0, len(text), ""
    opened: list[str] = []
    match, add = _GO_TOKEN.match, out.append
    while at < end:
        m = match(text, at)
        if m is None:
            raise ScanError(at, "no token")
        which, stop = m.lastindex, m.end()
        if which == 2 or which == 4 or which == 5:
            if which == 5 and spans is not None and "\n" in m.group(5):
                spans.append((at, stop))
            if (which == 2 or which == 5 and "\n" in m.group(5)) and last in _GO_ENDS:
                add((";", at, False))
                last = ";"
        elif which == 3:
            word = m.group(3)
            last = word if word in GO_RESERVED else "id"
            add((last, at, False))
        elif which == 11:
            op = m.group(11)
            if text.startswith("/*", at):
                raise ScanError(at, "comment without end")
            last = op
            add(("bop" if op in _GO_BINARY else "aop" if op in _GO_ASSIGN else op, at, False))
        elif which == 9:
            last = m.group(9)
            opened.append(last)
            add((last, at, False))
        elif which == 10:
            last = m.group(10)
            if not opened or opened.pop() != _CLOSES[last]:
                raise ScanError(at, "mismatched bracket")
            add((last, at, False))
        elif which == 6 or which == 7:
            last = "str" if which == 6 else "num"
            if spans is not None and "\n" in m.group(which):
                spans.append((at, stop))
            add((last, at, False))
        elif which == 8:
            last = "num"
            add((last, at, False))
        at = stop
    if opened:
        raise ScanError(end, "bracket without end")
    if last in _GO_ENDS:
        add((";", end, False))
    return out


_PY_TOKEN = re.compile(
    r"""([ \t\f]+|\\\r?\n|\\\r)                                            # 1 white space, joined lines
    |((?:\#[^\n\r]*)?(?:\r\n|\n|\r))                                       # 2 line end
    |(\#[^\n\r]*)                                                          # 3 comment at the end of the text
    |((?:[rR]|[uU]|[bB]|[fF]|[tT]|[bB][rR]|[rR][bB]|[fF][rR]|[rR][fF]|[tT][rR]|[rR][tT])?
       (?:\"\"\"(?:[^"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''))   # 4 triple quotes
    |((?:[rR]|[uU]|[bB]|[fF]|[tT]|[bB][rR]|[rR][bB]|[fF][rR]|[rR][fF]|[tT][rR]|[rR][tT])?
       (?:\"(?!\"\")(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?!'')(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'))   # 5 string
    |([^\W\d]\w*)                                                          # 6 word
    |((?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?
       |[0-9](?:_?[0-9])*\.?(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?)(?!\w))   # 7 number
    |([(\[{])|([)\]}])                                                     # 8 9
    |(->|\.\.\.|\*\*=|//=|>>=|<<=|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|<<|>>|[;,<>+\-*/%&|^~=:.@])   # 10
    """,
    re.X,
)
_PY_BLANK = re.compile(r"[ \t\f]*(?:#[^\n\r]*)?(?:\r\n|\n|\r|\Z)")
_PY_INDENT = re.compile(r"[ \t\f]*")
_PY_BINARY = frozenset("== != <= >= < > // % << >> & ^".split())
_PY_ASSIGN = frozenset("**= //= >>= <<= += -= *= /= %= @= &= |= ^=".split())
_PY_LEADING_ZERO = re.compile(r"0[0-9_]*[1-9][0-9_]*\Z")


def _columns(indent: str) -> tuple[int, int]:
    """Width with tabs of 8 and of 1; the two must order lines alike."""
    wide = narrow = 0
    for c in indent:
        if c == "\t":
            wide, narrow = (wide // 8 + 1) * 8, narrow + 1
        elif c == "\f":
            wide = narrow = 0
        else:
            wide, narrow = wide + 1, narrow + 1
    return wide, narrow


_F_STRING = re.compile(r"""(?:[fFtT][rR]?|[rR][fFtT])(\"\"\"|'''|"|')""")
_PY_ANY_STRING = re.compile(r"""[rRbBuU]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')""")


#: Fixed value: f-strings within f-strings that Python reads at most.
MOST_NESTED = 150


def _f_string_end(text: str, at: int, level: int = 1) -> int:
    """Where the f-string that begins at a place ends, with strings of any quotes inside its braces."""
    if level > MOST_NESTED:
        raise ScanError(at, "too many nested f-strings")
    opened = _F_STRING.match(text, at)
    quote, i, depth = opened.group(1), opened.end(), 0
    while i < len(text):
        if depth:
            inner = _F_STRING.match(text, i) and _f_string_end(text, i, level + 1)
            if not inner and (m := _PY_ANY_STRING.match(text, i)):
                inner = m.end()
            if inner:
                i = inner
                continue
            depth += (text[i] in "{[(") - (text[i] in "}])")
        elif text[i] == "\\" or text.startswith(("{{", "}}"), i):
            i += 1
        elif text[i] == "{":
            depth = 1
        elif text.startswith(quote, i):
            return i + len(quote)
        elif text[i] == "\n" and len(quote) == 1:
            break
        i += 1
    raise ScanError(at, "f-string without end")


def scan_python(text: str, spans: list | None = None, lines: list | None = None, into: list | None = None, nested: bool = False) -> list[Token]:
    """Tokens of Python; NL ends a logical line, IN and OUT wrap an indented block. ``lines`` collects
    (start, indent) of logical lines. ``nested`` reads f-strings as Python 3.12 does, which lets their
    braces hold strings with the same quotes."""
    out: list[Token] = [] if into is None else into
    at, end = (1 if text.startswith("﻿") else 0), len(text)
    indents, opened = [(0, 0)], []
    match, add = _PY_TOKEN.match, out.append
    fresh = True  # at the start of a line outside brackets
    while at < end:
        if fresh:
            blank = _PY_BLANK.match(text, at)
            if blank is not None and (blank.end() > at or at >= end):
                at = blank.end()
                continue
            indent = _PY_INDENT.match(text, at)
            wide, narrow = _columns(indent.group())
            if (wide > indents[-1][0]) != (narrow > indents[-1][1]) or (wide == indents[-1][0]) != (narrow == indents[-1][1]):
                raise ScanError(at, "inconsistent tabs")
            if wide > indents[-1][0]:
                indents.append((wide, narrow))
                add(("IN", at, False))
            else:
                while wide < indents[-1][0]:
                    indents.pop()
                    add(("OUT", at, False))
                if (wide, narrow) != indents[-1]:
                    raise ScanError(at, "unindent matches nothing")
            at = indent.end()
            if lines is not None:
                lines.append((at, wide))
            fresh = False
            continue
        if nested and _F_STRING.match(text, at):
            add(("str", at, False))
            at = _f_string_end(text, at)
            continue
        m = match(text, at)
        if m is None:
            raise ScanError(at, "no token")
        which, stop = m.lastindex, m.end()
        if which == 6:
            word = m.group(6)
            add((word if word in PY_RESERVED or word in ("match", "case", "type", "_") else "id", at, False))
        elif which == 2:
            if not opened:
                add(("NL", at, False))
                fresh = True
        elif which == 10:
            op = m.group(10)
            add(("bop" if op in _PY_BINARY else "aop" if op in _PY_ASSIGN else op, at, False))
        elif which == 8:
            opened.append(m.group(8))
            add((opened[-1], at, False))
        elif which == 9:
            if not opened or opened.pop() != _CLOSES[m.group(9)]:
                raise ScanError(at, "mismatched bracket")
            add((m.group(9), at, False))
        elif which == 4 or which == 5:
            if which == 4 and spans is not None and "\n" in m.group(4):
                spans.append((at, stop))
            add(("str", at, False))
        elif which == 7:
            if _PY_LEADING_ZERO.match(m.group(7)):
                raise ScanError(at, "leading zeros")
            add(("num", at, False))
        at = stop
    if opened:
        raise ScanError(end, "bracket without end")
    if not fresh:
        add(("NL", end, False))
    for _ in indents[1:]:
        add(("OUT", end, False))
    return out


_JSON_TOKEN = re.compile(
    r"""([ \t\r\n]+)|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.]))|((?:true|false|null)(?!\w))|([\[{])|([\]}])|([,:])"""
)


def scan_json(text: str, spans: list | None = None, into: list | None = None) -> list[Token]:
    out: list[Token] = [] if into is None else into
    at, end, opened = (1 if text.startswith("﻿") else 0), len(text), []
    while at < end:
        m = _JSON_TOKEN.match(text, at)
        if m is None:
            raise ScanError(at, "no token")
        which = m.lastindex
        if which == 2:
            out.append(("str", at, False))
        elif which in (3, 4):
            out.append(("lit", at, False))
        elif which in (5, 7):
            if which == 5:
                opened.append(m.group())
            out.append((m.group(), at, False))
        elif which == 6:
            if not opened or opened.pop() != _CLOSES[m.group()]:
                raise ScanError(at, "mismatched bracket")
            out.append((m.group(), at, False))
        at = m.end()
    if opened:
        raise ScanError(end, "bracket without end")
    return out
