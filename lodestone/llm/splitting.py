"""Splitting oversized chunks at natural boundaries by recursive bisection.

A text above the limit is cut at the strongest boundary near its midpoint, and so are its halves
while they exceed the limit less the overlap; then each piece but the first receives whole lines
from the end of the piece before it, up to the overlap. Boundaries are graded: a *natural* one (a
line behind a blank line, directly inside the symbol), another line directly inside the symbol, a
line behind a blank line, any line start, white space, any place.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import scanners

LIMIT, OVERLAP = 1000, 100
NATURAL, LEVEL, AFTER_BLANK, LINE = 4, 3, 2, 1
_BRACES = {"ts": scanners.scan_js, "js": scanners.scan_js, "mjs": scanners.scan_js, "cjs": scanners.scan_js, "tsx": scanners.scan_js, "jsx": scanners.scan_js, "go": scanners.scan_go}
_OPEN, _CLOSE = frozenset(["(", "[", "{", "${"]), frozenset([")", "]", "}", "}$"])
_COMMENT = re.compile(r"\s*(#|//|/\*|\*)")


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))]


def _level_one(path: str, code: str, base: int, firsts: list[int]) -> set[int]:
    """Those of ``firsts`` (offsets of lines' first characters) that stand directly inside the symbol."""
    kind = path.rpartition(".")[2].lower()
    spans: list[tuple[int, int]] = []
    tokens: list = []
    lines: list[tuple[int, int]] = []
    try:
        if kind == "py" or kind == "pyi":
            scanners.scan_python(code, spans, lines, into=tokens)
        elif kind in _BRACES:
            _BRACES[kind](code, spans, into=tokens)
        else:
            return {f for f in firsts if f == base or code[f - base - 1] == "\n"}
    except scanners.ScanError:
        pass  # what was scanned before the error still counts
    inner: set[int] = set()
    if kind in ("py", "pyi"):
        at_start = {start: i for i, (start, _) in enumerate(lines)}
        header = next((i for i, (start, _) in enumerate(lines) if re.match(r"(async\s+)?(def|class)\b", code[start : start + 80])), None)
        if header is not None:
            body = next((indent for _, indent in lines[header + 1 :]), None)
            if body is None or body <= lines[header][1]:
                return inner
            starts = [start for start, _ in lines]
            for first in firsts:
                at = first - base
                i = at_start.get(at)
                if i is not None:
                    if i > header and lines[i][1] == body:
                        inner.add(first)
                elif code[at] == "#":
                    begin = code.rfind("\n", 0, at) + 1
                    following = bisect_left(starts, at)
                    inside = any(a < at < b for a, b in spans)
                    if not inside and following > header and scanners._columns(code[begin:at])[0] == body and _between(tokens, at) and (following == len(lines) or lines[following][1] <= body):
                        inner.add(first)
            return inner
    depth, opened, limits = 0, None, []
    choice = next((mark for mark in (("{",) if kind not in ("py", "pyi") else ()) + ("{", "[", "(") if _opens_at_top(tokens, mark)), None)
    events: list[tuple[int, int]] = []
    for token in tokens:
        if token[0] in _OPEN:
            if depth == 0 and opened is None and token[0] == choice:
                opened = token[1]
            depth += 1
            events.append((token[1], depth))
        elif token[0] in _CLOSE:
            depth -= 1
            events.append((token[1], depth))
            if depth == 0 and opened is not None:
                limits = [opened, token[1]]
                break
    if opened is None:
        return inner
    if not limits:
        limits = [opened, len(code)]
    places = [e[0] for e in events]
    span_starts = [a for a, _ in spans]
    for first in firsts:
        at = first - base
        if not limits[0] < at < limits[1]:
            continue
        i = bisect_left(places, at) - 1
        j = bisect_left(span_starts, at) - 1
        if i >= 0 and events[i][1] == 1 and not (j >= 0 and spans[j][1] > at):
            inner.add(first)
    return inner


def _opens_at_top(tokens: list, mark: str) -> bool:
    depth = 0
    for kind, _, _ in tokens:
        if kind in _OPEN:
            if depth == 0 and kind == mark:
                return True
            depth += 1
        elif kind in _CLOSE:
            depth -= 1
    return False


def _between(tokens: list, at: int) -> bool:
    """Whether no bracket is open at the place: the token before it ends a line or opens or closes a block."""
    before = bisect_left(tokens, at, key=lambda t: t[1]) - 1
    return before < 0 or tokens[before][0] in ("NL", "IN", "OUT")


def grade_lines(path: str, header: str | None, text: str) -> tuple[list[int], list[int]]:
    """(start of each line, grade of a cut before it)."""
    starts = _line_starts(text)
    ends = [*starts[1:], len(text)]
    bodies = [text[a:b] for a, b in zip(starts, ends)]
    skip = 1 if len(bodies) > 1 and ((header and bodies[0].strip() == header.strip()) or bodies[0].startswith(f"{path} > ")) else 0
    base = starts[skip] if skip < len(starts) else len(text)
    firsts = [a + len(line) - len(line.lstrip()) if line.strip() else -1 for a, line in zip(starts, bodies)]
    inner = _level_one(path, text[base:], base, [f for f in firsts[skip:] if f >= 0])
    grades = []
    for i, first in enumerate(firsts):
        blank_before = i > 0 and firsts[i - 1] < 0
        if i <= skip or first < 0:
            grades.append(LINE)
        elif first in inner:
            grades.append(NATURAL if blank_before else LEVEL)
        else:
            grades.append(AFTER_BLANK if blank_before else LINE)
    return starts, grades


def bisect_text(text: str, starts: list[int], grades: list[int], most: int) -> list[int]:
    """Offsets where the pieces begin, each piece at most ``most`` code points long."""
    out: list[int] = []
    todo = [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= most:
            out.append(lo)
            continue
        middle, quarter = (lo + hi) // 2, (hi - lo) // 4
        best = None
        for near in (quarter, hi - lo):
            a, b = bisect_left(starts, max(lo + 1, middle - near)), bisect_right(starts, min(hi - 1, middle + near))
            if a < b:
                best = max(range(a, b), key=lambda i: (grades[i], -abs(starts[i] - middle)))
                break
        if best is not None:
            cut = starts[best]
        else:
            blank = max(text.rfind(" ", max(lo + 1, middle - quarter), middle), text.rfind("\t", max(lo + 1, middle - quarter), middle))
            cut = blank + 1 if blank > 0 else middle
        todo += [(cut, hi), (lo, cut)]
    return sorted(out)


def split_text(path: str, header: str | None, text: str, start_line: int | None, end_line: int | None, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], list[dict]]:
    """(natural boundaries as 1-based lines, pieces) of one text."""
    starts, grades = grade_lines(path, header, text) if len(text) > limit else (_line_starts(text), [])
    natural = [i + 1 for i, grade in enumerate(grades) if grade == NATURAL]
    cuts = bisect_text(text, starts, grades, limit - overlap) if len(text) > limit else [0]
    if start_line is not None and end_line is not None and start_line > end_line:
        start_line, end_line = end_line, start_line
    # text line of the symbol's first line: what stands above it is the header and its comments
    lines = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
    body = 1
    if len(lines) > 1 and ((header and lines[0].strip() == header.strip()) or lines[0].startswith(f"{path} > ")):
        body = 2
        while body <= len(lines) and _COMMENT.match(lines[body - 1]):
            body += 1
    if start_line is None and end_line is not None:
        start_line = max(1, end_line - (len(lines) - body))
    place = (lambda k: None) if start_line is None else (lambda k: max(1, start_line + k - body))
    pieces = []
    for i, begin in enumerate(cuts):
        end = cuts[i + 1] if i + 1 < len(cuts) else len(text)
        first = begin
        if i:
            # whole lines before the cut, within the piece before
            line = bisect_left(starts, begin)
            if line < len(starts) and starts[line] == begin:
                while line > 0 and starts[line - 1] >= max(cuts[i - 1], begin - overlap):
                    line -= 1
                first = starts[line]
        top, bottom = bisect_right(starts, first), bisect_right(starts, max(first, end - 1))
        pieces.append({
            "piece": i + 1, "pieces": len(cuts), "header": f"{header or path} [{i + 1}/{len(cuts)}]", "start_line": place(top), "end_line": place(bottom), "overlap": begin - first, "text": text[first:end],
        })
    return natural, pieces


_PIECE = T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("pieces", T.IntegerType()), T.StructField("header", T.StringType()), T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()), T.StructField("overlap", T.IntegerType()), T.StructField("text", T.StringType()),
])
_ARROW_PIECE = pa.list_(pa.struct([("piece", pa.int32()), ("pieces", pa.int32()), ("header", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("overlap", pa.int32()), ("text", pa.string())]))


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, key_col: str = "symbol_id") -> DataFrame:
    """(key, boundaries, pieces) of every chunk with a text, one row for each input row; no shuffle.

    ``boundaries`` are the natural ones of a text above the limit, ``pieces`` its parts of at most
    ``limit`` code points, each with header, first and last line of the file, the length of the
    overlap and its text; the texts without their overlaps, joined, are the original. A shorter text
    is one piece without boundaries; a null or empty one gives no row. Swapped lines are put right, one
    null line is worked out from the other, two give null lines. Null paths count as plain text.
    """
    chosen = chunks.select(F.col(key_col).alias(key_col), F.coalesce("path", F.lit("")), "header", "text", "start_line", "end_line").where(F.length("text") > 0)
    schema = T.StructType([chosen.schema[0], T.StructField("boundaries", T.ArrayType(T.IntegerType())), T.StructField("pieces", T.ArrayType(_PIECE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                batch = whole.slice(begin, 2000)
                rows = [split_text(*row, limit=limit, overlap=overlap) for row in zip(*(batch.column(i).to_pylist() for i in range(1, 6)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], _ARROW_PIECE)], names=schema.names)

    return chosen.mapInArrow(run, schema)


def chunk_boundaries(chunks: DataFrame, limit: int = LIMIT, key_col: str = "symbol_id") -> DataFrame:
    """(key, text_line): natural boundaries of the chunks above the limit; 0 where there are none. Repeated rows count once."""
    split = split_chunks(chunks.where(F.length("text") > limit), limit, key_col=key_col)
    lines = F.when(F.size("boundaries") == 0, F.array(F.lit(0))).otherwise(F.col("boundaries"))
    return split.select(key_col, F.explode(lines).alias("text_line")).distinct()


def chunk_pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, key_col: str = "symbol_id") -> DataFrame:
    """(key, piece, pieces, header, start_line, end_line, overlap, text), one row for each piece; repeated rows count once.

    Repeated chunks are dropped before they are cut, so a text is shuffled once and not as its pieces and overlaps.
    """
    once = chunks.select(key_col, "path", "header", "text", "start_line", "end_line").where(F.length("text") > 0).distinct()
    return split_chunks(once, limit, overlap, key_col).select(key_col, F.inline("pieces"))
