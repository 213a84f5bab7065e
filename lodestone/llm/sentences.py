"""Sentence units across languages and scripts, by document-centred disambiguation.

Lines are first sorted into headings, fenced code, list items, speaker turns and paragraphs. Within
a block every terminator is a candidate. Whether the word before a period is an abbreviation is read
off its unambiguous occurrences: those that go on in lower case, with a comma or a number speak for
one, those that close a block or stand without a period against. The document's own occurrences
decide where there are enough of them; where it is silent, counts over the whole corpus do; a short
list of usual abbreviations is asked only for words on which both are silent. Whether a capitalised
word after an abbreviation is a name is decided in the same order. Scripts have their own
terminators; Thai, which has none, is cut at spaces between Thai words. Nothing inside quotation
marks, brackets or code spans ends a sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.storage import cut_lineage

# Fixed values, asked only about words on which document and corpus are silent: abbreviations that a
# sentence goes on after, that stand before a number, and that may close a sentence.
GOES_ON = frozenset(
    "e.g i.e cf vs approx resp dr mr mrs ms prof st viz al z.b d.h u.a bzw ca vgl bspw evtl ggf inkl sog p.ex c.-à-d env p.ej aprox sr sra т.е напр ок см ср π.χ δηλ βλ डॉ".split()
)
BEFORE_NUMBER = frozenset("no nos fig figs sec secs eq eqs ch vol pp nr abb abschn kap chap núm cap pág рис стр гл табл σελ κεφ αρ εικ सं पृ".split())
MAY_CLOSE = frozenset("etc usw a.m p.m min max u.s u.k d.c inc ltd co jr sr т.д т.п др κ.λπ κ.ά κλπ uds ud".split())
PRIOR = {**dict.fromkeys(GOES_ON, "goes on"), **dict.fromkeys(BEFORE_NUMBER, "number"), **dict.fromkeys(MAY_CLOSE, "may close")}
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
#: Facts of the corpus that are given to every task; more are joined to the texts that ask for them.
WORDS_AT_ONCE = 100_000
#: Occurrences from which the corpus, and unambiguous ones from which a document, is not silent on a word.
CORPUS_LEAST, DOCUMENT_LEAST = 20, 2
BEFORE_ORDINAL = frozenset("am vom zum bis seit ab der die das dem den des im".split())

#: Characters of a run without white space that are looked at around a terminator; of a longer one those next to it.
LONGEST_WORD = 256

_TOKEN = re.compile(r"\S+")
_LINE = re.compile(r"[^\n]*(?:\n|\Z)")
_HEADING = re.compile(r"[^\S\n]*#+(?:[^\S\n]|\r?\n|\Z)")
_FENCE = re.compile(r"[^\S\n]*(`{3,}|~{3,})")
_BULLET = re.compile(r"[^\S\n]*[-*+•‣][^\S\n]+\S")
_ORDERED = re.compile(r"[^\S\n]*(?:(\d{1,4})([.)])|([A-Za-z])(\)))[^\S\n]+\S")
_LEAD = re.compile(r"(?:(?:[-*+•‣]|\d{1,4}[.)]|[A-Za-z]\))[^\S\n]+)?(?:(?:user|agent|tool):\s*)?", re.I)
_SPEAKER = re.compile(r"[^\S\n]*(?:user|agent|tool):", re.I)
_END = re.compile(r"[.!?。！？｡．।॥؟۔…;;‼⁇⁈⁉]+")
_THAI_GAP = re.compile(r"(?<=[฀-ๅ็-๿])\s+(?=[ก-ๅ็-๿])")
_THAI_OTHER = re.compile(r"(?<=[ก-ๅ็-๿])\s+(?=[^\W\d_a-z฀-๿][^\W\d_]*\s[^\W\d_])")
_MARK = re.compile(r"[`\"“”„«»‹›‘’()\[\]{}（）［］【】「」『』《》〈〉]")
_OPENING = frozenset("\"“„«‹‘([{（［【「『《〈¿¡")
_CLOSING = frozenset("\"”“»›’)]}）］】」』》〉*_")
_PAIR = {")": "(", "]": "[", "}": "{", "）": "（", "］": "［", "】": "【", "」": "「", "』": "『", "》": "《", "〉": "〈", "»": "«", "›": "‹", "”": "“„"}
_CODE_NAME = re.compile(r"[^\W\d_]\w*[A-Z_]\w*(?:\.\w+)*(?:\(\))?|[\w.-]*/[\w./-]*|[^\W\d]\w*(?:\.\w{2,})+|[^\W_]*\d\w*")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: A short word or dotted form before a period, as far back as white space or an opening mark.
_CHARS = r"[^\s\x00-&(-,./0-:;-@\[-`{-\x7f“”„«»（）]"  # letters of all scripts with their signs, ' and -
_BEFORE_PERIOD = re.compile(rf"(?<![^\s(\[{{“\"«„（])({_CHARS}{{1,12}}(?:\.{_CHARS}{{1,4}}){{0,3}})\.(?![\w.])(\s*)")
#: What begins a new block on the next line.
_NEW_BLOCK = re.compile(r"[^\S\n]*(?:[-*+•‣][^\S\n]|#|`{3}|~{3}|(?:user|agent|tool):|\w{1,4}[.)]\s)", re.I)
_DOTTED = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_LETTER_BEFORE = re.compile(r"(?<!\w)(\w)\.\s*\Z")
_CAPITAL_INSIDE = re.compile(r"(?<=[^\W\d_A-Z][\s,]) ?([^\W\d_a-z][^\W\d_]+)")
_NEXT_CAPITAL = re.compile(rf"(?<![^\s(\[{{“\"«„（])({_CHARS}{{1,12}}(?:\.{_CHARS}{{1,4}}){{0,3}})\.\s+([^\W\d_a-z][^\W\d_]*)")


def _is_code(word: str) -> bool:
    return bool(_CODE_NAME.fullmatch(word.rstrip(".,;:!?)…»”\"'")))


def period_words(text: str) -> dict[str, list[int]]:
    """Of each word that stands before a period, lower-cased: how often the sentence certainly goes on
    behind it (lower case or a comma), a number follows, anything else follows, and the block ends.

    A single letter before a word of up to three letters makes one key of both, as in ``z. B.``.
    """
    found: dict[str, list[int]] = {}
    size = len(text)
    for m in _BEFORE_PERIOD.finditer(text):
        word, gap, at = m.group(1), m.group(2), m.end()
        if len(word) <= 3 and word.isalpha():
            letter = _LETTER_BEFORE.search(text, max(0, m.start() - 4), m.start())
            if letter:
                word = f"{letter.group(1)}.{word}"
        c = text[at] if at < size else ""
        if not gap:
            kind = 3 if not c else 0 if c in ",:;" else -1
        elif not c or gap.count("\n") > 1 or "\n" in gap and _NEW_BLOCK.match(text, at):
            kind = 3
        elif c.islower():
            end = at
            while end < size and end - at < LONGEST_WORD and not text[end].isspace():
                end += 1
            kind = -1 if _is_code(text[at:end]) else 0
        else:
            kind = 1 if c.isdigit() else 2
        if kind >= 0:
            counts = found.get(word.lower())
            if counts is None:
                counts = found[word.lower()] = [0, 0, 0, 0]
            counts[kind] += 1
    return found


class Segmenter:
    """Finds the units of one text after another; ``corpus`` holds what the corpus's counts say.

    Its keys are words before a period ("goes on", "number", "may close" or "plain") and, behind a
    ``^``, words after one ("name" or "common"); on words without a key the corpus is silent.
    """

    def __init__(self, corpus: dict[str, str] | None = None):
        self.corpus = corpus or {}

    def starts(self, text: str | None) -> list[int]:
        """Offsets of the first characters of all units, ascending."""
        if not text or text.isspace():
            return []
        self.text = text
        self._low: str | None = None
        self._periods: dict[str, list[int]] | None = None
        self._tokens: Counter | None = None
        self._names: tuple[set[str], set[str]] | None = None
        out: list[int] = []
        for kind, begin, end in self._blocks(text):
            while begin < end and text[begin].isspace():
                begin += 1
            if begin < end:
                out.append(begin)
                if kind == "text":
                    self._sentences(begin, end, out)
        return out

    def _blocks(self, text: str) -> Iterator[tuple[str, int, int]]:
        """Blocks in order: ("whole" | "text", begin, end)."""
        begin: int | None = None  # of the open text block
        fence = ""
        order: tuple[str, int] | None = None  # kind and number of the list's last ordered item
        in_list = False
        at = 0
        while at < len(text):
            m = _LINE.match(text, at)
            line, after = m.group(), m.end()
            if fence:
                stripped = line.strip()
                if stripped.startswith(fence) and not stripped.strip(fence[0]):
                    yield ("whole", begin, after)
                    begin, fence = None, ""
                at = after
                continue
            opened = _FENCE.match(line)
            if opened or not line.strip() or _HEADING.match(line):
                if begin is not None:
                    yield ("text", begin, at)
                begin = None
                in_list, order = False, order if not line.strip() else None
                if opened:
                    begin, fence = at, opened.group(1)
                elif line.strip():
                    yield ("whole", at, after)
                at = after
                continue
            numbered = _ORDERED.match(line)
            item = bool(_BULLET.match(line))
            if numbered:
                kind = numbered.group(2) or "a)"
                number = int(numbered.group(1)) if numbered.group(1) else ord(numbered.group(3).lower()) - 96
                before = text[max(begin, at - 200) : at].rsplit(None, 1)[-1:] if begin is not None else []
                opens = number == 1 and (in_list or before and before[0][-1] in ":.!?") and not (before and self._abbreviation(before[0].lower().rstrip("."), 1))
                if begin is None or (in_list and order == (kind, number - 1)) or opens:
                    item, order = True, (kind, number)
            if item or _SPEAKER.match(line):
                if begin is not None:
                    yield ("text", begin, at)
                begin, in_list = at, item
            elif begin is None:
                begin = at
            at = after
        if begin is not None:
            yield ("whole" if fence else "text", begin, len(text))

    def _pairs(self, begin: int, end: int) -> list[tuple[int, int]]:
        """Outermost quotations, brackets and code spans of a block that are closed within it."""
        text, stack, found = self.text, [], []
        held: Counter = Counter()  # open marks on the stack
        for m in _MARK.finditer(text, begin, end):
            mark, at = m.group(), m.start()
            opener = None
            if mark in ("`", '"'):
                opener = mark if held[mark] else None
            elif mark == "“":
                opener = "„" if held["„"] else None
            elif mark == "’":
                opener = "‘" if held["‘"] and not text[at + 1 : at + 2].isalpha() else None
                if opener is None:
                    continue
            elif mark in _PAIR:
                if not any(held[o] for o in _PAIR[mark]):
                    continue
                opener = next(s[0] for s in reversed(stack) if s[0] in _PAIR[mark])
            if stack and stack[-1][0] == "`" and mark != "`":
                continue
            if opener is None:
                stack.append((mark, at))
                held[mark] += 1
                continue
            while stack[-1][0] != opener:
                held[stack.pop()[0]] -= 1
            held[opener] -= 1
            found.append((stack.pop()[1], at))
        found.sort()
        outer: list[tuple[int, int]] = []
        for a, b in found:
            if not outer or a > outer[-1][1]:
                outer.append((a, b))
        return outer

    def _sentences(self, begin: int, end: int, out: list[int]) -> None:
        text = self.text
        pairs = self._pairs(begin, end)
        cuts: list[int] = []
        opening = _LEAD.match(text, begin, end)
        which, start = 0, opening.end() if opening else begin
        thai = [m.end() for m in _THAI_GAP.finditer(text, begin, end)] + [m.end() for m in _THAI_OTHER.finditer(text, begin, end)] if "ก" <= max(text[begin:end]) else []
        at = start
        while True:
            m = _END.search(text, at, end)
            if m is None:
                break
            at = m.end()
            while which < len(pairs) and pairs[which][1] < m.start():
                which += 1
            if which < len(pairs) and pairs[which][0] < m.start():
                opened, closed = pairs[which]
                at = closed + 1
                if text[opened] == "`":
                    continue
                inner = text[opened + 1 : closed].rstrip()
                if inner and _END.fullmatch(inner[-1]) and inner[-1] != ";":
                    cut = self._after_pair(start, opened, closed, closed + 1, end, inner)
                    if cut is not None:
                        cuts.append(cut)
                        start = cut
                continue
            cut = self._after_run(start, m.start(), m.end(), end)
            if cut is not None:
                cuts.append(cut)
                start = at = cut
        if thai:
            cuts += [t for t in thai if not any(a < t <= b for a, b in pairs)]
            cuts = sorted(set(cuts))
        out += cuts

    def _next(self, at: int, end: int) -> int:
        text = self.text
        while at < end and text[at].isspace():
            at += 1
        return at

    def _word_at(self, at: int, end: int) -> str:
        m = _TOKEN.match(self.text, at, min(end, at + LONGEST_WORD))
        return m.group() if m else ""

    def _after_pair(self, start: int, opened: int, closed: int, at: int, end: int, inner: str) -> int | None:
        """Where the next sentence starts behind a closed pair that ends in a terminator."""
        text = self.text
        following = self._next(at, end)
        if following >= end or _END.match(text[following]) and following == at:
            return None
        c = text[following]
        whole = opened == start
        if c.isupper():
            word = re.search(r"\S+\Z", inner).group().rstrip(".").lower()
            return None if inner.endswith(".") and not whole and self._abbreviation(word, 3) else following
        if whole and (c in _OPENING or c == "`" or c.isalpha() and not c.islower() or c.islower() and _is_code(self._word_at(following, end))):
            return following
        return None

    def _after_run(self, start: int, at: int, stop: int, end: int) -> int | None:
        """Where the next sentence starts behind the terminators text[at:stop], or None."""
        text = self.text
        run = text[at:stop]
        k = stop
        while k < end and text[k] in _CLOSING and not (text[k] in "\"“*_" and k + 1 < end and not text[k + 1].isspace()):
            k += 1
        following = self._next(k, end)
        if following >= end:
            return None
        c = text[following]
        gap = following > k
        if set(run) <= {";", ";"}:
            if not (_GREEK.search(text, start, at) and (gap or c.isupper())):
                return None
            return following
        strong = run.strip(".…;;")
        if not strong and ("…" in run or run.count(".") >= 3):
            return following if c.isupper() or c in _OPENING else None
        if strong:
            if strong.strip("!?"):
                return following  # terminators of scripts that need no space
            if c.isupper() or c in _OPENING or (c.isalpha() and not c.islower()):
                return following
            if not gap:
                return None
            return following if c == "`" or c.isdigit() or c.islower() and _is_code(self._word_at(following, end)) else None
        return following if self._period_ends(start, at, following, gap, end) else None

    def _period_ends(self, start: int, at: int, following: int, gap: bool, end: int) -> bool:
        text = self.text
        begin = at
        bound = max(start, at - LONGEST_WORD)
        while begin > bound and not text[begin - 1].isspace() and text[begin - 1] not in "([{“\"«„（":
            begin -= 1
        word = text[begin:at]
        if not word:
            return False
        c = text[following]
        if not gap:
            # a missing space: a plain word or number before, a capitalised plain word behind
            m = _WORD.match(text, following, end)
            return bool(m) and c.isupper() and (len(m.group()) == 1 or m.group()[1:].islower()) and (word.islower() and (word.isalpha() or "." not in word) or word[-1].isdigit() or word[-1] in ")`”»") and not _is_code(self._word_at(following, end).split(",")[0])
        lower = word.lower()
        if c.islower() and not _is_code(self._word_at(following, end)):
            return False
        role = self._role(lower, word, begin, start, 1 if c.isdigit() else 0 if c.islower() else 2)
        if c.islower() or c == "`":
            return role == ""
        if c.isdigit():
            return role == "" and not word.isdigit()
        if role == "goes on":
            return False
        if c.isupper() and word.isdigit() and len(word) <= 2:
            nxt = _WORD.match(text, following, end)
            before = _WORD.findall(text[max(start, begin - 12) : begin])
            if (nxt and nxt.group().lower() in MONTHS) or (before and before[-1].lower() in BEFORE_ORDINAL and not text[max(start, begin - 12) : begin].rstrip().endswith(".")):
                return False
        if role in ("may close", "initial") and c.isupper():
            nxt = _WORD.match(text, following, end)
            if nxt:
                return not self._is_name(nxt.group(), role == "initial")
        return True

    def _role(self, lower: str, word: str, begin: int, start: int, own: int) -> str:
        """What the word before a period is: "" for no abbreviation; ``own`` is the kind of what follows, as in ``period_words``."""
        if len(word) <= 3 and word.isalpha():
            before = _LETTER_BEFORE.search(self.text, max(start, begin - 4), begin)
            if before:
                pair = f"{before.group(1).lower()}.{lower}"
                role = self._abbreviation(pair, own)
                if role or pair in self.corpus:
                    return role
            if len(word) == 1:
                after = re.match(r"\.\s*(\w{1,3})\.", self.text[begin + 1 : begin + 8])
                return "goes on" if after and self._abbreviation(f"{lower}.{after.group(1).lower()}", 3) else "initial"
        return self._abbreviation(lower, own)

    def _abbreviation(self, word: str, own: int) -> str:
        """The role of a word by the document, else by the corpus, else by the list and the word's form."""
        role = self.corpus.get(word)
        if role is None:
            role = PRIOR.get(word) or ("may close" if _DOTTED.fullmatch(word) else "")
        elif role == "plain":
            role = ""
        if not role and self._periods is None and len(self.text) < 20_000:
            # too few of its periods elsewhere in a short text: the document is silent, without a look at all words
            if self._low is None:
                self._low = self.text.lower()
            if self._low.count(word.rpartition(".")[2] + ".") <= DOCUMENT_LEAST:
                return ""
        if self._periods is None:
            self._periods = period_words(self.text)
        counts = self._periods.get(word)
        if counts:
            goes, digits, other, closes = counts
            if own < 2:  # elsewhere in the document, not here
                goes, digits = goes - (own == 0), digits - (own == 1)
            sure = goes + digits
            if role or sure >= DOCUMENT_LEAST:
                if self._tokens is None:
                    self._tokens = Counter(self.text.lower().split())
                against = closes + (other if own == 1 else self._tokens[word])
                if sure >= DOCUMENT_LEAST and sure >= 2 * against and sure >= other:
                    role = "may close" if closes else "goes on"
                elif against >= DOCUMENT_LEAST and not sure:
                    role = ""
        return "" if role == "number" and own == 2 else role

    def _is_name(self, word: str, unknown: bool) -> bool:
        """Whether a capitalised word after an abbreviation is a name: by the document, else by the corpus, else ``unknown``."""
        names, commons = self._known()
        if word.lower() in commons:
            return False
        if word in names:
            return True
        said = self.corpus.get("^" + word.lower())
        return unknown if said is None else said == "name"

    def _known(self) -> tuple[set[str], set[str]]:
        """(words capitalised where no sentence starts, words seen in lower case) of the document."""
        if self._names is None:
            names = {m.group(1) for m in _CAPITAL_INSIDE.finditer(self.text) if m.group(1)[0].isupper()}
            self._names = (names, {w for w in _WORD.findall(self.text) if w.islower()})
        return self._names


def _counted(texts: DataFrame, count, columns: list[str]) -> DataFrame:
    """(word, columns): what ``count`` adds up for the words of all texts; each task sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[int]] = {}

        def packed() -> pa.RecordBatch:
            rows = list(sums.values())
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(len(columns))]], names=["word", *columns])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    for word, numbers in count(text):
                        have = sums.get(word)
                        if have is None:
                            sums[word] = list(numbers)
                        else:
                            for i, n in enumerate(numbers):
                                have[i] += n
            if len(sums) > 200_000:
                yield packed()
                sums.clear()
        yield packed()

    schema = "word string, " + ", ".join(f"{c} bigint" for c in columns)
    return texts.mapInArrow(run, schema).groupBy("word").agg(*[F.sum(c).alias(c) for c in columns])


def _few(words: DataFrame, at_once: int) -> frozenset[str] | None:
    """The words, if they are at most ``at_once``; more stay in the table."""
    rows = words.select("word").limit(at_once + 1).collect()
    return frozenset(r.word for r in rows) if len(rows) <= at_once else None


def corpus_facts(documents: DataFrame, text_col: str = "text", least: int = CORPUS_LEAST, at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """(word, role): what the counts over all documents say about abbreviations and names, as ``Segmenter`` takes it.

    A word is judged from ``least`` occurrences before a period on, whatever the size of the corpus.
    It is an abbreviation when the sentence certainly goes on behind half of them, or when it closes no
    block in four times as many; and it hardly ever stands without a period, except before numbers. One that
    closes a block in 2 % of its occurrences may close a sentence. Words that follow such words with a
    capital are names when they stand capitalised inside sentences at least four times as often as
    in lower case. Each task counts its own documents; the sums are by word.
    """
    texts = documents.select(F.col(text_col))
    seen = F.col("goes") + F.col("digits") + F.col("other") + F.col("closes")
    goes_on = (F.col("goes") + F.col("digits")) * 2 >= seen
    never_closes = (F.col("closes") * 50 < seen) & (seen >= 4 * least)
    periods = _counted(texts, lambda text: period_words(text).items(), ["goes", "digits", "other", "closes"])
    judged = cut_lineage(periods.withColumn("seen", seen).where(F.col("seen") >= least).where(goes_on | never_closes | F.col("word").isin(*PRIOR)).withColumn("likely", goes_on | never_closes).withColumn("goes_on", goes_on))
    likely = _few(judged.where("likely"), at_once)

    def around(text: str) -> Iterator[tuple[str, tuple[int, int]]]:
        """(word without a period, times) and (^word with a capital behind an abbreviation, 0)."""
        for token, n in Counter(text.lower().split()).items():
            if len(token) <= 12 and (likely is None or token in likely):
                yield token, (n,)
        for m in _NEXT_CAPITAL.finditer(text):
            word = m.group(1).lower()
            if m.group(2)[0].isupper() and (len(word) == 1 or "." in word or word in PRIOR or likely is None or word in likely):
                yield "^" + m.group(2).lower(), (0,)

    counted = _counted(texts, around, ["bare"]).join(judged.select("word", F.lit(True).alias("judged")), "word", "left")
    near = cut_lineage(counted.where(F.col("word").startswith("^") | F.col("judged")).select("word", "bare"))
    role = (
        F.when(~F.col("likely"), "plain")
        .when(F.col("goes_on") & (F.col("closes") * 50 >= F.col("seen")), "may close")
        .when(F.coalesce("bare", F.lit(0)) * 10 <= F.col("seen"), "goes on")
        .when(F.col("goes_on"), "number")
        .otherwise("plain")
    )
    abbreviations = judged.join(near, "word", "left").select("word", role.alias("role")).where((F.col("role") != "plain") | F.col("word").isin(*PRIOR))

    asked = near.where(F.col("word").startswith("^")).select("word")
    wanted = _few(asked, at_once)

    def capitals(text: str) -> Iterator[tuple[str, tuple[int, int]]]:
        for token, n in Counter(text.split()).items():
            if token.islower() and (wanted is None or "^" + token in wanted):
                yield "^" + token, (n, 0)
        for name in _CAPITAL_INSIDE.findall(text):
            if name[0].isupper() and (wanted is None or "^" + name.lower() in wanted):
                yield "^" + name.lower(), (0, 1)

    counts = _counted(texts, capitals, ["low", "inside"]).join(asked, "word", "left_semi")
    kind = F.when((F.col("inside") >= least) & (F.col("inside") >= 4 * F.col("low")), "name").when((F.col("low") >= least) & (F.col("low") >= 4 * F.col("inside")), "common")
    return cut_lineage(abbreviations.unionByName(counts.select("word", kind.alias("role")).where("role is not null")))


def _with_facts(documents: DataFrame, id_col: str, text_col: str, at_once: int) -> tuple[DataFrame, dict[str, str]]:
    """((id, __text, __facts) of the documents with a text, facts that hold for all of them).

    Up to ``at_once`` facts of the corpus are given to every task. Of more, each text gets those on
    the words around its periods, by joins; equal hashes of two texts only give them each other's.
    """
    chosen = documents.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text")).where(F.col("__text").isNotNull())
    found = corpus_facts(documents, text_col, at_once=at_once)
    few = found.limit(at_once + 1).collect()
    if len(few) <= at_once:
        return chosen.withColumn("__facts", F.lit(None).cast("map<string,string>")), {r.word: r.role for r in few}

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _asked_keys(text)
                keys += [key] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string())], names=["__key", "word"])

    keyed = chosen.withColumn("__key", F.xxhash64("__text"))
    wanted = keyed.select("__key", "__text").mapInArrow(asked, "__key bigint, word string").distinct()
    lists = wanted.join(found, "word").groupBy("__key").agg(F.map_from_entries(F.collect_set(F.struct("word", "role"))).alias("__facts"))
    return keyed.join(lists, "__key", "left").drop("__key"), {}


#: Whatever stands before a period, and the word behind it.
_AROUND_PERIOD = re.compile(r"(?<![^\s(\[{“\"«„（.])([^\s(\[{“\"«„（]{1,24})\.(?=\s*([^\W\d_]*))")


def _asked_keys(text: str) -> set[str]:
    """Every key that the segmenter may look up for a text."""
    keys = set()
    for m in _AROUND_PERIOD.finditer(text):
        word, behind = m.group(1).lower(), m.group(2).lower()
        letter = _LETTER_BEFORE.search(text, max(0, m.start() - 4), m.start())
        keys |= {word, f"{letter.group(1).lower()}.{word}" if letter else word, f"{word}.{behind}" if behind else word, "^" + behind}
    return keys


def sentence_starts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """(id, start_pos): offset in code points of the first character of every unit, one row for each.

    Null, empty and blank texts give no row; rows repeated in the input are repeated in the output;
    further columns are not read. Texts are read whole: four times, thrice for the
    corpus's counts, which run while the plan is built.
    """
    chosen, facts = _with_facts(documents, id_col, text_col, at_once)
    corpus = documents.sparkSession.sparkContext.broadcast(facts)
    schema = T.StructType([chosen.schema[0], T.StructField("start_pos", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(corpus.value)
        for batch in batches:
            rows, starts = [], []
            for i, (text, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                segmenter.corpus = corpus.value if own is None else dict(own)
                found = segmenter.starts(text)
                rows += [i] * len(found)
                starts += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32())], names=schema.names)

    return chosen.mapInArrow(run, schema)


def sentence_units(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """(id, unit, start_pos, text): the units themselves, counted from 1, up to where the next one starts, right-trimmed."""
    chosen, facts = _with_facts(documents, id_col, text_col, at_once)
    corpus = documents.sparkSession.sparkContext.broadcast(facts)
    schema = T.StructType([chosen.schema[0], T.StructField("unit", T.IntegerType()), T.StructField("start_pos", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(corpus.value)
        for batch in batches:
            rows, units, starts, texts = [], [], [], []
            for i, (text, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                segmenter.corpus = corpus.value if own is None else dict(own)
                found = segmenter.starts(text)
                for unit, (a, b) in enumerate(zip(found, [*found[1:], len(text)]), 1):
                    rows.append(i)
                    units.append(unit)
                    starts.append(a)
                    texts.append(text[a:b].rstrip())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(units, pa.int32()), pa.array(starts, pa.int32()), pa.array(texts, pa.string())], names=schema.names)

    return chosen.mapInArrow(run, schema)
