"""Column functions on identifiers, queries, paths and lines; all built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Search synonyms, caps, extensions and ignored folders of the retrieval contract.
SYNONYMS = {
    "auth": ["login", "signin", "authenticate", "authentication"], "authentication": ["auth", "login"], "authenticate": ["auth", "login"], "login": ["auth", "signin", "authenticate"],
    "signin": ["login", "auth"], "logout": ["signout", "auth"], "token": ["jwt", "session"], "jwt": ["token"], "password": ["credential", "secret"], "db": ["database", "sql", "repository"],
    "database": ["db", "sql"], "config": ["settings", "options", "configuration"], "configuration": ["config", "settings"], "settings": ["config", "options"], "util": ["utility", "helper"],
    "utility": ["util", "helper"], "helper": ["util", "utility"], "middleware": ["interceptor"], "interceptor": ["middleware"], "route": ["endpoint", "path"], "endpoint": ["route", "path"],
    "handler": ["controller"], "controller": ["handler"], "schema": ["model", "entity"], "model": ["schema", "entity"], "entity": ["schema", "model"], "validate": ["verify", "check"],
    "verify": ["validate", "check"], "cache": ["store"], "store": ["cache"], "deploy": ["release", "publish"], "release": ["deploy", "publish"], "publish": ["deploy", "release"],
    "test": ["spec"], "spec": ["test"], "mock": ["stub", "fake"], "stub": ["mock", "fake"], "fake": ["mock", "stub"], "delete": ["remove", "destroy"], "create": ["add", "insert"], "update": ["edit", "patch"],
}
MAX_TERMS, MAX_SIGNALS = 24, 12
SYMBOL_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go")
TEXT_EXTENSIONS = tuple("java kt kts rs rb cs php swift scala c h cc cpp hpp sql sh md mdx json yaml yml toml vue svelte astro css scss sass less".split())
IGNORED_DIRS = tuple("node_modules .git dist build coverage .next .nuxt .turbo .yarn .nx __pycache__ vendor target .venv venv".split())
IGNORED_PATTERNS = ("*.min.js", "*.min.mjs", "*.min.cjs", "public/**/*.min.*")
KEPT_DIRS = ("test", "tests", "__tests__", "spec", "e2e")


_PARTS = "[A-Z]+(?=[A-Z][a-z])|[A-Z]*[a-z0-9]+|[A-Z]+"


def identifier_tokens(name: Column) -> Column:
    """Distinct [lower-cased whole, lower-cased parts of camel, Pascal and snake case] joined by blanks.

    Null gives null; an empty name gives an empty string.
    """
    parts = F.regexp_extract_all(name, F.lit(_PARTS), F.lit(0))
    return F.array_join(F.filter(F.array_distinct(F.concat(F.array(F.lower(name)), F.transform(parts, F.lower))), lambda x: x != ""), " ")


def identifier_tokens_of(name: str) -> list[str]:
    """The same for one string of the driver's."""
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name))
    return [t for t in dict.fromkeys([name.lower(), *(p.lower() for p in re.split(r"[^A-Za-z0-9]+", spaced))]) if t]


def identifier_terms_of(name: str) -> list[str]:
    """The runs of ASCII letters and digits in the tokens of one string, with repeats, in any order."""
    whole = name.lower()
    parts = set(" ".join(re.findall(_PARTS, name)).lower().split())  # each is one run
    parts.discard(whole)
    return [*re.findall("[a-z0-9]+", whole), *parts]


def expand_query(query: str) -> list[str]:
    """Search terms of a query: its words, their identifier parts longer than one letter, one round of synonyms; at most 24."""
    words = re.sub(r"[\"'*:^(){}\[\]~-]", " ", query).split()
    terms: dict[str, None] = {}
    for word in words:
        terms[word] = None
        terms.update({p: None for p in identifier_tokens_of(word) if len(p) > 1})
    for term in list(terms):
        terms.update({s: None for s in SYNONYMS.get(term.lower(), [])})
    return list(terms)[:MAX_TERMS]


# The names that stand out, in this order; words are of ASCII letters, digits and _.
_EDGE = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_SIGNALS = (r"`([^`]+)`", rf"([A-Za-z0-9_./-]+\.[a-zA-Z]{{1,5}}){_EDGE[1]}", *[rf"{_EDGE[0]}({word}){_EDGE[1]}" for word in (r"[A-Z][a-zA-Z0-9]*[A-Z][A-Za-z0-9]*", r"[a-z]+[A-Z][A-Za-z0-9]*", r"[a-z]+_[a-z0-9_]+")])


def query_signals(text: Column) -> Column:
    """Identifiers that stand out in prose: backticked, dotted paths, Pascal, camel and snake case; distinct regardless of case, at most 12."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in _SIGNALS])
    kept = F.filter(F.transform(found, F.trim), lambda x: F.length(x) >= 2)
    lowered = F.transform(kept, F.lower)
    first = F.filter(kept, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return F.slice(first, 1, MAX_SIGNALS)


def signals_of(text: str) -> list[str]:
    """The same for one string of the driver's."""
    first: dict[str, str] = {}
    for pattern in _SIGNALS:
        for found in re.findall(pattern, text):
            if len(found.strip(" ")) >= 2:
                first.setdefault(found.strip(" ").lower(), found.strip(" "))
    return list(first.values())[:MAX_SIGNALS]


def classify_query(query: Column) -> Column:
    """identifier (one dotted name), natural (words, no runs of capitals) or mixed."""
    q = F.trim(query)
    return F.when(q.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*\z"), "identifier").when(q.contains(" ") & q.rlike("[a-z]{3,}") & ~q.rlike("[A-Z]{2,}"), "natural").otherwise("mixed")


def classify_intent(prompt: Column) -> Column:
    """code, question or meta; a code-like name in the prompt always means code, an empty prompt is meta."""
    q = F.trim(prompt)
    # What marks code, talk about the work itself, and questions.
    code = q.rlike(r"[A-Z][a-z]+[A-Z]|[a-z]+[A-Z][a-zA-Z]|[a-z]+_[a-z]+|\.[A-Za-z0-9_]+\(|[A-Za-z0-9_./-]+\.[a-zA-Z]{1,5}([^A-Za-z0-9_]|$)|`[^`]+`")
    low = F.concat(F.lit(" "), F.lower(q), F.lit(" "))
    meta = low.rlike(r"^ (stop|done|thanks|thank you)[^a-z0-9_]|[^a-z0-9_]explain what you (did|just did|changed)[^a-z0-9_]|[^a-z0-9_](commit|push|merge|revert|stash|summarize|pull request|thanks|thank you|pr)[^a-z0-9_]")
    question = low.rlike(r"[^a-z0-9_](explain|why|how does|what is|tell me about)[^a-z0-9_]")
    return F.when(q == "", "meta").when(code, "code").when(meta, "meta").when(question, "question").otherwise("code")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def extension_class(path: Column) -> Column:
    """symbols, text or other: what a file of this extension is indexed for."""
    e = extension(path)
    return F.when(e.isin(*SYMBOL_EXTENSIONS), "symbols").when(e.isin(*TEXT_EXTENSIONS), "text").otherwise("other")


def parse_language(path: Column) -> Column:
    """The language that the line scanners treat a path as."""
    e = extension(path)
    return F.when(e.isin("ts", "tsx"), "typescript").when(e.isin("js", "jsx", "mjs", "cjs"), "javascript").when(e == "py", "python").when(e == "go", "go").otherwise("text")


def canonical_language(language: Column) -> Column:
    """Spellings of a language brought together; null and empty give unknown."""
    low = F.lower(F.trim(language))
    named = F.when(low.isin("ts", "typescript"), "typescript").when(low.isin("js", "javascript"), "javascript").when(low.isin("py", "python"), "python").when(low.isin("go", "golang"), "go")
    return F.coalesce(named.when(low.isin("yml", "yaml"), "yaml").when(low.isin("md", "markdown"), "md").when(low.isin("json", "jsonc"), "json").when(low == "", "unknown").otherwise(low), F.lit("unknown"))


def token_estimate(chars: Column) -> Column:
    """ceil(characters / 4)."""
    return F.ceil(chars / 4).cast("bigint")


def glob_regex(pattern: str) -> str:
    """A regex for one ignore pattern: leading / anchors, ** crosses folders, * stays within one; it matches a path's prefix of whole segments."""
    body = pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + re.escape(body[i]).replace("/", "/"), i + 1
    anchored = pattern.startswith("/") or "/" in body
    return ("^" if anchored else "(^|.*/)") + out + "(/.*)?$"


def ignore_rules(extra: tuple[str, ...] = ()) -> list[tuple[str, bool]]:
    """(regex, ignored) in order; the last rule that matches a path decides."""
    rules = [*IGNORED_DIRS, *IGNORED_PATTERNS, *extra, *(f"!{d}" for d in KEPT_DIRS)]
    return [(glob_regex(r.lstrip("!")), not r.startswith("!")) for r in rules]


def is_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last matching rule ignores the path; absolute paths and those that leave the root are ignored."""
    decided = F.lit(None).cast("boolean")
    for regex, ignored in rules:
        decided = F.when(path.rlike(regex), F.lit(ignored)).otherwise(decided)
    return F.coalesce(decided, F.lit(False)) | ~is_safe_path(path)


def is_safe_path(path: Column) -> Column:
    """False for null, empty and absolute paths, NUL characters and paths that climb above the root."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    # depth after each part; a climb above the root shows as a negative depth on the way
    low = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda a, x: F.struct((a.d + F.when(x == "..", -1).otherwise(1)).alias("d"), F.least(a.m, a.d + F.when(x == "..", -1).otherwise(1)).alias("m")), lambda a: a.m)
    return F.coalesce((path != "") & ~path.startswith("/") & ~path.rlike(r"^[A-Za-z]:[\\/]") & ~path.contains("\x00") & (low >= 0), F.lit(False))


def is_scoped_walk(path: Column, depth: Column) -> Column:
    """Whether a listing names a real folder and does not recurse: cheap and fine."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"^\./", ""), r"/+$", "")
    return F.when(clean.isin("", ".", "*") | clean.contains("**"), False).when((clean == ".git") | clean.startswith(".git/"), True).otherwise(F.coalesce(depth, F.lit(0)) <= 1)


def is_shell_discovery(command: Column) -> Column:
    """Whether a shell command searches the tree in its first pipe stage (grep -r, rg, find -name, ag, ack, git grep) or lists it into a filter."""
    c = F.trim(F.coalesce(command, F.lit("")))
    piped = c.rlike(r"(?is)\bls\b.*\|\s*(grep|rg|ag|ack)\b") | c.rlike(r"(?is)\bfind\b.*\bxargs\b") | c.rlike(r"(?is)\bfor\s+\w+\s+in\b.*\b(grep|rg)\b")
    segments = F.transform(F.split(F.split_part(c, F.lit("|"), F.lit(1)), r"\s*(?:&&|;)\s*"), lambda s: F.regexp_replace(F.trim(s), r"^(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s+)+", ""))
    one_file = r"\S*[^/\s]\.[A-Za-z0-9]{1,10}[\"']?(\s+-\S+)*$"
    grep = r"^[ef]?grep\s"

    def found(s: Column) -> Column:
        recursive = s.rlike(grep + r"(.*\s)?(-[A-Za-z]*[rR][A-Za-z]*|--recursive|--dereference-recursive)(\s|$)")
        walks = s.rlike(grep) & ~s.rlike(one_file) & s.rlike(grep + r"(-\S+\s+)*(\"[^\"]*\"|'[^']*'|\S+)\s+[^-\s]")
        ripgrep = s.rlike(r"^(rg|ripgrep)(\s|$)") & ~s.rlike(one_file)
        return recursive | walks | ripgrep | s.rlike(r"^(ag|ack)(\s|$)") | s.rlike(r"^git\s+grep(\s|$)") | s.rlike(r"^find\s(.*\s)?-(name|iname|path|ipath|regex|type|wholepath)(\s|$)")

    return piped | F.exists(segments, found)


def literals_of_regex(pattern: str) -> list[str]:
    """Runs of at least two characters that every match must contain; none where the pattern has alternatives, options or classes."""
    if re.search(r"[|?*+{}\[\]()\\^$.]", pattern):
        return []
    return [run for run in pattern.split() if len(run) >= 2][:4]


def snippet_around(lines: Column, line: Column, radius: int = 2, most: int = 800) -> Column:
    """``N| text`` of the lines around a 1-based line, joined by line breaks, at most 800 characters."""
    first = F.greatest(line - radius, F.lit(1)).cast("int")
    size = F.least(line + radius, F.size(lines)).cast("int") - first + 1
    numbered = F.transform(F.slice(lines, first, size), lambda x, i: F.concat((i + first).cast("string"), F.lit("| "), x))
    return F.substring(F.array_join(numbered, "\n"), 1, most)


def health_class(metric: str, value: Column) -> Column:
    """ok, warn or bad; null for a null value. Limits are fixed values of each metric."""
    if metric == "net":
        c = F.when(value > 0, "ok").when(value == 0, "warn")
    elif metric == "timeouts":
        c = F.when(value == 0, "ok").when(value <= 3, "warn")
    else:
        good, fair = {"hit_rate": (0.5, 0.25), "coverage": (0.8, 0.5), "mcp_ok": (0.95, 0.8)}[metric]
        c = F.when(value >= good, "ok").when(value >= fair, "warn")
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), c.otherwise("bad"))
