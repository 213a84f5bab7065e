"""Files that are not hand-written: generated, minified, third-party or mere data.

Third-party code shows by where it came from: Merkle hashes are computed bottom-up over every
workspace's directory tree, and a file or subtree found under two unrelated owners is a vendored
copy; copies that were patched since share most of their three-line shingles with one file.
Notices in the first or last comment of a file, names and folders that tools use, and the layout of
minified and data-only files say the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import scanners
from lodestone.sources.storage import cut_lineage

# Extensions of source files; documents, configuration, SQL and JSON are not cases.
SOURCE = ("py", "pyi", "ts", "tsx", "js", "jsx", "mjs", "cjs", "go", "css", "java", "c", "h", "cc", "cpp", "rs", "rb", "php", "cs", "kt", "swift")
# Folders that hold third-party copies or the output of tools, and names that tools give.
VENDOR_PATH = r"(^|/)(vendor|vendored|node_modules|bower_components|third_party|third-party|thirdparty|external|Godeps/_workspace|deps/upstream|contrib/imported|site-packages|jspm_packages)/"
GENERATED_PATH = r"(^|/)(generated|__generated__|autogen|gen|_generated|generated-sources)/"
GENERATED_NAME = r"(_pb2(_grpc)?\.pyi?|_pb(_grpc)?(\.d)?\.[jt]s|\.pb(\.gw)?\.go|\.(generated|gen|g)\.\w+|_(gen|generated)\.\w+|/zz_generated[^/]*)$"
MINIFIED_NAME = r"(\.min\.\w+|/(dist|build|public|static|assets)/([^/]+/)*[^/]+\.[0-9a-f]{6,}\.(js|mjs|cjs|css))$"

# How tools' notices speak, in the languages they are met in.
_GENERATED = re.compile(
    r"^\W*(code |file |output )?generated (by|from|on)\b|code generated by|(file|code|module) (is|was) generated\b|auto-?generated|automatically generated|@generated"
    r"|do not (edit|modify)\s*(!|\.|this file|by hand|$)|machine-(written|generated)|produced from \S+\.\w+|compiled (with|from|by) \w|hand edits (get|will be) (overwritten|lost)|changes will be (lost|overwritten)"
    r"|automatisch (erzeugt|generiert|erstellt)|généré automatiquement|automatiquement généré|(generado|gerado|generato) autom|автоматически (с|соз|ген)|自动生成|自動生成|자동 생성",
    re.I | re.M,
)
_THIRD_PARTY = re.compile(r"\(c\) (\d{4} )?(the )?[\w.-]+ (authors|contributors|developers)|upstream release|redistribution and use in source|licensed under the (apache|mit|bsd|mozilla|gnu)", re.I)
_COMMENT = re.compile(r"\s*(//|#|/\*|\*|<!--|--|\"\"\"|''')|\s*$")
_ACTIVE = frozenset("def class function func if for while return try with switch => lambda import from interface type enum async await new".split())
# Files too small to tell a copy by.
COPY_CHARS, COPY_SHINGLES = 200, 8
DATA_CHARS, DATA_LITERALS = 1000, 50
#: Parts of a hot shingle; also, one in so many texts is looked at to find these, of which so many must hold it.
SALTS, SAMPLED_OFTEN = 64, 8


def _comments_around(lines: list[str]) -> list[str]:
    """Lines of the comments that open and close the file."""
    head = 0
    while head < len(lines) and _COMMENT.match(lines[head]):
        head += 1
    tail = len(lines)
    while tail > head and _COMMENT.match(lines[tail - 1]):
        tail -= 1
    return lines[:head] + lines[tail:]


def _is_minified(kind: str, text: str, lines: list[str]) -> bool:
    """Scripts and styles whose characters stand in long lines almost without white space."""
    if kind not in ("js", "mjs", "cjs", "ts", "jsx", "tsx", "css") or len(text) < 400:
        return False
    code = [line for line in lines if not _COMMENT.match(line)] or lines
    size = sum(map(len, code))
    dense = sum(len(line) for line in code if len(line) > 200)
    blanks = sum(line.count(" ") + line.count("\t") for line in code)
    return dense >= 0.9 * size and blanks <= 0.06 * size


def _is_data(kind: str, text: str) -> bool:
    """A large literal and nothing else: no code, a single name, numbers or packed strings."""
    if len(text) < DATA_CHARS:
        return False
    scan = {"py": scanners.scan_python, "go": scanners.scan_go}.get(kind, scanners.scan_js if kind in ("js", "mjs", "cjs", "ts") else None)
    if scan is None:
        return False
    try:
        tokens = scan(text)
    except scanners.ScanError:
        return False
    names = numbers = strings = packed = literal = 0
    for i, (token, at, _) in enumerate(tokens):
        if token in _ACTIVE:
            return False
        if token in ("num", "str"):
            end = tokens[i + 1][1] if i + 1 < len(tokens) else len(text)
            value = text[at:end].strip()
            literal += len(value)
            if token == "num":
                numbers += 1
            else:
                strings += 1
                packed += len(value) if len(value) >= 40 and " " not in value else 0
        elif token in ("=", ":="):
            names += 1
    if names != 1:
        return False
    return packed >= 0.6 * len(text) or (numbers + strings >= DATA_LITERALS and numbers > strings and literal + 2 * (numbers + strings) >= 0.6 * len(text))


def inspect(path: str, text: str | None) -> tuple[str | None, int | None, int, list[int]]:
    """(reason, hash of the content, characters that count, shingle hashes) of one file's text."""
    if not text:
        return None, None, 0, []
    kind = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    lines = [line.rstrip() for line in text.lstrip("﻿").split("\n")]
    notices = "\n".join(_comments_around(lines))
    reason = None
    if _GENERATED.search(notices):
        reason = "generated"
    elif _THIRD_PARTY.search(notices):
        reason = "third-party"
    elif _is_minified(kind, text, lines):
        reason = "minified"
    elif _is_data(kind, text):
        reason = "data"
    full = [line.strip() for line in lines if line.strip()]
    encoded = [line.encode("utf-8", "surrogatepass") for line in full]
    content = np.uint64(xxhash.xxh64_intdigest(b"\n".join(encoded))).view(np.int64)
    shingles = {xxhash.xxh64_intdigest(b"\n".join(encoded[i : i + 3])) for i in range(max(1, len(encoded) - 2))}
    hashes = np.array(sorted(shingles), dtype=np.uint64).view(np.int64)
    return reason, int(content), sum(map(len, full)), hashes.tolist()


def _inspected(corpus: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [inspect(p, t) for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                names=["workspace", "path", "reason", "content", "chars", "shingles"],
            )

    return corpus.select("workspace", "path", "content").mapInArrow(run, "workspace string, path string, reason string, content bigint, chars bigint, shingles array<bigint>")


def merkle_nodes(leaves: DataFrame) -> DataFrame:
    """(workspace, node, hash, chars) of every file and folder, from leaves (workspace, path, content, chars).

    A folder's hash is made of the hashes of its entries, not of their names: copies keep their hash
    when files are renamed. Sum, parity and number of the entries' hashes are combined, so the entries
    of a folder with millions of files are aggregated before the shuffle and never gathered. One pass
    for each level of the deepest path, which reads the files of that level only.
    """
    nodes = cut_lineage(leaves.select("workspace", F.col("path").alias("node"), F.col("content").alias("hash"), "chars", F.size(F.split("path", "/")).alias("depth")), by="depth")
    deepest = nodes.agg(F.max("depth")).head()[0] or 0
    levels, below = [nodes], None
    for depth in range(deepest, 1, -1):
        entries = nodes.where(F.col("depth") == depth)
        entries = entries if below is None else entries.unionByName(below)
        mixed = F.xxhash64("hash")
        below = cut_lineage(
            entries.withColumn("node", F.regexp_replace("node", "/[^/]*$", ""))
            .groupBy("workspace", "node")
            .agg(F.sum(mixed.cast("decimal(38,0)")).alias("s"), F.bit_xor(mixed).alias("x"), F.count("*").alias("n"), F.sum("chars").alias("chars"))
            .select("workspace", "node", F.xxhash64("s", "x", "n").alias("hash"), "chars", F.lit(depth - 1).alias("depth"))
        )
        levels.append(below)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _owner(workspace: str = "workspace"):
    return F.xxhash64(F.split_part(F.col(workspace), F.lit("/"), F.lit(1)))


def shared_nodes(nodes: DataFrame, least_chars: int = 200) -> DataFrame:
    """(workspace, node) of files and folders whose hash is found under two owners; tiny ones do not count."""
    counted = nodes.where(F.col("chars") >= least_chars).select("workspace", "node", "hash")
    shared = counted.groupBy("hash").agg(F.min(_owner()).alias("a"), F.max(_owner()).alias("b")).where("a != b").select("hash")
    return counted.join(shared, "hash").select("workspace", "node")


def _held_between_owners(texts: DataFrame) -> DataFrame:
    """(content, chars, lo, hi, k, shingle, n): shingles of the texts that two owners hold, n being the number of texts that hold each.

    One exchange serves the counts and the holders. Shingles that a 64th of the texts shows in more than a
    thousandth of all (and eight of that sample) are spread over 64 parts; there are at most a thousand times as many
    of these as a text has shingles.
    """
    often = max(SAMPLED_OFTEN, texts.count() // SALTS // 1000)
    sampled = texts.where(F.pmod(F.xxhash64("content", F.lit("sample")), F.lit(SALTS)) == 0).select(F.explode("shingles").alias("shingle"))
    hot = F.broadcast(cut_lineage(sampled.groupBy("shingle").agg(F.count("*").alias("c")).where(F.col("c") >= often).select("shingle", F.lit(True).alias("hot"))))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("content"), F.lit(SALTS))).otherwise(-1).cast("int")
    held = texts.select("content", "chars", "lo", "hi", F.size("shingles").alias("k"), F.explode("shingles").alias("shingle"))
    columns = ["content", "chars", "lo", "hi", "k", "shingle"]
    salted = held.join(hot, "shingle", "left").select(*columns, salt.alias("salt")).where("salt is not null and shingle is not null").repartition("shingle", "salt")
    parts = salted.groupBy("shingle", "salt").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.expr("count(content, chars, k)").alias("m"))
    spread = F.broadcast(parts.where("salt >= 0").groupBy("shingle").agg(F.min("first").alias("hot_first"), F.max("last").alias("hot_last"), F.sum("m").alias("hot_m")))
    # both uses of the exchange read all its columns and filter none of its keys, else they would not share it
    joined = salted.join(parts.hint("shuffle_hash"), ["shingle", "salt"]).join(spread, "shingle", "left")
    return joined.where(F.coalesce("hot_first", "first") != F.coalesce("hot_last", "last")).select(*columns, F.coalesce("hot_m", "m").alias("n"))


def patched_copies(written: DataFrame, least_share: float = 0.7) -> DataFrame:
    """(workspace, path) of files of which ``least_share`` of the shingles stand in one file of another owner, of like size.

    Takes (workspace, path, content, chars, shingles) and finds all of them: a text that has its share
    in another must share with it one of any (1 - share) * k + 1 of its k shingles, so only its rarest
    ones are looked up. Texts are compared once for all their copies; those that two owners hold are
    partners but not judged, as equal content tells them already. Partners at the ends of a shingle's
    holders are tried first, so most of a widely copied file's versions never meet all the others; what
    they leave undecided is compared with every holder. Every pair is verified on whole shingle sets.
    """
    sized = written.where((F.col("chars") >= COPY_CHARS) & (F.size("shingles") >= COPY_SHINGLES))
    texts = cut_lineage(sized.groupBy("content").agg(F.first("chars").alias("chars"), F.first("shingles").alias("shingles"), F.min(_owner()).alias("lo"), F.max(_owner()).alias("hi")))
    held = cut_lineage(_held_between_owners(texts))

    need = F.ceil(F.col("k") * least_share - 1e-9)
    rarest = F.sort_array(F.collect_list(F.struct("n", "shingle")))
    judged = held.where("lo = hi").groupBy("content", "lo", "chars", "k").agg(rarest.alias("met")).where(F.size("met") >= need)
    probes = cut_lineage(judged.select(F.col("content").alias("x"), F.col("lo").alias("owner"), F.col("chars").alias("size"), need.alias("need"), F.explode(F.slice("met", F.lit(1), (F.size("met") - need + 1).cast("int"))).alias("met")).select("x", "owner", "size", "need", "met.shingle"))

    def alike(partners: DataFrame, asked: DataFrame) -> DataFrame:
        fits = ((F.col("lo") != F.col("owner")) | (F.col("hi") != F.col("owner"))) & (F.col("chars") * 2 >= F.col("size")) & (F.col("chars") <= F.col("size") * 2) & (F.col("k") >= F.col("need"))
        pairs = asked.join(partners, "shingle").where(fits).select("x", F.col("content").alias("y"), "need").distinct()
        side = lambda name: texts.select(F.col("content").alias(name), F.col("shingles").alias(f"{name}_shingles"))
        both = pairs.join(side("x"), "x").join(side("y"), "y")
        return cut_lineage(both.where(F.size(F.array_intersect("x_shingles", "y_shingles")) >= F.col("need")).select("x").distinct())

    entry = F.struct("lo", "hi", "content", "chars", "k")
    ends = held.groupBy("shingle", F.floor(F.log2("chars")).alias("class")).agg(F.array(F.min(entry), F.max(entry)).alias("ends"))
    found = alike(ends.select("shingle", F.inline("ends")), probes)
    found = found.unionByName(alike(held, probes.join(found, "x", "left_anti")))
    return sized.join(found.withColumnRenamed("x", "content"), "content", "left_semi").select("workspace", "path")


def not_hand_written(files: DataFrame, corpus: DataFrame, least_share: float = 0.7) -> DataFrame:
    """(workspace, path, reason) of the files of ``files`` or ``corpus`` that are not hand-written source.

    Reasons: third-party, generated, minified, data; the first that holds. Only source files are
    judged: documents, configuration, SQL and JSON never are. A file without a text is judged by its
    path. Give current versions: one row for each (workspace, path). A null workspace is an owner of
    its own, rows with a null path are left out; empty texts match nothing, further columns are not read.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    by_path = F.when(F.col("path").rlike(VENDOR_PATH), "third-party").when(F.col("path").rlike(GENERATED_PATH) | F.concat(F.lit("/"), "path").rlike(GENERATED_NAME), "generated").when(F.concat(F.lit("/"), "path").rlike(MINIFIED_NAME), "minified")

    texts = corpus.where(F.col("path").isNotNull() & ext.isin(*SOURCE)).withColumn("workspace", F.coalesce("workspace", F.lit("")))
    seen = cut_lineage(_inspected(texts))
    written = seen.where("content is not null")
    listed = files.where(F.col("path").isNotNull() & ext.isin(*SOURCE)).select(F.coalesce("workspace", F.lit("")).alias("workspace"), "path")
    keys = listed.unionByName(seen.select("workspace", "path")).distinct()

    nodes = shared_nodes(merkle_nodes(written.select("workspace", "path", "content", "chars")))
    # a file lies in a shared subtree when it or one of its folders is shared
    parts = F.split("path", "/")
    up = written.select("workspace", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("node"))
    copied = up.join(nodes, ["workspace", "node"], "left_semi").select("workspace", "path").distinct()

    patched = patched_copies(written, least_share)

    vendored = copied.unionByName(patched).distinct().withColumn("shared", F.lit(True))
    found = keys.join(seen.select("workspace", "path", "reason"), ["workspace", "path"], "left").join(vendored, ["workspace", "path"], "left")
    reason = F.when(F.col("shared"), "third-party").when(by_path.isNotNull(), by_path).otherwise(F.col("reason"))
    return found.select("workspace", "path", reason.alias("reason")).where("reason is not null").distinct()


