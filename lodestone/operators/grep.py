"""Regular-expression search over lines, behind a sound prefilter of sparse n-grams."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import literals_of_regex, snippet_around

LONGEST = 12
#: Postings of one batch, and n-grams that a worker remembers.
HELD = 100_000
#: Texts and bytes that are split at once; a longer text is split in pieces of that many bytes. Hashes that a worker remembers meanwhile.
TEXTS, BYTES, KNOWN = 128, 3 << 17, 300_000


@lru_cache(maxsize=1)
def pair_weights() -> np.ndarray:
    """Weight of every pair of bytes: the first four bytes of its SHA-256."""
    return np.array([int.from_bytes(hashlib.sha256(bytes((a, b))).digest()[:4], "big") for a in range(256) for b in range(256)], dtype=np.int64)


def sparse_ngrams(data: bytes) -> list[bytes]:
    """Distinct substrings of 2 to 12 bytes, within a line, whose two end pairs outweigh every pair between them.

    All places of a text are tested at once, one length after another.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    weights = pair_weights()[raw[:-1].astype(np.int64) << 8 | raw[1:]] if len(raw) > 1 else np.empty(0, np.int64)
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    inside = np.full(len(weights), -1, dtype=np.int64)
    out: set[bytes] = set()
    for gap in range(min(LONGEST - 1, len(weights))):
        n = len(weights) - gap
        size = gap + 2
        good = breaks[size : size + n] == breaks[:n]
        if gap:
            if gap > 1:
                np.maximum(inside[:n], weights[gap - 1 : gap - 1 + n], out=inside[:n])
            good &= np.minimum(weights[:n], weights[gap:]) > inside[:n]
        at = np.flatnonzero(good)
        if len(at):
            grams = np.lib.stride_tricks.sliding_window_view(raw, size)[at]
            out.update(g.tobytes() for g in np.unique(np.ascontiguousarray(grams).view(f"V{size}").ravel()))
    return list(out)


def _ngrams_at_once(texts: Sequence[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``sparse_ngrams`` of few texts: their distinct n-grams, how many of these each text has, and which, one text after another.

    Lines end between the texts, so no n-gram is of two. From one length to the next only places stay whose first pair
    still outweighs all inside. An n-gram is compared as a number that holds its bytes and size, a long one's first eight
    bytes by their place among those that occur.
    """
    data = b"\n".join(texts) + b"\n" * LONGEST
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw) - LONGEST
    ends = np.flatnonzero(raw == 10)
    room = (np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(raw)))[:n]
    owner = np.repeat(np.arange(len(texts)), [len(t) + (i + 1 < len(texts)) for i, t in enumerate(texts)])
    two = raw[:-1].astype(np.uint16) << 8 | raw[1:]
    four = two[:-2].astype(np.uint32) << 16 | two[2:]
    eight = four[:-4].astype(np.uint64) << 32 | four[4:]
    weights = pair_weights()[two]
    where, keys, tails = [], [], []
    at = np.flatnonzero(room >= 2)
    inside = np.full(len(at), -1, dtype=np.int64)
    for size in range(2, LONGEST + 1):
        last = weights[at + size - 2]
        found = at[last > inside]
        where.append(found)
        if size < 8:
            keys.append(eight[found] >> np.uint64(64 - 8 * size) << np.uint64(8) | np.uint64(size))
        else:
            keys.append(eight[found])
            tails.append(four[found + 8].astype(np.uint64) >> np.uint64(8 * (LONGEST - size)) << np.uint64(8) | np.uint64(size))
        if size > 2:
            inside = np.maximum(inside, last)
        stay = (weights[at] > inside) & (room[at] > size)
        at, inside = at[stay], inside[stay]
    short = LONGEST - 1 - len(tails)
    heads = pa.array(np.concatenate(keys[short:])).dictionary_encode().indices.to_numpy().astype(np.uint64)
    coded = pa.array(np.concatenate([*keys[:short], heads << np.uint64(40) | np.concatenate(tails)])).dictionary_encode()
    ids, sizes, places = coded.indices.to_numpy(), coded.dictionary.to_numpy() & np.uint64(255), np.concatenate(where)
    begin = np.empty(len(sizes), dtype=np.int64)
    begin[ids] = places
    grams = [data[b : b + size] for b, size in zip(begin.tolist(), sizes.tolist(), strict=True)]
    has = np.zeros((len(texts), len(grams)), dtype=bool)
    has[owner[places], ids] = True
    return grams, has.sum(axis=1), np.nonzero(has)[1]


def ngrams_of_texts(texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """``_ngrams_at_once`` for all texts, some at a time. Whether bytes are an n-gram they alone decide, so pieces of a long text may overlap."""
    few: list[bytes] = []
    held = 0
    for text in texts.cast(pa.binary()).to_pylist():
        text = text or b""
        if few and (len(few) == TEXTS or held + len(text) > BYTES):
            yield _ngrams_at_once(few)
            few, held = [], 0
        if len(text) > BYTES:
            grams = list(set().union(*(_ngrams_at_once([text[b : b + BYTES + LONGEST - 1]])[0] for b in range(0, len(text), BYTES))))
            yield grams, np.array([len(grams)]), np.arange(len(grams))
        else:
            few.append(text)
            held += len(text)
    if few:
        yield _ngrams_at_once(few)


def covering_ngrams(literal: str) -> list[bytes]:
    """Few long n-grams that every text with the literal also has: longest first while they cover more, at most 8."""
    data = literal.encode()
    picked, covered = [], set()
    for gram in sorted(sparse_ngrams(data), key=lambda g: (-len(g), g)):
        at = data.find(gram)
        span = set(range(at, at + len(gram)))
        if not span <= covered:
            picked.append(gram)
            covered |= span
    return picked[:8]


def gram_hash(gram: bytes) -> str:
    return hashlib.sha256(gram).hexdigest()[:16]


def grams_of_text(text: pa.StringScalar) -> list[bytes]:
    return sparse_ngrams((text.as_py() or "").encode("utf-8", "surrogatepass"))


KEYS = ("workspace", "path")


def ngram_postings(files: DataFrame, keys: Sequence[str] = KEYS, text_col: str = "content", settled: bool = False) -> DataFrame:
    """(hash, keys), distinct: the sparse n-grams of every text, whole. Null texts give none; a file occurs once.

    ``settled``: each file has one row already, as in current versions, so the postings need not be compared with each other.
    A worker holds the n-grams of few texts at a time, and the hashes of at most ``HELD`` n-grams.
    """
    chosen = files.select(*keys, text_col)
    schema = T.StructType([T.StructField("hash", T.StringType()), *chosen.schema.fields[:-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, str] = {}
        for batch in batches:
            begin, sizes, hashes = 0, [], []
            for at, text in enumerate(batch.column(len(keys)), 1):
                if len(known) > HELD:
                    known.clear()
                grams = grams_of_text(text)
                hashes += [known.get(g) or known.setdefault(g, gram_hash(g)) for g in grams]
                sizes.append(len(grams))
                if len(hashes) >= HELD or at == batch.num_rows:
                    found = pa.array(hashes, pa.string())
                    order = pc.sort_indices(found)  # equal hashes side by side take less room
                    rows = pa.array(np.repeat(np.arange(begin, at), sizes), pa.int64()).take(order)
                    yield pa.RecordBatch.from_arrays([found.take(order), *[c.take(rows) for c in batch.columns[:-1]]], names=schema.names)
                    begin, sizes, hashes = at, [], []

    postings = chosen.mapInArrow(run, schema)
    return postings if settled else postings.distinct()


def ngram_lists(files: DataFrame, keys: Sequence[str] = KEYS, text_col: str = "content") -> DataFrame:
    """The rows of settled ``ngram_postings``, without their order: a text's hashes leave its worker as one list, its keys only once."""
    chosen = files.select(*keys, text_col)
    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField("hashes", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, str] = {}
        for batch in batches:
            begin = 0
            for grams, sizes, which in ngrams_of_texts(batch.column(len(keys))):
                if len(known) > KNOWN:
                    known.clear()
                hashes = pa.array([known.get(g) or known.setdefault(g, gram_hash(g)) for g in grams], pa.string())
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), hashes.take(pa.array(which)))
                rows = batch.slice(begin, len(sizes))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lists], names=schema.names)
                begin += len(sizes)

    return chosen.mapInArrow(run, schema).select(F.explode("hashes").alias("hash"), *keys)


def ngram_counts(files: DataFrame, text_col: str = "content") -> DataFrame:
    """(hash, n_paths): in how many texts each sparse n-gram occurs; ``files`` has one row for each file, as current versions have.

    Texts are counted where they are read: a worker sends the counts on when it holds ``HELD`` n-grams, and hashes only those.
    """
    schema = T.StructType([T.StructField("hash", T.StringType()), T.StructField("n", T.LongType())])

    def flush(counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(map(gram_hash, counts), pa.string()), pa.array(counts.values(), pa.int64())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for grams, _, which in ngrams_of_texts(batch.column(0)):
                counts.update(dict(zip(grams, np.bincount(which, minlength=len(grams)).tolist(), strict=True)))
                if len(counts) >= HELD:
                    yield flush(counts)
                    counts.clear()
        yield flush(counts)

    return files.select(text_col).mapInArrow(run, schema).groupBy("hash").agg(F.sum("n").alias("n_paths"))


def grep_candidates(postings: DataFrame, literals: list[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Files that hold every n-gram that covers the literals: relational division over the postings."""
    wanted = sorted({gram_hash(g) for literal in literals for g in covering_ngrams(literal)})
    found = postings.where(F.col("hash").isin(*wanted)).groupBy(*keys).agg(F.countDistinct("hash").alias("n"))
    return found.where(F.col("n") == len(wanted)).select(*keys)


def grep_lines(files: DataFrame, pattern: str, k: int | None = 20, keys: Sequence[str] = KEYS, text_col: str = "content", path_prefix: str | None = None) -> DataFrame:
    """(keys, line, text, snippet) of lines that match, the first k by path, the other keys and line (None: all).

    The keys name a file, its path last. A literal of the pattern filters whole texts before they are split
    into lines. Lines keep no carriage return. Null texts have no lines.
    """
    rows = files.select(*keys, text_col)
    if path_prefix:
        rows = rows.where(F.col(keys[-1]).startswith(path_prefix))
    for literal in literals_of_regex(pattern):
        rows = rows.where(F.contains(text_col, F.lit(literal)))
    lines = rows.select(*keys, F.transform(F.split(text_col, "\n"), lambda x: F.rtrim(x, F.lit("\r"))).alias("lines"))
    # only matching lines leave the text's own row, with their places
    marked = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(pattern), i + 1)), lambda i: i.isNotNull())
    hits = lines.select(*keys, "lines", F.explode(marked).alias("line"))
    out = hits.select(*keys, "line", F.element_at("lines", F.col("line")).alias("text"), snippet_around(F.col("lines"), F.col("line")).alias("snippet"))
    return out if k is None else out.orderBy(*reversed(keys), "line").limit(k)


def grep_fast(files: DataFrame, postings: DataFrame, pattern: str, k: int | None = 20, keys: Sequence[str] = KEYS, text_col: str = "content", file_keys: Sequence[str] | None = None) -> DataFrame:
    """The same rows as ``grep_lines``, with the texts narrowed by stored n-gram postings first where the pattern has a sure literal.

    ``file_keys``: the columns that name a file in the postings, where they are not the keys.
    """
    within = list(file_keys or keys)
    literals = literals_of_regex(pattern)
    chosen = files.join(grep_candidates(postings, literals, within), within, "left_semi") if literals else files
    return grep_lines(chosen, pattern, k, keys, text_col)
