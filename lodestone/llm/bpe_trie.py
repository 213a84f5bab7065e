"""Byte-pair encoding of a corpus by prefix-sharing trie traversal.

The encoding of a byte string by byte-pair merging is fixed by its *last token*: if ``t`` is the
last token of a prefix ``p``, what comes before ``t`` is the encoding of ``p`` without ``t``.
And ``t`` is the last token exactly when it is a suffix of ``p`` and stands compatibly after the
last token of the remaining prefix, that is when those two tokens' bytes merge to just the two.
So each node of a trie of words needs one token id; words that share a prefix share the work, and
a word's ids are read by walking back from its node.

Words are the pieces of the tokenizer's own pre-tokenising pattern. Each task keeps one trie for
all its documents, so nothing is shuffled; the trie is dropped when it, the words or the remembered
pairs reach their bounds, which keep a worker's share below 150 MB.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pre-tokenising pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Nodes, words (of up to ``WORD_BYTES`` bytes in all) and pairs of tokens that a worker remembers.
MAX_NODES, MAX_WORDS, WORD_BYTES, MAX_PAIRS = 300_000, 100_000, 4_000_000, 200_000
#: Longer pieces are encoded by the same recurrence over an array of their own, outside the trie.
LONG_PIECE = 256


class TrieEncoder:
    """Encodes words; state is shared between all words it has seen."""

    def __init__(self, ranks: dict[bytes, int], max_nodes: int = MAX_NODES):
        self.ranks = ranks
        self.text_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.max_nodes = max_nodes
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}  # node * 256 + byte -> node
        self.last = array("i", [-1])  # last token of the prefix at the node
        self.words: dict[str, array] = {}
        self.word_bytes = 0

    def merge(self, text: bytes) -> list[int]:
        """Plain merging by rank; only ever applied to the bytes of one or two tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(self.text_of[token]) == [token]
        return known

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= MAX_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self.merge(self.text_of[left] + self.text_of[right]) == [left, right]
        return known

    def last_token(self, prefix: bytes, end: int, last: list[int]) -> int:
        """Last token of prefix[:end]; last[k] is that of prefix[:k] for every k < end."""
        for size in range(min(end, self.longest), 0, -1):
            token = self.ranks.get(prefix[end - size : end])
            if token is not None and self.reachable(token) and (size == end or self.compatible(last[end - size], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def trace(self, data: bytes, last: list[int]) -> array:
        out, end = array("i"), len(data)
        while end:
            out.append(last[end])
            end -= len(self.text_of[last[end]])
        out.reverse()
        return out

    def add_words(self, words: list[str]) -> None:
        """Insert distinct words; in sorted order their walk is the trie's depth-first order."""
        children, last_of = self.children, self.last
        for word in sorted(words):
            data = word.encode("utf-8", "surrogatepass")
            last = [-1] * (len(data) + 1)
            if len(data) > LONG_PIECE:
                for end in range(1, len(data) + 1):
                    last[end] = self.last_token(data, end, last)
            else:
                node = 0
                for end, byte in enumerate(data, 1):
                    child = children.get(node << 8 | byte)
                    if child is None:
                        child = children[node << 8 | byte] = len(last_of)
                        last_of.append(self.last_token(data, end, last))
                    node = child
                    last[end] = last_of[node]
            self.words[word] = self.trace(data, last)
            self.word_bytes += len(data)

    def split(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them known afterwards."""
        pieces = [PIECES.findall(t) if t else [] for t in texts]
        if len(self.last) > self.max_nodes or len(self.words) > MAX_WORDS or self.word_bytes > WORD_BYTES:
            self.clear()
        self.add_words(list(set(chain.from_iterable(pieces)).difference(self.words)))
        return pieces

    def encode_batch(self, texts: list[str | None]) -> tuple[array, list[int]]:
        """(ids of all texts one after another, where each text's ids end)."""
        pieces = self.split(texts)
        get = self.words.__getitem__  # only now: a full encoder begins a new dictionary
        flat, ends = array("i"), []
        for words in pieces:
            for ids in map(get, words):
                flat += ids
            ends.append(len(flat))
        return flat, ends

    def count_batch(self, texts: list[str | None]) -> list[int]:
        """Number of ids of each text."""
        pieces = self.split(texts)
        get = self.words.__getitem__
        return [sum(map(len, map(get, words))) for words in pieces]


PIECES = regex.compile(PATTERN)
_ENCODERS: dict[int, TrieEncoder] = {}


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def encoder_for(raw: bytes) -> TrieEncoder:
    """One encoder for each vocabulary and Python worker: tasks that follow find it warm."""
    key = hash(raw)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TrieEncoder(read_ranks(raw))
    return _ENCODERS[key]


def _portions(batch: pa.RecordBatch, text: int, rows: int = 256, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of so many rows and bytes of text; a longer text has its own."""
    begin = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
        if i > begin and (i - begin == rows or held + n > size):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def encode_corpus(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.tiktoken",
    tokenizers: str = TOKENIZERS,
) -> DataFrame:
    """(id, ids): token ids of each text, one row for each input row.

    Null and empty texts give an empty list; blank ones are encoded like any other text, and the
    text of a special token is ordinary text. Rows repeated in the input are repeated in the
    output, and further columns of the input are not read. Texts are encoded whole.

    The vocabulary is read on the driver and broadcast: a fixed file of under 1 MB.
    """
    with open(f"{tokenizers}/{vocabulary}", "rb") as f:
        raw = documents.sparkSession.sparkContext.broadcast(f.read())
    ids = documents.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([ids.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(raw.value)
        for batch in batches:
            for part in _portions(batch, 1):
                flat, ends = encoder.encode_batch(part.column(1).to_pylist())
                values = pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32), pa.int32())
                rows = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values, type=pa.list_(pa.field("element", pa.int32(), False)))
                yield pa.RecordBatch.from_arrays([part.column(0), rows], names=[id_col, "ids"])

    return ids.mapInArrow(run, schema)


def token_counts(documents: DataFrame, text_col: str = "text", out_col: str = "n_tokens", vocabulary: str = "byte_bpe_50k.tiktoken", tokenizers: str = TOKENIZERS) -> DataFrame:
    """``documents`` with a column of the number of tokens of its text; 0 for null and empty texts."""
    with open(f"{tokenizers}/{vocabulary}", "rb") as f:
        raw = documents.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([*documents.schema.fields, T.StructField(out_col, T.LongType(), False)])
    where = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(raw.value)
        for batch in batches:
            counts = [n for part in _portions(batch, where) for n in encoder.count_batch(part.column(where).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, out_col])

    return documents.mapInArrow(run, schema)
