"""Vectors as arrays: inner products and the feature-hash embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product in double over the shorter length; null where either is null."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda x: F.transform(F.slice(x, 1, n), lambda v: v.cast("double"))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.zip_with(cut(a), cut(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; null where either is null or of no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def embedding_tokens(text: Column) -> Column:
    """Words of the lower-cased text with repeats, then its distinct letter-digit parts."""
    low = F.lower(text)
    words = F.filter(F.split(low, r"[ \t\r\n]+"), lambda x: x != "")
    parts = F.array_distinct(F.filter(F.split(low, "[^a-z0-9]+"), lambda x: x != ""))
    return F.concat(words, parts)


def _u32(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def hash_embedding(rows: DataFrame, id_col: str, text_col: str, dim: int = 256) -> DataFrame:
    """(id, idx, weight): the non-zero components of each text's feature-hash embedding, not normalised.

    Each token adds +-1 at one place and +-0.5 at another, both taken from its SHA-256. Null and
    empty texts give no rows. Sparse form: the sum is aggregated map-side by (id, idx).
    """
    digest = F.sha2(F.col("token").cast("binary"), 256)
    tokens = rows.select(F.col(id_col), F.explode(embedding_tokens(F.col(text_col))).alias("token")).withColumn("d", digest)
    sign = lambda start: F.when(F.conv(F.substring("d", start, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    first = F.struct((_u32(F.col("d"), 1) % dim).cast("int").alias("idx"), sign(9).alias("w"))
    second = F.struct((_u32(F.col("d"), 17) % dim).cast("int").alias("idx"), (sign(25) * 0.5).alias("w"))
    return tokens.select(id_col, F.inline(F.array(first, second))).groupBy(id_col, "idx").agg(F.sum("w").alias("weight"))


def hash_embedding_of(text: str, dim: int = 256) -> np.ndarray:
    """The same for one text of the driver's, of unit length (zeros for no tokens)."""
    low = text.lower()
    words = [w for w in low.split() if w]
    parts = list(dict.fromkeys(p for p in "".join(c if c.isascii() and c.isalnum() else " " for c in low).split()))
    out = np.zeros(dim)
    for token in words + parts:
        d = hashlib.sha256(token.encode()).digest()
        out[int.from_bytes(d[0:4], "big") % dim] += 1 if d[4] % 2 == 0 else -1
        out[int.from_bytes(d[8:12], "big") % dim] += 0.5 if d[12] % 2 == 0 else -0.5
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def _embed(lists: pa.ListArray, dim: int) -> np.ndarray:
    """One row for each list of tokens; distinct tokens are hashed once."""
    coded = lists.flatten().dictionary_encode()
    digests = b"".join(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in coded.dictionary.to_pylist())
    word = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 32).astype(np.int64)
    place = lambda at: (word[:, at] << 24 | word[:, at + 1] << 16 | word[:, at + 2] << 8 | word[:, at + 3]) % dim
    sign = lambda at: np.where(word[:, at] % 2 == 0, 1.0, -1.0)
    code, row = coded.indices.to_numpy(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    flat = np.bincount(row * dim + place(0)[code], sign(4)[code], len(lists) * dim) + np.bincount(row * dim + place(8)[code], 0.5 * sign(12)[code], len(lists) * dim)
    return flat.reshape(-1, dim)


def _by_rows(rows: DataFrame, id_col: str, text_col: str, field: T.StructField, dim: int, made: Callable[[np.ndarray], pa.Array]) -> DataFrame:
    """(id, field) of what ``made`` makes of the unit embeddings of a batch; texts without tokens or of no length give no row."""
    tokens = rows.select(F.col(id_col), embedding_tokens(F.col(text_col)).alias("__tokens")).where(F.size("__tokens") > 0)
    schema = T.StructType([tokens.schema[0], field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                vectors = _embed(batch.column(1), dim)
                norm = np.sqrt((vectors * vectors).sum(1))
                keep = np.flatnonzero(norm > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), made(vectors[keep] / norm[keep, None])], names=schema.names)

    return tokens.mapInArrow(run, schema)


def hash_vectors(rows: DataFrame, id_col: str, text_col: str, dim: int = 256) -> DataFrame:
    """(id, embedding): unit feature-hash embeddings as arrays, in one pass and without a shuffle; what an index stores."""

    def packed(unit: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, dim, dtype=np.int32)), pa.array(unit.ravel()))

    return _by_rows(rows, id_col, text_col, T.StructField("embedding", T.ArrayType(T.DoubleType())), dim, packed)


def hash_similarity(rows: DataFrame, id_col: str, text_col: str, query: str, dim: int = 256) -> DataFrame:
    """(id, score): cosine of each text's feature-hash embedding with the query's, in one pass and without a shuffle.

    Tokens are split by the JVM; each batch hashes its distinct tokens once. Texts without tokens give no row.
    """
    wanted = hash_embedding_of(query, dim)
    return _by_rows(rows, id_col, text_col, T.StructField("score", T.DoubleType()), dim, lambda unit: pa.array((unit * wanted).sum(1)))
