"""Ranked retrieval: BM25, exact and LSH vector search, rank fusion, reranking and hybrid search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import expand_query
from lodestone.functions.vectors import dot, hash_embedding_of, hash_similarity
from lodestone.operators.bags import K1, B, best_of_block, gather_texts, split_texts
from lodestone.sources.storage import cut_lineage

IDF_FLOOR, RRF_K, MIN_COSINE = 1e-6, 60, 0.12


def terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order, with repeats; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def phrases_of(query: str) -> list[tuple[str, bool]]:
    """(term, is prefix) of a query: every expanded term exactly and as a prefix; punctuation only separates."""
    parts = dict.fromkeys(p for t in expand_query(query) for p in "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split())
    return [(p, prefix) for p in parts for prefix in (False, True)]


def ranked(df: DataFrame, id_col: str, k: int, digits: int = 6) -> DataFrame:
    """The k best rows of (id, score) with their rank, by rounded score and then id."""
    best = df.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))  # k rows


def _wanted(phrases: Sequence[str | tuple[str, bool]]) -> list[tuple[str, bool]]:
    pairs = [(p, False) if isinstance(p, str) else p for p in phrases]
    return [(p, prefix) for p, prefix in pairs if p.isascii() and p.isalnum()]  # no other term can occur


def term_counts(docs: DataFrame, ids: Sequence[str], text_col: str, phrases: Sequence[str | tuple[str, bool]]) -> DataFrame:
    """(ids, dl, hits, tf0, tf1, ...): length of each text in terms, and how often each phrase occurs in it."""
    wanted = _wanted(phrases)
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    # one pass of a regular expression finds the few terms that can matter; frequencies are counted among those
    prefixes = "|".join(sorted({p for p, prefix in wanted if prefix})) or "(?!)"
    exact = "|".join(sorted({p for p, prefix in wanted if not prefix})) or "(?!)"
    relevant = F.regexp_extract_all(low, F.lit(f"(?<![a-z0-9])((?:{prefixes})[a-z0-9]*|(?:{exact})(?![a-z0-9]))"), F.lit(1))
    counted = docs.select(*ids, F.regexp_count(low, F.lit("[a-z0-9]+")).alias("dl"), relevant.alias("t"))
    tf = [F.size(F.filter("t", (lambda p, pre: lambda x: x.startswith(p) if pre else x == p)(p, pre))) for p, pre in wanted]
    return counted.select(*ids, "dl", F.size("t").alias("hits"), *[c.alias(f"tf{i}") for i, c in enumerate(tf)])


def bm25(docs: DataFrame, id_col: str | Sequence[str], text_col: str, phrases: Sequence[str | tuple[str, bool]]) -> DataFrame:
    """(id, score) of the documents that hold a phrase; a prefix phrase counts every term that starts with it.

    One pass over the texts, while the plan is built: lengths and frequencies are array functions
    within the scan, corpus statistics are observed on the way, and only the counts of texts with a hit
    are written to the shared folder, where scoring reads them. Nothing is shuffled, whatever the size of
    the corpus or the frequency of a term. ``id_col`` may be several columns. Documents of null or empty
    text count in the average length and never match.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    wanted = _wanted(phrases)
    if not wanted:
        return docs.select(*ids, F.lit(0.0).alias("score")).limit(0)
    seen = Observation()
    stats = [F.count("*").alias("n"), F.sum("dl").alias("dl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(wanted))]]
    hits = cut_lineage(term_counts(docs, ids, text_col, phrases).observe(seen, *stats).where("hits > 0"))
    found = seen.get
    n, average = found["n"], (found["dl"] or 0) / (found["n"] or 1) or 1.0
    score = F.lit(0.0)
    for i in range(len(wanted)):
        odds = (n - found[f"n{i}"] + 0.5) / (found[f"n{i}"] + 0.5)
        idf = float(np.log(odds)) if odds > 1 else IDF_FLOOR
        f = F.col(f"tf{i}")
        score = score + F.when(f > 0, F.lit(max(idf, IDF_FLOOR)) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(average)))).otherwise(0.0)
    return hits.select(*ids, score.alias("score"))


def postings_of(docs: DataFrame, ids: Sequence[str], text_col: str) -> DataFrame:
    """(ids, length, term, tf, part): the postings of all texts, whole; ``part`` is the term's first two characters.

    Stored in folders by ``part``, a query reads those of its terms only. Texts without a term have a row of a null term, for the statistics.
    """
    tokens = docs.select(*ids, terms(F.col(text_col)).alias("t"))
    rows = tokens.select(*ids, F.size("t").alias("length"), F.explode_outer("t").alias("term"))
    return rows.groupBy(*ids, "length", "term").agg(F.count("term").alias("tf")).withColumn("part", F.coalesce(F.substring("term", 1, 2), F.lit("")))


def posting_stats(docs: DataFrame, text_col: str, *by: str) -> DataFrame:
    """(by, n, total): number and summed lengths of the texts, which a query would else have to read all postings for."""
    return docs.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.size(terms(F.col(text_col)))).alias("total"))


def bm25_stored(postings: DataFrame, stats: DataFrame, ids: Sequence[str], phrases: Sequence[str | tuple[str, bool]]) -> DataFrame:
    """(ids, score): the same as ``bm25``, from stored postings; the folders of the phrases' first letters are read and no text.

    Only postings of matching terms are shuffled; the document frequencies, one row for each phrase, reach the driver.
    """
    wanted = _wanted(phrases)
    totals = stats.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).head()
    if not wanted or not totals.n:
        return postings.select(*ids, F.lit(0.0).alias("score")).limit(0)
    average = (totals.total or 0) / totals.n or 1.0
    match = [(F.col("term").startswith(p) if prefix else F.col("term") == p) for p, prefix in wanted]
    folder = F.col("part").isin(*sorted({p[:2] for p, prefix in wanted}))
    for p, prefix in wanted:
        if prefix and len(p) < 2:
            folder = folder | F.col("part").startswith(p)
    hit = match[0]
    for m in match[1:]:
        hit = hit | m
    which = F.filter(F.array(*[F.when(m, i) for i, m in enumerate(match)]), lambda i: i.isNotNull())
    found = postings.where(folder).where(hit).select(*ids, "length", "tf", F.explode(which).alias("phrase"))
    counted = cut_lineage(found.groupBy(*ids, "length", "phrase").agg(F.sum("tf").alias("tf")))
    idf = {r.phrase: max(float(np.log(max((totals.n - r.df + 0.5) / (r.df + 0.5), 1.0))), IDF_FLOOR) for r in counted.groupBy("phrase").agg(F.count("*").alias("df")).collect()}
    if not idf:
        return postings.select(*ids, F.lit(0.0).alias("score")).limit(0)
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in idf.items() for x in pair]), F.col("phrase"))
    part = weight * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(average)))
    return counted.groupBy(*ids).agg(F.sum(part).alias("score"))


def terms_of(text: str) -> list[str]:
    """``terms`` of one string."""
    return re.findall("[a-z0-9]+", text.lower())


def bm25_batch(queries: DataFrame, docs: DataFrame, k: int = 10, query_id: str = "query_id", query_text: str = "query", id_col: str = "id", text_col: str = "text", **sizes: int) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of every query; ids are unique. Sizes are those of ``best_texts``.

    Queries are written to the shared folder and counted while the plan is built.
    """
    known = Observation()
    words = queries.select(F.col(query_id).alias("query_id"), F.explode(terms(F.col(query_text))).alias("term")).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("asked"))
    asked = cut_lineage(words.observe(known, F.approx_count_distinct("asked").alias("asked")))
    bags, counts = gather_texts(split_texts(docs.select(id_col, text_col), terms_of, k, id_col, text_col), k)
    return best_texts(asked, bags, counts | known.get, k, **sizes)


def best_of_own(docs: DataFrame, terms_of: Callable[[str], list[str]], asks: Column, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """docs, of which some are queries too: texts (id, rest, asked), of each id once, ``asked`` being null where not ``asks``, and hits as of ``best_texts``.

    docs (id, text, rest) are read and split once, while the plan is built, and written to the shared folder.
    """
    known = Observation()
    split = split_texts(docs.repartition("id").sortWithinPartitions("id"), terms_of, k, once=True)
    marked = split.withColumn("asked", F.when(asks, F.array_join(F.array_distinct(F.split("bag", " ")), " ")))
    texts = cut_lineage(marked.observe(known, F.approx_count_distinct("asked").alias("asked")))
    bags, counts = gather_texts(texts, k)
    hits = best_texts(texts.where("asked != ''").select(F.col("id").alias("query_id"), "asked"), bags, counts | known.get, k)
    return texts.drop("bag", "copies"), hits


def best_texts(asked: DataFrame, gathered: DataFrame, counts: dict, k: int = 10, block: int = 131_072, chunk: int = 4_096) -> DataFrame:
    """(query_id, id, score, rank): the k best texts of every query, from queries (query_id, asked), which are distinct terms in order as one string, and ``gather_texts``.

    Texts of the same terms are scored once, and so are queries. Blocks of texts meet blocks of queries, and each
    pair of blocks is scored over postings in arrays: what is shuffled are texts, queries and the k best of each
    block, never the pairs of queries and texts that share a term. Document frequencies, one row for each term
    asked for, join the terms of the queries. ``block`` texts, fewer if they have over 12 terms on average, and ``chunk``
    queries of other terms make a pair of blocks, however many copies they have. counts: those of ``gather_texts``
    and about how many queries ``asked`` differ.
    """
    n, average = counts["n"], counts["dl"] / (counts["n"] or 1) or 1.0
    blocks, chunks = int(-(-counts["bags"] * max(1.0, average / 12) // block)) or 1, -(-counts["asked"] // min(block, chunk)) or 1

    bags = gathered.where("bag != ''")
    wanted = asked.select("asked").distinct().select("asked", F.explode(F.split("asked", " ")).alias("term"))
    frequency = bags.select(F.explode(F.array_distinct(F.split("bag", " "))).alias("term"), "copies").groupBy("term").agg(F.sum("copies").alias("df"))
    idf = F.greatest(F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    weighted = wanted.join(frequency, "term").select("asked", "term", idf.alias("idf"))

    spread = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    parts = 3 * blocks * chunks + 32  # so that few pairs of blocks fall into one partition
    left = bags.select(spread("bag", blocks).alias("block"), every(chunks).alias("chunk"), "ids", "bag").repartition(parts, "block", "chunk")
    right = weighted.select(every(blocks).alias("block"), spread("asked", chunks).alias("chunk"), "asked", "term", "idf").repartition(parts, "block", "chunk")
    schema = T.StructType([T.StructField("asked", T.StringType()), T.StructField("id", gathered.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(lambda texts, some: best_of_block(texts, some, k, average), schema)
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
    top = found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.join(top, "asked").select("query_id", "id", "score", "rank")


HIT_KEY = ["workspace", "path", "line", "symbol"]


def lexical_union(symbols: DataFrame, chunks: DataFrame, files: DataFrame, phrases: Sequence[str | tuple[str, bool]], k: int = 20, path_prefix: str | None = None) -> DataFrame:
    """(workspace, path, line, symbol, source, score): the k best of three ranked sources.

    symbols and chunks (id, workspace, path, name, line, text) weigh 1.0 and 0.9, files without chunks
    (workspace, path, text) 0.8; each gives its best 3k, 2k and k, the best score of a (workspace, path,
    line, symbol) stays. The path prefix is applied below the top-k, which can only find more. Texts are
    read once; what is joined to the hits are ids, places and names.
    """
    within = (lambda d: d.where(F.col("path").startswith(path_prefix))) if path_prefix else (lambda d: d)
    order = [F.desc("score"), *HIT_KEY]

    def best(scored: DataFrame, weight: float, name: str, n: int) -> DataFrame:
        rows = within(scored).select("workspace", "path", "line", "symbol", F.lit(name).alias("source"), F.round(F.col("score") * weight, 6).alias("score"))
        return rows.orderBy(*order).limit(n)

    placed = lambda docs: docs.select("id", "workspace", "path", "line", F.col("name").alias("symbol")).join(bm25(docs, "id", "text", phrases), "id")
    key = ["workspace", "path"]
    bare = files.join(chunks.select(*key).distinct(), key, "left_anti")
    whole = bm25(bare, key, "text", phrases).select(*key, F.lit(0).alias("line"), F.lit("").alias("symbol"), "score")
    union = best(placed(symbols), 1.0, "symbols", 3 * k).unionByName(best(placed(chunks), 0.9, "chunks", 2 * k)).unionByName(best(whole, 0.8, "files", k))
    first = Window.partitionBy(*HIT_KEY).orderBy(F.desc("score"), "source")
    return union.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r").orderBy(*order).limit(k)


def cosine_topk(vectors: DataFrame, query: Sequence[float], id_col: str, vector_col: str, k: int = 8, least: float = MIN_COSINE, exclude: object = None) -> DataFrame:
    """The k vectors most similar to one query vector, exactly; cosine of unit vectors, at least ``least``."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(id_col), F.round(dot(F.col(vector_col), wanted), 4).alias("score")).where(F.col("score") >= least)
    return ranked(scored if exclude is None else scored.where(F.col(id_col) != exclude), id_col, k, 4)


def rrf(rankings: Sequence[DataFrame], id_col: str, k: int = 20) -> DataFrame:
    """(id, score, rank) by reciprocal rank fusion of lists with ``rank`` from 1: sum of 1 / (60 + rank)."""
    union = rankings[0].select(id_col, "rank")
    for other in rankings[1:]:
        union = union.unionByName(other.select(id_col, "rank"))
    fused = union.groupBy(id_col).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))
    return ranked(fused, id_col, k, 9)


def rerank_overlap(hits: DataFrame, query: str, text_col: str = "snippet", id_col: str = "path", k: int = 8) -> DataFrame:
    """At most k of the hits by the share of the query's terms in their text, then by their own score; a deterministic stand-in for a cross-encoder."""
    asked = sorted({p for p, prefix in phrases_of(query) if not prefix})
    share = F.size(F.array_intersect(F.array_distinct(terms(F.col(text_col))), F.array(*[F.lit(a) for a in asked]).cast("array<string>"))) / F.lit(float(max(1, len(asked))))
    return hits.withColumn("overlap", F.round(share, 6)).orderBy(F.desc("overlap"), F.desc("score"), id_col).limit(k)


def is_identifier(query: str) -> bool:
    """Whether a query is a single name, which only its letters can find."""
    return " " not in query.strip() and query.strip().replace(".", "").replace("_", "").isalnum()


def hybrid_stored(postings: DataFrame, stats: DataFrame, vectors: DataFrame, query: str, id_col: str = "id", k: int = 20) -> DataFrame:
    """(id, score, rank): the same as ``hybrid_search``, from stored postings and vectors (id, embedding)."""
    lexical = ranked(bm25_stored(postings, stats, [id_col], phrases_of(query)), id_col, k)
    if is_identifier(query):
        return lexical
    return rrf([lexical, cosine_topk(vectors, hash_embedding_of(query).tolist(), id_col, "embedding", k)], id_col, k)


def hybrid_search(docs: DataFrame, query: str, id_col: str, text_col: str, k: int = 20) -> DataFrame:
    """(id, score, rank): BM25 and the feature-hash cosine fused by reciprocal rank; a single identifier is searched lexically only."""
    lexical = ranked(bm25(docs, id_col, text_col, phrases_of(query)), id_col, k)
    if is_identifier(query):
        return lexical
    similar = hash_similarity(docs, id_col, text_col, query).where(F.col("score") >= MIN_COSINE)
    return rrf([lexical, ranked(similar, id_col, k, 4)], id_col, k)


def hyperplanes(dim: int, bits: int = 12, tables: int = 8) -> np.ndarray:
    """tables x bits x dim components in [-1, 1] from SHA-256 of their position; every table has its own."""
    out = np.empty((tables, bits, dim))
    for t in range(tables):
        for i in range(bits):
            for d in range(dim):
                out[t, i, d] = 2 * int.from_bytes(hashlib.sha256(f"lsh-{t}-{i}-{d}".encode()).digest()[:4], "big") / 0xFFFFFFFF - 1
    return out


#: Rows that a bucket should hold about, tables, least sure bits that a query flips, and pairs by sketch that are rescored.
BUCKET_ROWS, TABLES, FLIPS, LSH_SHORTLIST = 32, 16, 5, 192
#: Packed signs, 64 to a word, that rows of shared buckets are ranked by.
SKETCH_WORDS = 8


def lsh_bits(rows: int) -> int:
    """Bits of a bucket's key, so that a bucket holds some 32 of so many rows: 2 to 24."""
    return int(min(24, max(2, round(np.log2(max(rows, 1) / BUCKET_ROWS)))))


def lsh_buckets(vectors: DataFrame, id_col: str, vector_col: str, dim: int, bits: int = 12, tables: int = 8, flips: int = 0) -> DataFrame:
    """(id, table_id, bucket, sketch) of every vector of ``dim`` numbers: signs against the hyperplanes of each table.

    With ``flips`` a row is put into all buckets that differ in its so many least sure bits. ``sketch``
    holds 512 further signs, packed.
    """
    planes = hyperplanes(dim, bits, tables).reshape(-1, dim).T
    further = hyperplanes(dim, 64, tables + SKETCH_WORDS)[tables:].reshape(-1, dim).T
    weights = 1 << np.arange(bits, dtype=np.int64)
    flips = min(flips, bits)
    chosen = (np.arange(1 << flips)[:, None] >> np.arange(flips)) & 1  # every set of flipped places

    @F.pandas_udf("struct<buckets:array<array<int>>,sketch:array<bigint>>")
    def sketch(batch: pd.Series) -> pd.DataFrame:
        rows = np.stack(batch.to_numpy()).astype(np.float64)
        inner = (rows @ planes).reshape(len(rows), tables, bits)
        own = ((inner >= 0) * weights).sum(2)
        unsure = weights[np.argsort(np.abs(inner), axis=2, kind="stable")[:, :, :flips]]
        probed = own[:, :, None] ^ (unsure[:, :, None, :] * chosen).sum(3) if flips else own[:, :, None]
        packed = np.packbits(rows @ further >= 0, axis=1).view(np.int64)
        return pd.DataFrame({"buckets": [list(map(list, r)) for r in probed.astype(np.int32)], "sketch": list(packed)})

    made = vectors.where(F.size(vector_col) == dim).select(F.col(id_col), sketch(F.col(vector_col)).alias("s"))
    exploded = made.select(id_col, F.posexplode("s.buckets").alias("table_id", "b"), F.col("s.sketch").alias("sketch"))
    return exploded.select(id_col, "table_id", F.explode("b").alias("bucket"), "sketch")


def lsh_pairs(queries: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, dim: int, copies: int, by: Sequence[str] = ()) -> DataFrame:
    """(query_id, id): for every query the rows nearest by sketch among those it shares a bucket with in some table.

    A stated set of queries against all rows: buckets, of a size that does not grow with the rows, meet by
    an equi-join; each query also looks into the buckets on the other side of its least sure bits. Of
    rows with the same vector (and the same ``by``) only the ``copies`` least ids are met, counted off before
    the shuffle, as all others come after them in any ranking.
    """
    bits = lsh_bits(vectors.count())
    same = Window.partitionBy(*by, F.xxhash64(vector_col)).orderBy(id_col)
    least = vectors.withColumn("__r", F.row_number().over(same)).where(F.col("__r") <= copies)
    asked = lsh_buckets(queries, id_col, vector_col, dim, bits, TABLES, FLIPS).withColumnRenamed(id_col, "query_id").withColumnRenamed("sketch", "asked")
    held = lsh_buckets(least, id_col, vector_col, dim, bits, TABLES)
    apart = sum((F.bit_count(F.col("asked")[i].bitwiseXOR(F.col("sketch")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    pairs = asked.join(held, ["table_id", "bucket"]).where(F.col("query_id") != F.col(id_col)).select("query_id", id_col, apart.alias("apart"))
    nearest = Window.partitionBy("query_id").orderBy("apart", id_col)
    return pairs.groupBy("query_id", id_col).agg(F.min("apart").alias("apart")).withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= LSH_SHORTLIST).select("query_id", id_col)


def lsh_neighbours(queries: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, dim: int, k: int = 8) -> DataFrame:
    """(query_id, id, score, rank): the k best by exact cosine of the rows that ``lsh_pairs`` finds."""
    scored = lsh_pairs(queries, vectors, id_col, vector_col, dim, k + 1)
    scored = scored.join(queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("qv")), "query_id").join(vectors.select(id_col, F.col(vector_col).alias("v")), id_col)
    scored = scored.select("query_id", id_col, F.round(dot(F.col("qv"), F.col("v")), 4).alias("score")).where(F.col("score") >= MIN_COSINE)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))).where(F.col("rank") <= k)
