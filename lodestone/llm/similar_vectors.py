"""The k most similar vectors of every vector, by additive quantisation.

A vector is written as a sum of full-dimensional codewords, one of each codebook: the first
codebook (unit vectors) also names the vector's cell, the further ones are trained on the residuals
of the ones before and chosen by beam search. A query scores a cell's vectors through tables of its
inner products with all codewords, divided by the stored norms of the sums; the best of that
shortlist are reranked with the exact cosine.

The codebooks are fitted on the driver on a sample of at most ``SAMPLE_ROWS`` vectors; every vector
is encoded and searched on the executors. A vector is sent once, to its own cell, where it is both
candidate and query, and as a query alone to the cells whose codeword is almost as near: in order of
nearness until they hold ``PROBE_ROWS`` vectors, ``PROBES`` at most, so what is sent of a vector is
bounded however dense its surroundings are. Cells are counted over all vectors; large ones are split
by the second codebook, and what is still large after that into blocks of vectors, each met by
blocks of queries: no task holds more than two blocks. Vectors with more than k + 1 copies, of any
length, are searched once for all copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.storage import cut_lineage

SAMPLE_ROWS = 16_384
CODEBOOKS, CODEWORDS = 12, 256
BEAM = 4
#: A cell is probed when its codeword's inner product with the query is within this of the best one's.
PROBE_MARGIN = 0.06
SHORTLIST = 160
#: Cells that a query is sent to at most, and vectors in nearer cells from which on no further cell is searched.
PROBES, PROBE_ROWS = 48, 32_768
#: Rows of a cell above which it is split by the second codebook, and of a block beyond that.
CELL_ROWS = 8_192
#: Groups of copies that are broadcast; more are joined by a shuffle.
COPIES_AT_ONCE = 10_000


def _kmeans(rows: np.ndarray, k: int, rounds: int, unit: bool, seed: int) -> np.ndarray:
    """Centres of Lloyd's rounds; empty ones restart at the worst-placed rows."""
    draw = np.random.default_rng(seed)
    centres = rows[draw.choice(len(rows), k, replace=len(rows) < k)].astype(np.float32)
    for _ in range(rounds):
        score = rows @ centres.T - (0 if unit else 0.5 * (centres**2).sum(1))
        best = score.argmax(1)
        order = np.argsort(best, kind="stable")
        counts = np.bincount(best, minlength=k)
        filled = np.flatnonzero(counts)
        sums = np.add.reduceat(rows[order], np.concatenate([[0], np.cumsum(counts[filled])[:-1]]), axis=0)
        centres[filled] = sums / counts[filled, None]
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            centres[empty] = rows[np.argsort(score[np.arange(len(rows)), best])[np.arange(len(empty)) % len(rows)]]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


class AdditiveQuantizer:
    """Codebooks and what encoding and probing need of them; small, pickled to the tasks."""

    def __init__(self, sample: np.ndarray, total: int, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, rounds: int = 8, seed: int = 7):
        cells = int(min(4096, max(4, 2 ** np.ceil(np.log2(np.sqrt(max(total, 1)))))))
        self.coarse = _kmeans(sample, min(cells, max(1, len(sample) // 4)), rounds, True, seed)
        first = (sample @ self.coarse.T).argmax(1)
        residual = sample - self.coarse[first]
        self.books = []
        for level in range(codebooks - 1):
            book = _kmeans(residual, min(codewords, max(1, len(sample) // 4)), rounds, False, seed + level + 1)
            self.books.append(book)
            residual = residual - book[(residual @ book.T - 0.5 * (book**2).sum(1)).argmax(1)]
        self.expected = np.bincount(first, minlength=len(self.coarse)) / max(1, len(sample)) * total
        self.sub: dict[int, np.ndarray] = {}  # sub-centres of a hot cell: directions of its codeword plus each one of the second codebook
        self.sub_sizes: dict[int, np.ndarray] = {}
        self.blocks: dict[int, int] = {}

    def size_cells(self, counts: dict[int, int]) -> None:
        """Take the numbers of vectors of all cells, and name those to split."""
        self.expected = np.zeros(len(self.coarse))
        self.expected[list(counts)] = list(counts.values())
        for cell in np.flatnonzero(self.expected > CELL_ROWS).tolist():
            centre = self.coarse[cell] + self.books[0]
            self.sub[cell] = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
            self.sub_sizes[cell] = np.full(len(centre), self.expected[cell] / len(centre))

    def size_parts(self, counts: dict[int, int]) -> None:
        """Take the numbers of vectors of all parts of split cells, by key, and name those to search in blocks."""
        for cell in self.sub:
            self.sub_sizes[cell] = np.array([counts.get(self.key(cell, part), 0) for part in range(len(self.sub[cell]))], dtype=float)
        self.blocks = {k: -(-n // CELL_ROWS) for k, n in counts.items() if n > CELL_ROWS}

    def home_keys(self, rows: np.ndarray) -> np.ndarray:
        """Key of the cell, or of the part of a split cell, that each vector belongs to."""
        cells = (rows @ self.coarse.T).argmax(1)
        keys = cells.astype(np.int64) * 65_536
        for cell, centres in self.sub.items():
            at = np.flatnonzero(cells == cell)
            if len(at):
                keys[at] += (rows[at] @ centres.T).argmax(1) + 1
        return keys

    @staticmethod
    def key(cell: int, part: int = -1) -> int:
        """``cell * 65,536`` for a whole cell, one and more on top of it for its parts."""
        return cell * 65_536 + part + 1

    def encode(self, rows: np.ndarray, cells: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the residual codebooks, norm of the sum) by beam search behind the given cells."""
        n = len(rows)
        residual = (rows - self.coarse[cells])[:, None, :]
        codes = np.zeros((n, 1, 0), dtype=np.uint8)
        error = (residual**2).sum(2)
        for book in self.books:
            gain = error[:, :, None] - 2 * (residual @ book.T) + (book**2).sum(1)
            flat = gain.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            pick = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            behind, word = pick // len(book), pick % len(book)
            error = np.take_along_axis(flat, pick, 1)
            residual = np.take_along_axis(residual, behind[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, behind[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        best = error.argmin(1)
        at = np.arange(n)
        return codes[at, best], np.linalg.norm(rows - residual[at, best], axis=1).astype(np.float32)

    def probes(self, rows: np.ndarray, margin: float, least: int = SHORTLIST) -> tuple[np.ndarray, np.ndarray]:
        """(home cell of each row; row numbers, keys of all cells to search, and whether it is the row's own).

        Besides the cells within the margin the nearest ones are searched until they hold ``least`` vectors.
        """
        row, cell, first = _nearest(rows @ self.coarse.T, self.expected, margin, least)
        home = cell[first]
        keys = cell.astype(np.int64) * 65_536
        kept = [np.stack([row, keys, first], axis=1)[~np.isin(cell, list(self.sub))]] if self.sub else [np.stack([row, keys, first], axis=1)]
        for hot, centres in self.sub.items():
            at = np.flatnonzero(cell == hot)
            if len(at):
                i, part, own = _nearest(rows[row[at]] @ centres.T, self.sub_sizes[hot], margin, least)
                kept.append(np.stack([row[at][i], hot * 65_536 + part + 1, first[at][i] & own], axis=1))
        return home, np.concatenate(kept)


def _nearest(score: np.ndarray, sizes: np.ndarray, margin: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is the row's nearest) of the cells to search, given the rows' inner products with all cells."""
    top = min(score.shape[1], PROBES)
    order = np.argpartition(-score, top - 1, axis=1)[:, :top]
    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(score, order, 1), axis=1, kind="stable"), 1)
    ranked = np.take_along_axis(score, order, 1)
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    near = ((ranked >= ranked[:, :1] - margin) | (before < least)) & (before < PROBE_ROWS)
    near[:, 0] = True
    row, at = np.nonzero(near)
    return row, order[row, at], at == 0


def _unit(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _cell_counts(usable: DataFrame, quantizer, dim: int) -> dict[int, int]:
    """Number of vectors of every cell and part, over all vectors; as many rows as the codebooks have words at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(quantizer.value.home_keys(_unit(batch.column(0), dim).astype(np.float32)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    return {r.key: r.n for r in usable.select("vec").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()}


def _spread(quantizer, dim: int, margin: float):
    """Rows for the cells: a vector at home (base) and where else it has to search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: AdditiveQuantizer = quantizer.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                ids = batch.column(0).to_numpy()
                rows = _unit(batch.column(1), dim).astype(np.float32)
                home, sent = q.probes(rows, margin)
                codes, norms = q.encode(rows, home)
                row, key, group, base, asks = [], [], [], [], []
                for r, k, at_home in sent.tolist():
                    # a cell of n blocks has n x n groups: the vectors of one block searched by the queries of one
                    n = q.blocks.get(k, 1)
                    own = int(ids[r]) % n
                    places = [(own * n + i, True, i == own) for i in range(n)] if at_home else []
                    places += [(i * n + own, False, True) for i in range(n) if not at_home or i != own]
                    for place, as_base, as_query in places:
                        row.append(r)
                        key.append(k)
                        group.append(place)
                        base.append(as_base)
                        asks.append(as_query)
                raw = [v.tobytes() for v in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key, pa.int64()), pa.array(group, pa.int32()), pa.array(base, pa.bool_()), pa.array(asks, pa.bool_()), pa.array(ids[row], pa.int64()),
                        pa.array([raw[r] for r in row], pa.binary()), pa.array([codes[r].tobytes() if b else None for r, b in zip(row, base)], pa.binary()),
                        pa.array([float(norms[r]) if b else None for r, b in zip(row, base)], pa.float32()),
                    ],
                    names=["cell", "block", "base", "asks", "id", "vec", "codes", "norm"],
                )

    return run


def _search(quantizer, k: int, least: float, shortlist: int):
    """Within one block of a cell: shortlist by table lookups, exact cosine for the shortlist."""

    def run(group: pa.Table) -> pa.Table:
        q: AdditiveQuantizer = quantizer.value
        order = np.argsort(group["id"].to_numpy(), kind="stable")  # ties then go to the smaller id
        ids = group["id"].to_numpy()[order]
        vectors = np.frombuffer(b"".join(group["vec"].to_pylist()), dtype=np.float32).reshape(len(ids), -1)[order]
        base = np.flatnonzero(group["base"].to_numpy(zero_copy_only=False)[order])
        asking = np.flatnonzero(group["asks"].to_numpy(zero_copy_only=False)[order])
        out_q, out_n, out_s = [], [], []
        if len(base) and len(asking):
            codes = np.frombuffer(b"".join(group["codes"].take(pa.array(order[base])).to_pylist()), dtype=np.uint8).reshape(len(base), -1)
            norms = group["norm"].to_numpy()[order[base]]
            centre = q.coarse[int(group["cell"][0].as_py()) // 65_536]
            candidates = vectors[base]
            place = np.full(len(ids), -1)
            place[base] = np.arange(len(base))
            size = min(shortlist, len(base))
            step = max(1, 4_000_000 // len(base))
            for begin in range(0, len(asking), step):
                which = asking[begin : begin + step]
                rows = vectors[which]
                score = np.repeat((rows @ centre)[:, None], len(base), axis=1)
                for level, book in enumerate(q.books):
                    score += (rows @ book.T)[:, codes[:, level]]
                score /= norms
                own = place[which]
                at = np.flatnonzero(own >= 0)
                score[at, own[at]] = -np.inf
                short = np.sort(np.argpartition(-score, size - 1, axis=1)[:, :size], axis=1)
                for lo in range(0, len(rows), 256):
                    part = short[lo : lo + 256]
                    exact = np.einsum("qd,qrd->qr", rows[lo : lo + 256], candidates[part])
                    exact[part == own[lo : lo + 256, None]] = -np.inf
                    best = np.argsort(-exact.round(6), axis=1, kind="stable")[:, : 2 * k]
                    near = np.take_along_axis(part, best, 1)
                    fine = np.einsum("qd,qrd->qr", rows[lo : lo + 256].astype(np.float64), candidates[near].astype(np.float64))
                    fine[near == own[lo : lo + 256, None]] = -np.inf
                    final = np.argsort(-fine, axis=1, kind="stable")[:, :k]
                    sims, picked = np.take_along_axis(fine, final, 1), np.take_along_axis(near, final, 1)
                    i, j = np.nonzero(sims >= least)
                    out_q.append(ids[which[lo + i]])
                    out_n.append(ids[base[picked[i, j]]])
                    out_s.append(sims[i, j])
        none = np.empty(0, dtype=np.int64)
        return pa.table({
            "id": pa.array(np.concatenate([none, *out_q]), pa.int64()), "neighbour": pa.array(np.concatenate([none, *out_n]), pa.int64()), "similarity": pa.array(np.concatenate([none.astype(float), *out_s]), pa.float64()),
        })

    return run


def _norm(vec: str) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _cosine(a: str, b: str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x) / (_norm(a) * _norm(b))


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, vec, copy): vectors of ``dim`` finite numbers that are not all zero; copy is a hash of the rounded direction."""
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    norms = F.array_repeat(_norm("vec"), F.size("vec"))  # one norm for all numbers; named within the lambda it would be taken anew for each
    direction = F.zip_with("vec", norms, lambda x, n: F.round(x / n * 10_000).cast("int"))
    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") == dim)).where(good).withColumn("copy", F.xxhash64(direction))


def most_similar(
    rows: DataFrame, id_col: str = "id", vector_col: str = "embedding", dim: int = 256, k: int = 5, least: float = 0.6,
    sample_rows: int = SAMPLE_ROWS, margin: float = PROBE_MARGIN, shortlist: int = SHORTLIST,
) -> DataFrame:
    """(id, neighbour, similarity, rank): for every usable vector its up to ``k`` most similar others.

    Similarity is the cosine, at least ``least``; ties go to the smaller id, rank counts from 1. Null
    vectors, those of another length, all zero or with null, NaN or infinite numbers take no part, as
    query or candidate. Ids are taken as unique: of rows repeated under one id one is kept in the
    result. Fewer usable vectors than k give shorter lists, an empty table an empty result; further
    columns are not read.
    """
    spark = rows.sparkSession
    usable = usable_vectors(rows, id_col, vector_col, dim)
    copies = usable.groupBy("copy").agg(F.count("*").alias("n"))
    total = copies.agg(F.sum("n")).head()[0] or 0
    schema = "id bigint, neighbour bigint, similarity double"
    if not total:
        return spark.createDataFrame([], schema + ", rank int")

    # Copies of more than k + 1 are searched once for all: only their least ids, all with the first one's numbers.
    hot = cut_lineage(copies.where(F.col("n") > k + 1).select("copy"))
    small = (lambda d: F.broadcast(d)) if hot.count() <= COPIES_AT_ONCE else (lambda d: d)
    first = cut_lineage(usable.join(small(hot), "copy").groupBy("copy").agg(F.min_by("vec", "id").alias("first")))
    same = F.coalesce(_cosine("vec", "first") >= 1 - 1e-12, F.lit(False))
    least_ids = (
        usable.join(small(first), "copy").where(same).select("copy", "id")
        .withColumn("rn", F.row_number().over(Window.partitionBy("copy").orderBy("id"))).where(F.col("rn") <= k + 1)
        .groupBy("copy").agg(F.sort_array(F.collect_list("id")).alias("least_ids"))
    )
    groups = cut_lineage(first.join(least_ids, "copy"))
    flagged = usable.join(small(groups), "copy", "left").withColumn("same", same)
    searched = flagged.where(~F.col("same") | F.array_contains("least_ids", F.col("id"))).select("id", F.when(F.col("same"), F.col("first")).otherwise(F.col("vec")).alias("vec"))
    rest = flagged.where(F.col("same") & ~F.array_contains("least_ids", F.col("id")))
    settled = rest.select("id", F.explode(F.slice("least_ids", 1, k)).alias("neighbour"), F.lit(1.0).alias("similarity"))

    drawn = usable.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(total)) < sample_rows).select("vec").limit(2 * sample_rows).toArrow()
    sample = _unit(drawn["vec"], dim).astype(np.float32) if drawn.num_rows else _unit(usable.select("vec").limit(1).toArrow()["vec"], dim).astype(np.float32)
    fitted = AdditiveQuantizer(sample, total)
    searched = searched.select("id", "vec")
    counts = _cell_counts(searched, spark.sparkContext.broadcast(fitted), dim)
    fitted.size_cells({key // 65_536: n for key, n in counts.items()})
    if fitted.sub:
        fitted.size_parts({key: n for key, n in _cell_counts(searched, spark.sparkContext.broadcast(fitted), dim).items() if key % 65_536})
    quantizer = spark.sparkContext.broadcast(fitted)

    cells = searched.mapInArrow(_spread(quantizer, dim, margin), "cell bigint, block int, base boolean, asks boolean, id bigint, vec binary, codes binary, norm float")
    found = cells.groupBy("cell", "block").applyInArrow(_search(quantizer, k, least, shortlist), schema)
    by_rank = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return (
        found.unionByName(settled).groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
        .withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    )


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which one is among the most similar of the other."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
