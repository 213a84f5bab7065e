"""Texts as bags of terms, and the scoring of blocks of them, in Arrow and NumPy without pandas, so that workers import less."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.storage import cut_lineage

K1, B = 1.2, 0.75


def _begins(column: pa.Array) -> np.ndarray:
    """Where each run of equal values begins; there is one at least."""
    return np.concatenate([[0], pc.run_end_encode(column).run_ends.to_numpy()[:-1]])


def _places(begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the runs, and of every row its place within its run."""
    sizes = np.diff(begins, append=n)
    return sizes, np.arange(n) - np.repeat(begins, sizes)


def best_of_block(texts: pa.Table, asked: pa.Table, k: int, average: float) -> pa.Table:
    """(asked, id, score): the k best texts of one block for each query, exactly; texts whose rounded scores are equal go by id.

    texts (ids, bag): texts of the same terms are one row, with the k smallest of their ids in order. asked (asked, term, idf):
    the terms of each query.
    """
    held = texts.column("ids").combine_chunks()
    by_id = pc.sort_indices(pc.list_element(held, 0))
    ids, bags = held.take(by_id), texts.column("bag").combine_chunks().take(by_id)
    n, words = len(ids), pc.split_pattern(bags, " ")
    length = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    asked = asked.sort_by([("asked", "ascending"), ("idf", "ascending"), ("term", "ascending")]).combine_chunks()  # the rarest last
    coded = asked.column("term").combine_chunks().dictionary_encode()
    codes, idf = coded.indices.to_numpy(), np.empty(len(coded.dictionary))
    idf[codes] = asked.column("idf").to_numpy()
    code = pc.index_in(pc.list_flatten(words), value_set=coded.dictionary)  # null where no query asks for the term
    known = code.is_valid().to_numpy(zero_copy_only=False)
    at, tf = np.unique(code.drop_null().to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), length)[known], return_counts=True)
    term, row = np.divmod(at, max(n, 1))
    begins = np.searchsorted(term, np.arange(len(idf) + 1)).tolist()
    part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / average))
    copies, values = pc.list_value_length(ids).to_numpy(zero_copy_only=False), pc.list_flatten(ids)
    offsets = np.cumsum(copies) - copies
    which, rows, scores, total = [], [], [], np.zeros(n)
    queries = _begins(asked.column("asked").combine_chunks()).tolist()
    for begin, end in zip(queries, [*queries[1:], len(asked)]):
        spans = [(begins[c], begins[c + 1]) for c in codes[begin:end].tolist() if begins[c] < begins[c + 1]]
        if not spans:
            continue
        held_by = np.concatenate([row[a:b] for a, b in spans])
        np.add.at(total, held_by, np.concatenate([part[a:b] for a, b in spans]))
        score = total[held_by]  # a text stands here once for each of its terms
        total[held_by] = 0
        until, bound = len(score), 0.0
        for a, b in reversed(spans):  # k texts of one term reach the bound, so no text below it is among the best
            if b - a >= k:
                bound = np.partition(score[until - (b - a) : until], b - a - k)[b - a - k] - 2e-6  # ranked by six digits
                break
            until -= b - a
        above = np.flatnonzero(score >= bound)
        found, one = np.unique(held_by[above], return_index=True)
        score = score[above[one]]
        mark = np.rint(score * 1e6)
        best = np.lexsort((found, -mark))[:k]
        enough = np.searchsorted(np.cumsum(copies[found[best]]), k)
        if enough < len(best):
            best = best[mark[best] >= mark[best[enough]]]
        which.append(np.full(len(best), begin))
        rows.append(found[best])
        scores.append(score[best])
    hit = np.concatenate(rows) if rows else np.empty(0, np.int64)
    each = copies[hit]
    places = np.repeat(offsets[hit] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    query = np.repeat(np.concatenate(which) if which else hit, each)
    return pa.table({"asked": asked.column("asked").take(pa.array(query, pa.int64())), "id": values.take(pa.array(places, pa.int64())), "score": np.repeat(np.concatenate(scores) if scores else np.empty(0), each)})


def split_texts(docs: DataFrame, terms_of: Callable[[str], list[str]], k: int, id_col: str = "id", text_col: str = "text", once: bool = False) -> DataFrame:
    """docs with ``id``, the text's ``bag``, which is its terms in order as one string, and ``copies``.

    ``copies`` is set for the k least ids of a bag within a batch of rows, and adds up to its number of rows. ``once``:
    rows of one id stand side by side, and one of them is kept. A text is split in Python, once in each batch: a session's
    first query takes less time for that than for the same expressions in JVMs that have compiled none.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    source = docs.select(F.col(id_col).alias("id"), *rest, F.col(text_col).alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("bag", T.StringType()), T.StructField("copies", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = run  # equal to no id
        for batch in batches:
            if once and batch.num_rows:
                ids = batch.column("id")
                begins = _begins(ids)
                batch = batch.take(pa.array(begins[1:] if ids[0].as_py() == last else begins))
                last = ids[-1].as_py()
            if not (n := batch.num_rows):
                continue
            texts = batch.column("text").dictionary_encode()
            bags = pc.fill_null(pa.array([" ".join(sorted(terms_of(t))) for t in texts.dictionary.to_pylist()], pa.string()).take(texts.indices), "")
            order = pc.sort_indices(pa.table({"bag": bags, "id": batch.column("id")}), sort_keys=[("bag", "ascending"), ("id", "ascending")])
            sizes, place = _places(_begins(bags.take(order)), n)
            copies, beyond = np.empty(n, np.int64), np.empty(n, bool)
            copies[order], beyond[order] = np.where(place == 0, np.repeat(sizes, sizes), 0), place >= k
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], bags, pa.array(copies, mask=beyond)], names=schema.names)

    return source.mapInArrow(run, schema)


def gather_texts(texts: DataFrame, k: int) -> tuple[DataFrame, dict]:
    """(bag, ids, copies, length) of ``split_texts``: each bag once with the k least of its ids in order, its number of rows and of terms; and counts: texts ``n``, terms ``dl``, non-empty ``bags``.

    Gathered once, while the plan is built, and written to the shared folder. A bag of many copies sends k rows for each batch.
    """
    rows = texts.where("copies is not null").select("bag", "id", "copies").repartition("bag").sortWithinPartitions("bag", "id")
    schema = T.StructType([T.StructField("bag", T.StringType()), T.StructField("ids", T.ArrayType(texts.schema["id"].dataType)), T.StructField("copies", T.LongType()), T.StructField("length", T.LongType())])

    def grouped(rows: pa.Table) -> pa.RecordBatch:
        bags, begins = rows.column("bag").combine_chunks(), _begins(rows.column("bag").combine_chunks())
        sizes, place = _places(begins, len(rows))
        ends = np.concatenate([[0], np.cumsum(np.minimum(sizes, k))])
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows.column("id").combine_chunks().filter(pa.array(place < k)))
        bags = bags.take(pa.array(begins))
        length = pc.if_else(pc.equal(bags, ""), 0, pc.add(pc.count_substring(bags, " "), 1)).cast(pa.int64())
        return pa.RecordBatch.from_arrays([bags, ids, pa.array(np.add.reduceat(rows.column("copies").to_numpy(), begins)), length], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the last bag, which may go on in the next batch, k rows at most
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, rows]) if held else rows).combine_chunks()
            begin = int(_begins(rows.column("bag").combine_chunks())[-1])
            if begin:
                yield grouped(rows.slice(0, begin))
            held = rows.slice(begin)
            total = pc.sum(held.column("copies")).as_py()
            held = held.slice(0, k)
            held = held.set_column(2, rows.schema.field(2), pa.array([total, *[0] * (len(held) - 1)], pa.int64()))
        if held:
            yield grouped(held)

    seen = Observation()
    counts = [F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("length")).alias("dl"), F.count_if(F.col("length") > 0).alias("bags")]
    gathered = cut_lineage(rows.mapInArrow(run, schema).observe(seen, *counts))
    return gathered, {name: n or 0 for name, n in seen.get.items()}
