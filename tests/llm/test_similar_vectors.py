"""Most similar vectors: recall against brute force, and what does not take part."""

import numpy as np
import pyarrow.compute  # noqa: F401

from lodestone.llm.similar_vectors import PROBES, AdditiveQuantizer, most_similar, similar_pairs
from lodestone.sources.tables import table


def brute(ids, rows, k, least):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    out = {}
    for i, row in enumerate(sims):
        order = sorted(range(len(ids)), key=lambda j: (-round(row[j], 9), ids[j]))[:k]
        out[ids[i]] = [ids[j] for j in order if row[j] >= least]
    return out


def test_recall_on_the_notes(spark, data):
    notes = table(spark, data, "memories")
    usable = [(r.id, r.embedding) for r in notes.collect() if r.embedding is not None and len(r.embedding) == 256 and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    want = brute([i for i, _ in usable], np.array([v for _, v in usable]), 5, 0.6)
    got = {}
    for r in most_similar(notes).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    hit = sum(len(got.get(i, set()) & set(w)) for i, w in want.items())
    assert hit / sum(map(len, want.values())) >= 0.95


def test_edges(spark):
    schema = "id bigint, embedding array<float>, vec int, cell int"
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [1.0, 0.1]), (8, [0.0, 1.0]), (9, [1.0, None]), (10, [float("inf"), 1.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], schema)
    got = {(r.id, r.rank): r.neighbour for r in most_similar(df, dim=2, k=2).collect()}
    assert got == {(1, 1): 2, (1, 2): 7, (2, 1): 1, (2, 2): 7, (7, 1): 1, (7, 2): 2}
    assert {tuple(r) for r in similar_pairs(most_similar(df, dim=2, k=2)).collect()} == {(1, 2), (1, 7), (2, 7)}
    assert most_similar(df.limit(0), dim=2).count() == 0 and most_similar(df.where("id = 3"), dim=2).count() == 0 and most_similar(df.where("id = 1"), dim=2).count() == 0


def test_hot_copies_are_searched_once(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(1000 + i, rng.normal(size=4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    got = {}
    for r in most_similar(df, dim=4, k=3).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    assert all([n for _, n in sorted(got[i])] == [j for j in range(5) if j != i][:3] for i in range(300))


def test_encoding_comes_closer_with_more_codebooks():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(600, 32)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    errors = []
    for books in (2, 5):
        q = AdditiveQuantizer(rows, len(rows), books, 64)
        home = (rows @ q.coarse.T).argmax(1)
        codes, norms = q.encode(rows, home)
        built = q.coarse[home] + sum(b[codes[:, i]] for i, b in enumerate(q.books))
        assert np.allclose(np.linalg.norm(built, axis=1), norms, atol=1e-4)
        errors.append(np.linalg.norm(rows - built, axis=1).mean())
    assert errors[1] < errors[0] * 0.7


def test_hot_cells_are_split(spark):
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(3000, 8)) * 0.05 + np.eye(8)[0]
    unit = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    q = AdditiveQuantizer(unit[:100], 3_000_000, 3, 16)
    count = lambda: dict(zip(*[a.tolist() for a in np.unique(q.home_keys(unit), return_counts=True)]))
    q.size_cells({key // 65_536: 1000 * n for key, n in count().items()})
    q.size_parts({key: 1000 * n for key, n in count().items()})
    assert q.sub and q.blocks
    home, sent = q.probes(unit, 0.0, 1)
    own = sent[sent[:, 2] == 1]
    assert sorted(own[:, 0]) == list(range(3000)) and (own[np.argsort(own[:, 0]), 1] == q.home_keys(unit)).all()


def near_copies(n, dim=256):
    """A third of n vectors are near copies of one, made by three of 300 small edits each; the rest are spread."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=dim)
    edits = rng.normal(size=(300, dim)) * 0.12
    copies = np.array([base + edits[rng.choice(300, 3, replace=False)].sum(0) + rng.normal(size=dim) * 0.01 for _ in range(n // 3)])
    return np.concatenate([copies, rng.normal(size=(n - n // 3, dim)) + 2 * rng.normal(size=(50, dim))[rng.integers(0, 50, n - n // 3)]]).astype(np.float32)


def test_dense_near_copies_are_found_and_sent_a_bounded_number_of_times(spark):
    rows = near_copies(12_000)
    unit = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    q = AdditiveQuantizer(unit, len(unit), 3)
    q.size_cells(dict(enumerate(np.bincount((unit @ q.coarse.T).argmax(1), minlength=len(q.coarse)).tolist())))
    assert np.bincount(q.probes(unit, 0.06)[1][:, 0]).max() <= PROBES
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id bigint, embedding array<float>")
    got = {}
    for r in most_similar(df).where("id < 4000 and id % 50 = 0").collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    hits = [len(got[i] & set(sorted(np.argsort(-np.where(np.arange(len(unit)) == i, -9, unit @ unit[i]), kind="stable")[:5].tolist()))) for i in range(0, 4000, 50)]
    assert sum(hits) >= 0.95 * 5 * len(hits)


def test_blocks_find_what_one_group_finds(spark):
    import pyarrow as pa

    from lodestone.llm import similar_vectors as sv

    rng = np.random.default_rng(3)
    rows = rng.normal(size=(200, 8)) * 0.1 + np.eye(8)[0]
    unit = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    q = AdditiveQuantizer(unit, 200, 3, 16)

    class Held:
        value = q

    def found(blocks):
        q.blocks = {q.key(c): blocks for c in range(len(q.coarse))}
        table = pa.Table.from_batches(list(sv._spread(Held, 8, 9.0)([pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["id", "vec"])])))
        out = set()
        for cell in set(table["cell"].to_pylist()):
            for block in range(blocks * blocks):
                part = table.filter((pa.compute.field("cell") == cell) & (pa.compute.field("block") == block))
                if part.num_rows:
                    assert part.num_rows <= 200
                    r = sv._search(Held, 5, 0.0, 500)(part)
                    out |= {(a, b, round(s, 5)) for a, b, s in zip(r["id"].to_pylist(), r["neighbour"].to_pylist(), r["similarity"].to_pylist())}
        best = {}
        for a, b, s in out:
            best.setdefault(a, []).append((-s, b))
        return {a: sorted(v)[:5] for a, v in best.items()}

    assert found(1) == found(3) and len(found(1)) == 200


def test_scaled_copies_beyond_the_shortlist_go_to_the_least_ids(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=16).astype(np.float32)
    rows = [(i, (base * np.float32(1 + (i % 7))).tolist()) for i in range(400)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(60)]
    rows.append((2000, (base + np.float32(0.01)).tolist()))
    df = spark.createDataFrame(rows[::-1], "id bigint, embedding array<float>")
    got = {}
    for r in most_similar(df, dim=16).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert all(got[i] == set([j for j in range(6) if j != i][:5]) for i in range(400))
    assert got[2000] == set(range(5))
