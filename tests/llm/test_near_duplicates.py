"""Groups of near-duplicate notes against brute force, and the signatures they rest on."""

import random

import numpy as np
import pytest

from lodestone.llm import near_duplicates as nd
from lodestone.llm.queries import p1_found
from lodestone.sources.tables import table

SCHEMA = "id bigint, text string, workspace string"


def brute(rows, least=0.65):
    words = {i: set(nd.distinct_words(t)) for i, t in rows if i is not None and t is not None}
    words = {i: w for i, w in words.items() if w}
    parent = {i: i for i in words}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in words:
        for j in words:
            if i < j and len(words[i] & words[j]) >= least * len(words[i] | words[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in words}


def test_found_equals_brute_force(spark, data):
    notes = table(spark, data, "memories")
    groups = brute([(r.id, r.text) for r in notes.select("id", "text").collect()])
    want = {(i, j) for i in groups for j in groups if i < j and groups[i] == groups[j]}
    assert {(r.id_a, r.id_b) for r in p1_found(spark, data).collect()} == want


def test_edges(spark):
    rows = [(1, "Alpha beta_gamma", "x"), (2, "gamma BETA alpha", "y"), (3, None, "x"), (4, "", "x"), (5, " -- !! ", "x"), (6, "alone here", None), (6, "alone here", None), (7, "alpha beta gamma", "z"), (None, "alpha beta gamma", "z")]
    got = {r.id: r.group_id for r in nd.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 7: 1, 6: 6}
    assert nd.near_duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("id", "text", "1 as rep", "2 as pivot", "'b' as bucket", "id as group_id")
    assert nd.near_duplicate_groups(clash).count() == 4


def test_a_large_group_of_distinct_near_copies_is_one(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):  # each note changes a few words of the same base
        words = base[:]
        for k in rng.sample(range(60), 4):
            words[k] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(words), "w"))
    rows += [(1000 + i, " ".join(f"y{rng.randrange(10_000)}" for _ in range(50)), "w") for i in range(40)]
    want = brute([(r[0], r[1]) for r in rows])
    assert {r.id: r.group_id for r in nd.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def _template_notes(n, pairs=12):
    """Notes of one template (40 shared words, 20 of their own), every tenth with an edited copy."""
    shared = " ".join(f"t{i}" for i in range(40))
    own = lambda i: [f"o{i}x{k}" for k in range(20)]
    rows = [(i, f"{shared} {' '.join(own(i))}", "w") for i in range(n)]
    return rows + [(100_000 + i, f"{shared} {' '.join(own(i)[: 20 - i % 9])} extra{i}", "w") for i in range(0, n, n // pairs)]


def test_notes_of_one_template_are_not_expanded(spark, monkeypatch):
    """A crowded bucket of unlike notes gives as many candidates as there are links, not pairs."""
    made = {}
    kept = nd.rare_word_pairs

    def counted(sets, similarity):
        pairs = kept(sets, similarity)
        made["pairs"] = pairs.count()
        return pairs

    monkeypatch.setattr(nd, "rare_word_pairs", counted)
    for n in (240, 480):
        rows = _template_notes(n)
        want = brute([(r[0], r[1]) for r in rows])
        assert {r.id: r.group_id for r in nd.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == want
        assert made.pop("pairs") <= 200


def test_spread_buckets_have_the_same_members(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [1, *{rng.randrange(2, 60) for _ in range(3)}]) for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, buckets array<bigint>")
    plain = None
    for often in (10**9, 1):
        monkeypatch.setattr(nd, "SAMPLED_OFTEN", often)
        got = sorted(tuple(r) for r in nd._starred(df, 4).select("bucket", "id", "pivot", "n").collect())
        plain = plain or got
        assert got == plain and sum(1 for r in got if r[0] == 1) == 899
    of = {}
    for i, buckets in rows:
        for b in buckets:
            of.setdefault(b, []).append(i)
    assert plain == sorted((b, i, min(ids), len(ids)) for b, ids in of.items() for i in ids if i != min(ids))


def test_rare_words_lose_no_pair(spark):
    rng = random.Random(5)
    sets = []
    for i in range(300):  # sets of all sizes, many of them close to the limit
        kind = rng.randrange(3)
        base = [f"b{kind}w{k}" for k in range(rng.randrange(1, 50))]
        sets.append((i, i % 7 if i % 3 else i + 1000, sorted({*base, *(f"r{rng.randrange(200)}" for _ in range(rng.randrange(0, 12)))})))
    df = spark.createDataFrame([(i, lab, [hash(w) for w in words]) for i, lab, words in sets], "id bigint, label bigint, words array<bigint>")
    got = {(r.a, r.b) for r in nd.rare_word_pairs(df, 0.65).collect()}
    want = {(i, j) for i, li, a in sets for j, lj, b in sets if i < j and li != lj and len({*a} & {*b}) >= 0.65 * len({*a} | {*b}) - 1e-12}
    assert want and want <= got


def test_a_long_text(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, long, "w"), (2, long + " more", "w"), (3, "short", "w")]
    assert {r.id: r.group_id for r in nd.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("shared", [20, 40, 55])
def test_signatures_estimate_similarity(shared):
    maker = nd.SuperMinHash(1024)
    a = nd._hash_words([f"a{i}" for i in range(60)])
    b = nd._hash_words([f"a{i}" for i in range(shared)] + [f"b{i}" for i in range(60 - shared)])
    share = float(np.mean(maker.signature(a) == maker.signature(b)))
    assert abs(share - shared / (120 - shared)) < 0.06


def test_early_stop_changes_nothing():
    maker = nd.SuperMinHash(128)
    words = nd._hash_words([f"t{i}" for i in range(37)])
    rows = maker._rows(words)
    whole = np.full(128, np.iinfo(np.uint64).max, dtype=np.uint64)
    ranks = np.arange(128, dtype=np.uint64) << np.uint64(32)
    for r in rows:
        np.minimum.at(whole, maker.places[r], ranks | maker.fractions[r])
    assert (maker.signature(words) == whole).all()
