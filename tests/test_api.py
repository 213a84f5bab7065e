"""The engine's four queries."""

import pytest
from pyspark.sql import functions as F

from lodestone.api import MODES, Engine, clamp
from lodestone.functions.vectors import hash_embedding_of, hash_vectors
from lodestone.operators import search
from lodestone.plans.build import build_index
from lodestone.plans.common import TERMS
from lodestone.sources.tables import current_corpus, current_files, table


def test_clamp():
    assert [clamp(x, 8, 20) for x in (None, "x", 0, 5.9, 99, float("nan"))] == [8, 8, 1, 5, 20, 8]


def test_engine(spark, data):
    engine = Engine(spark, data)
    for mode in MODES:
        assert engine.find("policy token", mode, top_k=5).count() <= 40
    with pytest.raises(ValueError):
        engine.find("x", "nope")
    with pytest.raises(ValueError):
        engine.find(" ")
    assert set(engine.impact("fetchPolicy").columns) == {"section", "workspace", "path", "line", "score"}
    path = engine.files.select("path").join(engine.corpus.select("path"), "path").head()[0]
    assert engine.window(path, 1, 3).count() >= 1 and engine.window("../etc", 1, 3).count() == 0
    assert engine.recall("ledger cache", "2026-06-01 00:00:00").count() == 3
    assert engine.context("where does `fetchPolicy` keep its cache").count() >= 1
    assert engine.context("zzqx").count() >= 0


def test_stored_postings_and_vectors_equal_the_texts(spark, data):
    docs = table(spark, data, "documents")
    for phrases in (TERMS, search.phrases_of("validate token cache"), [("c", True), "index"], ["nosuchterm"], []):
        stored = search.bm25_stored(search.postings_of(docs, ["doc_id"], "text"), search.posting_stats(docs, "text"), ["doc_id"], phrases)
        want = {r.doc_id: round(r.score, 6) for r in search.bm25(docs, "doc_id", "text", phrases).collect()}
        assert {r.doc_id: round(r.score, 6) for r in stored.collect()} == want
    texts = {r.doc_id: r.text for r in docs.where("text is not null").collect()}
    vectors = {r.doc_id: r.embedding for r in hash_vectors(docs, "doc_id", "text").collect()}
    some = [i for i in sorted(vectors) if texts[i].isascii()][:20]
    assert some and all(abs(a - b) < 1e-9 for i in some for a, b in zip(vectors[i], hash_embedding_of(texts[i])))


def test_engine_over_an_index(spark, data, tmp_path):
    build_index(current_files(spark, data), current_corpus(spark, data), str(tmp_path / "index"))
    engine = Engine.over_index(spark, str(tmp_path / "index"), table(spark, data, "memories"))
    for mode in MODES:
        assert engine.find("policy token", mode, top_k=5).count() <= 40
    hits = engine.find("validate token cache").collect()
    docs = engine._chunk_docs()
    lexical = search.ranked(search.bm25(docs, "id", "text", search.phrases_of("validate token cache")), "id", 20)
    similar = search.cosine_topk(engine.stored["vectors"], hash_embedding_of("validate token cache").tolist(), "id", "embedding", 20)
    assert [r.hit_id for r in hits] == [r.id for r in search.rrf([lexical, similar], "id", 20).collect()][:8]
    line = engine.corpus.where(F.contains("content", F.lit("Policy"))).head()
    if line is not None:
        scan = Engine(spark, data).find("Policy", "grep", top_k=20).collect()
        assert [tuple(r) for r in engine.find("Policy", "grep", top_k=20).collect()] == [tuple(r) for r in scan]
    assert engine.impact("fetchPolicy").where("section = 'caller'").count() == Engine(spark, data).impact("fetchPolicy").where("section = 'caller'").count()
    assert engine.find("token", path_prefix="no/such/").count() == 0
