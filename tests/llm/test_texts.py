"""Tokenizing, mixing and sentences."""

import random

import pytest
from tokenizers import Tokenizer

from lodestone.llm import mixing
from lodestone.llm import sentences as sn
from lodestone.llm.bpe_trie import TOKENIZERS, TrieEncoder, encode_corpus, read_ranks, token_counts
from lodestone.llm.mixing import mix_report, mix_sources
from lodestone.sources.tables import table

WILD = ["", " ", "\n\n  x", "don't WE'LL", "a" * 3000, " " * 700, "日本語テキスト。", "\U0001f469\u200d\U0001f4bb", "<|endoftext|>", "x\u0301\x00\ufeff", "http://a.b/c?d=e&f=1,000.50", "ไทย ำ้", "\ud7ff", "1234567890" * 30]


def encoded(encoder, texts):
    flat, ends = encoder.encode_batch(texts)
    assert encoder.count_batch(texts) == [b - a for a, b in zip([0, *ends], ends)]
    return [list(flat[a:b]) for a, b in zip([0, *ends], ends)]


@pytest.fixture(scope="module")
def encoder():
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return TrieEncoder(read_ranks(f.read()))


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_public_tokenizer(spark, data, reference):
    docs = table(spark, data, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = encode_corpus(docs).collect()
    assert len(got) == len(texts) and all(list(r.ids) == reference.encode(texts[r.doc_id], add_special_tokens=False).ids for r in got)


def test_wild_texts(encoder, reference):
    rng = random.Random(2)
    texts = WILD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), 32])) for _ in range(60)) for _ in range(200)]
    assert encoded(encoder, texts) == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_forgets_when_full(reference):
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        small = TrieEncoder(read_ranks(f.read()), max_nodes=50)
    for text in ["alpha beta gamma delta " * 5, "epsilon zeta", "alpha beta gamma"]:
        assert encoded(small, [text]) == [reference.encode(text, add_special_tokens=False).ids]


def test_a_batch_that_finds_the_encoder_full_is_encoded(encoder, reference):
    small = TrieEncoder(encoder.ranks, max_nodes=5)
    for text in ["alpha beta", "alpha gamma", "delta"]:
        flat, ends = small.encode_batch([text, None, text])
        ids = reference.encode(text, add_special_tokens=False).ids
        assert list(flat) == ids * 2 and ends == [len(ids), len(ids), 2 * len(ids)]


def test_a_full_encoder_stays_below_its_bound():
    """A worker that has met ever new words holds less than 150 MB."""
    import tracemalloc

    rng = random.Random(1)
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        raw = f.read()
    tracemalloc.start()
    full = TrieEncoder(read_ranks(raw))
    cleared = 0
    while not cleared:
        before = len(full.words)
        full.count_batch([" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(20_000))])
        cleared = len(full.words) < before
    assert tracemalloc.get_traced_memory()[1] < 150_000_000
    tracemalloc.stop()


def test_encoding_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "hi", "z")], "doc_id bigint, text string, ids string")
    assert sorted((r.doc_id, list(r.ids)) for r in encode_corpus(df).collect()) == [(1, []), (2, []), (2, [5303])]
    assert encode_corpus(df.limit(0)).count() == 0
    assert [r.n for r in token_counts(df, "text", "n").orderBy("ids").collect()] == [0, 0, 1]


def test_mix_meets_its_shares(spark, data):
    docs, targets = table(spark, data, "documents"), table(spark, data, "mix_targets")
    mixed = mix_sources(docs, targets)
    rows = mixed.collect()
    caps = {r.source: r.max_repeats for r in targets.collect()}
    assert rows and all(1 <= r.repeats <= caps[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    report = mix_report(mixed, targets).collect()
    total = sum(r.tokens for r in report)
    largest = max(r.n_tokens for r in rows)
    listed = sum(r.target_share for r in report if r.tokens)
    assert len(report) == len(caps) and all(r.tokens == 0 or abs(r.tokens / total - r.target_share / listed) * total <= 2 * largest for r in report)
    assert {tuple(r) for r in mix_sources(docs, targets).collect()} == {tuple(r) for r in rows}


@pytest.mark.parametrize("rows", [50_000, 3])
def test_mix_equals_a_plain_computation(spark, data, monkeypatch, rows):
    """Budgets, epochs and the documents of the last one, by loops over sorted keys; whatever the ranges."""
    import math
    from collections import defaultdict

    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "RANGE_ROWS", rows)
    docs, targets = table(spark, data, "documents"), table(spark, data, "mix_targets")
    keyed = token_counts(docs.select("doc_id", "text", mixing.source_key().alias("source"), mixing.quality_weight().alias("w"), mixing._uniform("doc_id", 11).alias("u")), "text").drop("text").collect()
    of = defaultdict(list)
    for r in keyed:
        if r.source is not None and r.n_tokens > 0:
            of[r.source].append((-math.log(r.u) / r.w, r.doc_id, r.n_tokens))
    share, most = defaultdict(float), defaultdict(int)
    for t in targets.select(mixing.source_key().alias("source"), F.col("target_share").alias("share"), "max_repeats").collect():
        if t.source in of and t.share > 0 and t.max_repeats > 0:
            share[t.source] += t.share
            most[t.source] = max(most[t.source], t.max_repeats)
    whole = sum(share.values())
    size = {s: sum(n for _, _, n in of[s]) for s in share}
    total = min(size[s] * most[s] / (share[s] / whole) for s in share)
    want = {}
    for s in share:
        budget = math.floor(min(total * share[s] / whole, size[s] * most[s]) + 1e-6)
        epochs, upto = budget // size[s], 0
        for _, doc, n in sorted(of[s]):
            upto += n
            repeats = epochs + (upto <= budget - epochs * size[s])
            if repeats:
                want[doc] = repeats
    assert {r.doc_id: r.repeats for r in mix_sources(docs, targets).collect()} == want


def test_epochs_come_before_the_fraction(spark):
    docs = spark.createDataFrame([(i, "word " * 10, "Small-Source") for i in range(4)] + [(100 + i, "word " * 10, "large") for i in range(200)] + [(900, None, "large"), (901, "", "large"), (902, "x", None), (903, "x", "other")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("small_source", 2.0, 5), ("large", 2.0, 1), ("none", 1.0, 3), ("zero", 0.0, 1), (None, 1.0, 1)], "source string, target_share double, max_repeats int")
    got = {r.doc_id: r.repeats for r in mix_sources(docs, targets, total=180).collect()}
    small = [got.get(i, 0) for i in range(4)]
    assert max(small) - min(small) <= 1 and set(got) & {900, 901, 902, 903} == set()
    assert all(r.source in ("small_source", "large") for r in mix_sources(docs, targets).collect())
    assert mix_sources(docs.limit(0), targets).count() == 0 and mix_sources(docs, targets.limit(0)).count() == 0


CASES = {
    "One. Two! Three?": ["One.", "Two!", "Three?"],
    "It took 0.88 s vs. 32.25 s, e.g. in a.out. Next.": ["It took 0.88 s vs. 32.25 s, e.g. in a.out.", "Next."],
    "The U.S. mirror lags. We meet at 9 a.m. The job starts at 5 p.m. on weekdays.": ["The U.S. mirror lags.", "We meet at 9 a.m.", "The job starts at 5 p.m. on weekdays."],
    "We changed tests, docs, etc. The rest stays. tallyPolicy never runs. `x` does.": ["We changed tests, docs, etc.", "The rest stays.", "tallyPolicy never runs.", "`x` does."],
    'He said "Stop. Now." and left. (All of it.) Then?! Yes': ['He said "Stop. Now." and left.', "(All of it.)", "Then?!", "Yes"],
    '"Never. We waited," she wrote. \u201cWhat now? No!\u201d was first.': ['"Never. We waited," she wrote.', "\u201cWhat now? No!\u201d was first."],
    "Wait... it was. Wait... It was.": ["Wait... it was.", "Wait...", "It was."],
    "at most.Our loop. See docs.example/a.html?q=1 now. IdlePrompt.flush runs": ["at most.", "Our loop.", "See docs.example/a.html?q=1 now.", "IdlePrompt.flush runs"],
    "# Why? How. x\ntext one\ntwo. Three.\n\nFour": ["# Why? How. x", "text one\ntwo.", "Three.", "Four"],
    "- One here. Two there.\n- d\n  e.\n1. Four. Five\n2. H": ["- One here.", "Two there.", "- d\n  e.", "1. Four.", "Five", "2. H"],
    "user: Hi. You.\nagent: ok\ntool: done.": ["user: Hi.", "You.", "agent: ok", "tool: done."],
    "Text.\n```py\na. B\n\nc\n```\nMore.": ["Text.", "```py\na. B\n\nc\n```", "More."],
    "Am 9. Januar kam v1. Siehe Nr. 9 der Liste. Er braucht z. B. Zeit, d. h. viel usw. Der Rest": ["Am 9. Januar kam v1.", "Siehe Nr. 9 der Liste.", "Er braucht z. B. Zeit, d. h. viel usw.", "Der Rest"],
    "太慢了！等等……缓存没有。他说“旧。新。”然后停了。": ["太慢了！", "等等……缓存没有。", "他说“旧。新。”然后停了。"],
    "次ですよね…。まだxは？はい": ["次ですよね…。", "まだxは？", "はい"],
    "Χρειάζεται ο x; Ναι, π.χ. Αυτό, δηλ. όλα. Τέλος": ["Χρειάζεται ο x;", "Ναι, π.χ. Αυτό, δηλ. όλα.", "Τέλος"],
    "पुराना है। क्या सं. 9 है? हाँ": ["पुराना है।", "क्या सं. 9 है?", "हाँ"],
    "هل نحتاج؟ نعم. لا؛ ربما": ["هل نحتاج؟", "نعم.", "لا؛ ربما"],
    "ช้าเกินไป แคชเก็บ 9 แถว ถูกเรียกซ้ำ ๆ หลายครั้ง": ["ช้าเกินไป", "แคชเก็บ 9 แถว", "ถูกเรียกซ้ำ ๆ หลายครั้ง"],
    "¡Qué lento! ¿Hace falta x? Sí, p. ej. aquí.": ["¡Qué lento!", "¿Hace falta x?", "Sí, p. ej. aquí."],
    "Le journal dit «\u00a0Index périmé. Relancez.\u00a0» et s’arrête. Voir le no. 4, c.-à-d. ici. Fin": ["Le journal dit «\u00a0Index périmé. Relancez.\u00a0» et s’arrête.", "Voir le no. 4, c.-à-d. ici.", "Fin"],
    "Изменили тесты и т. д. Второй проход, т. е. до записи (см. рис. 3). Да": ["Изменили тесты и т. д.", "Второй проход, т. е. до записи (см. рис. 3).", "Да"],
    "  \n \r\n": [],
}


@pytest.mark.parametrize("text", sorted(CASES))
def test_sentences(text):
    starts = sn.Segmenter().starts(text)
    assert [text[a:b].rstrip() for a, b in zip(starts, [*starts[1:], len(text)])] == CASES[text]


def test_document_evidence_settles_an_unknown_abbreviation():
    known = "See the qty. of x is 5. See qty. 7 and qty. of y. The Qty. Manager works."
    assert len(sn.Segmenter().starts("Take the qty. Manager works.")) == 2
    starts = sn.Segmenter().starts(known)
    assert all(known[a:].startswith(("The", "See")) for a in starts)


def _units(text, corpus=None):
    starts = sn.Segmenter(corpus).starts(text)
    return [text[a:b].rstrip() for a, b in zip(starts, [*starts[1:], len(text)])]


def test_the_document_decides_before_the_corpus(monkeypatch):
    monkeypatch.setattr(sn, "PRIOR", {})
    text = "It has qty. of x, qty. of them. Take the qty. Manager works."
    assert len(_units(text, {"qty": "plain"})) == 2
    text = "The qty is odd. A qty was odd. Take the qty. Manager works."
    assert _units(text, {"qty": "goes on"})[-2:] == ["Take the qty.", "Manager works."]


def test_the_corpus_decides_where_the_document_is_silent(monkeypatch):
    text = "See the cf. Manager works. Take 5 approx. Now."
    assert _units(text, {"cf": "plain", "approx": "plain"}) == ["See the cf.", "Manager works.", "Take 5 approx.", "Now."]
    monkeypatch.setattr(sn, "PRIOR", {})
    assert _units(text, {"cf": "goes on", "approx": "may close"}) == ["See the cf. Manager works.", "Take 5 approx.", "Now."]


def test_names_after_abbreviations_come_from_document_then_corpus():
    facts = {"ltd": "may close", "^miller": "name", "^they": "common"}
    assert len(_units("We met Acme Ltd. Miller there.", facts)) == 1
    assert len(_units("We met Acme Ltd. They left.", facts)) == 2
    assert len(_units("We met Acme Ltd. Miller left, a miller as ever.", facts)) == 2
    assert len(_units("We met J. They left.", facts)) == 2 and len(_units("We met J. Miller there.", facts)) == 1


def test_corpus_facts_come_from_counts(spark, monkeypatch):
    monkeypatch.setattr(sn, "PRIOR", {})
    rows = [f"It has zqt. of {i}, see Ltz. Miller {i}.\n\nAll went to Ltz.\n\nWe saw Miller here, the plain word. Then {i} plain things." for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(99, None), (100, "")], "doc_id bigint, text string")
    facts = {r.word: r.role for r in sn.corpus_facts(docs).collect()}
    assert facts["zqt"] == "goes on" and "word" not in facts and "ltz" not in facts
    more = docs.unionByName(docs.selectExpr("doc_id", "'It is ltz. for all, or ltz. of all, at J. Miller.' AS text"))
    facts = {r.word: r.role for r in sn.corpus_facts(more).collect()}
    assert facts["ltz"] == "may close" and facts["^miller"] == "name"
    assert {r.word: r.role for r in sn.corpus_facts(more, at_once=0).collect()} == facts
    assert sn.corpus_facts(docs.limit(0)).count() == 0


def test_the_list_decides_nothing_that_the_corpus_knows(spark, data):
    """On texts of the test data the units are the same with the list emptied."""
    docs = table(spark, data.replace("sf0.001", "sf0.01"), "documents")
    facts = {r.word: r.role for r in sn.corpus_facts(docs).collect()}
    texts = [r.text for r in docs.collect()]
    with_list = [sn.Segmenter(facts).starts(t) for t in texts]
    prior, sn.PRIOR = sn.PRIOR, {}
    try:
        without = [sn.Segmenter({w: r for w, r in facts.items() if r != "plain"}).starts(t) for t in texts]
    finally:
        sn.PRIOR = prior
    differing = sum(len(set(a) ^ set(b)) for a, b in zip(with_list, without))
    assert differing <= 0.001 * sum(map(len, with_list))


def test_sentence_tables(spark, data):
    docs = table(spark, data, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    units = sn.sentence_units(docs).collect()
    starts = {(r.doc_id, r.start_pos) for r in sn.sentence_starts(docs).collect()}
    assert starts == {(r.doc_id, r.start_pos) for r in units}
    for r in units:
        assert texts[r.doc_id][r.start_pos :].startswith(r.text) and not r.text[0].isspace()
    assert {r.doc_id for r in units} == {i for i, t in texts.items() if t and not t.isspace()}
    for i, text in texts.items():  # nothing but white space is left out
        if text:
            first = min((r.start_pos for r in units if r.doc_id == i), default=len(text))
            assert text[:first].strip() == ""


def test_sentence_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "  ", 0), (4, "A. b", 0), (5, "x" * 200_000, 0), (5, "One. Two.", 0)], "doc_id bigint, text string, start_pos int")
    assert sorted((r.doc_id, r.start_pos) for r in sn.sentence_starts(df).collect()) == [(4, 0), (5, 0), (5, 0), (5, 5)]
    assert sn.sentence_starts(df.limit(0)).count() == 0


def test_corpus_evidence_needs_no_more_in_a_larger_corpus(spark):
    silent = "We keep qzty. Five of them."
    known = spark.createDataFrame([(i, "It has qzty. 5 of them.") for i in range(19)] + [(50, silent)], "doc_id bigint, text string")
    others = spark.range(1000, 106_100).selectExpr("id AS doc_id", "'x' AS text")
    for docs in (known, known.unionByName(others)):
        assert [r.start_pos for r in sn.sentence_starts(docs).where("doc_id = 50").collect()] == [0]
    assert sn.sentence_starts(known.where("doc_id = 50")).count() == 2


def test_joined_abbreviations_give_the_same_units(spark, data):
    docs = table(spark, data, "documents")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900_000 + i, f"It has qzty. 5 of them, qzty. Five or {i}.") for i in range(30)] + [(None, "No qzty. Five."), (None, None)], "doc_id bigint, text string"))
    rows = [sorted((r.doc_id or -1, r.start_pos) for r in sn.sentence_starts(more, at_once=n).collect()) for n in (100_000, 0)]
    assert rows[0] == rows[1]


def test_runs_without_white_space_take_linear_time():
    import time

    for text in ("a.b." * 50_000, "(" * 100_000, "[" * 50_000 + ")" * 50_000, "`" + "[)" * 50_000, "Ab" * 50_000 + ".Cd" * 50_000, "« " * 50_000 + "» " * 50_000):
        began = time.perf_counter()
        assert len(sn.Segmenter().starts(text)) >= 1
        assert time.perf_counter() - began < 20
