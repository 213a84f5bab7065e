"""Truth tables of the column functions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.vectors import cosine, dot, hash_embedding, hash_embedding_of
from lodestone.operators.grep import covering_ngrams, sparse_ngrams


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_identifier_tokens(spark):
    assert column(spark, ["validateJwt", "HTTPServer", "a_b", "", None], "string", T.identifier_tokens) == ["validatejwt validate jwt", "httpserver http server", "a_b a b", "", None]


def test_identifier_tokens_of_any_letters(spark):
    rng = random.Random(8)
    names = ["ABCd", "aB1c", "HTTPServer2Go", "éAbÉcd", "1Ab2", *["".join(rng.choices("abAB1_.é ", k=rng.randrange(1, 9))) for _ in range(3000)]]
    assert column(spark, names, "string", T.identifier_tokens) == [" ".join(T.identifier_tokens_of(n)) for n in names]


def test_identifier_terms_are_those_of_the_tokens(spark):
    from lodestone.operators.search import terms

    rng = random.Random(9)
    names = ["HTTPServer2Go.runB", "éAbÉcd", "\u212aelvin", "\u0130nit", "a_b", "", *["".join(rng.choices("abAB1_.é \u212a\u0130", k=rng.randrange(1, 9))) for _ in range(3000)]]
    assert [sorted(x) for x in column(spark, names, "string", lambda c: terms(T.identifier_tokens(c)))] == [sorted(T.identifier_terms_of(n)) for n in names]


def test_expand_query():
    assert {"validate", "jwt"} <= set(T.expand_query("validateJwt")) and "auth" in T.expand_query("login flow") and "interceptor" in T.expand_query("middleware layer") and "release" in T.expand_query("deploy pipeline")
    assert T.expand_query("  \"' ") == [] and len(T.expand_query(" ".join(f"w{i}x" for i in range(99)))) == T.MAX_TERMS


def test_query_signals(spark):
    got = column(spark, ["look at `AuthService` in src/auth.ts and validateJwt or my_name", "plain prose only", None], "string", T.query_signals)
    assert got == [["AuthService", "src/auth.ts", "validateJwt", "my_name"], [], None]


def test_classification(spark):
    assert column(spark, ["auth.login", "how does the login work", "fix JWT bug"], "string", T.classify_query) == ["identifier", "natural", "mixed"]
    assert column(spark, ["", "commit the AuthService fix", "commit this please", "explain the cache", "thanks", "do the thing"], "string", T.classify_intent) == ["meta", "code", "meta", "question", "meta", "code"]


def test_ignore_rules(spark):
    rules = T.ignore_rules(("dist/", "!dist/keep.ts", "/generated"))
    paths = ["dist/a.ts", "dist/keep.ts", "generated/x.ts", "src/generated/x.ts", "a/b.min.js", "node_modules/x/y.js", "test/a.ts", "../x.ts", "src/a.ts", "public/js/v.min.css", None]
    assert column(spark, paths, "string", lambda c: T.is_ignored(c, rules)) == [True, False, True, False, True, True, False, True, False, True, True]


def test_safe_paths(spark):
    assert column(spark, ["a/b", "/etc", "../x", "a/../b", "a/../../b", "", None, "a\x00b", "./a"], "string", T.is_safe_path) == [True, False, False, True, False, False, False, False, True]


def test_scoped_walks(spark):
    df = spark.createDataFrame([(0, "src/auth", 1), (1, ".", None), (2, "src/**", None), (3, ".git/x", 9), (4, "src", 2), (5, None, None), (6, "./src/", None)], "i int, p string, d int")
    assert [r[0] for r in df.orderBy("i").select(T.is_scoped_walk(F.col("p"), F.col("d"))).collect()] == [True, False, False, True, False, False, True]


@pytest.mark.parametrize(
    "command,found",
    [("grep -rn x src", True), ("grep x src/a.ts", False), ("grep x src", True), ("rg x", True), ("rg x a.ts", False), ("npm test | rg x", False), ("find . -name '*.ts'", True), ("ag x", True), ("git grep x", True), ("ls src | grep ts", True), ("A=1 grep -R x .", True), ("echo hi && rg x", True), ("", False), ("git status", False)],
)
def test_shell_discovery(spark, command, found):
    assert column(spark, [command], "string", T.is_shell_discovery) == [found]


def test_health_classes(spark):
    assert column(spark, [0.6, 0.3, 0.1, None, float("nan")], "double", lambda c: T.health_class("hit_rate", c)) == ["ok", "warn", "bad", None, None]
    assert column(spark, [10.0, 0.0, -10.0], "double", lambda c: T.health_class("net", c)) == ["ok", "warn", "bad"]
    assert column(spark, [0.4], "double", lambda c: T.health_class("coverage", c)) == ["bad"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0, 5.0]), (None, [1.0]), ([0.0], [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(dot(F.col("a"), F.col("b"))).collect()] == [11.0, None, 0.0]
    assert df.select(cosine(F.col("a"), F.col("b"))).collect()[2][0] is None


def test_hash_embedding_matches_its_driver_form(spark):
    texts = ["Validate the JWT token", "", "a a a", "ünï code_x"]
    sparse = hash_embedding(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", 64).collect()
    for i, text in enumerate(texts):
        v = np.zeros(64)
        for r in sparse:
            if r.id == i:
                v[r.idx] = r.weight
        norm = np.linalg.norm(v)
        assert np.allclose(v / norm if norm else v, hash_embedding_of(text, 64))


def test_ngrams_of_a_literal_are_ngrams_of_every_text_with_it():
    for text, literal in [("const loadPolicy = 3", "loadPolicy"), ("xx_validate_yy", "validate"), ("aaaaaaaa", "aaa"), ("Ünïcode flow", "code")]:
        held = set(sparse_ngrams(text.encode()))
        assert set(covering_ngrams(literal)) <= held and covering_ngrams(literal)


def test_literals_of_regex():
    assert T.literals_of_regex("a1|b2") == [] and T.literals_of_regex("load policy") == ["load", "policy"] and T.literals_of_regex("x?yz") == []
