import fnmatch
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from semindex.functions import embedding, globs, ids, ranking, rules, vectors
from semindex.functions import text as T
from semindex.functions.rules import ACTION_WORDS


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def results(frame, expression):
    return [r[1] for r in sorted(frame.select("i", expression.alias("y")).collect())]


TEXTS = ["getUserName", "snake_case-kebab", "HTTPServer2Go", "  héllo Wörld ", "", "find the Database connection", "UserAuth", "class Foo", "how does login work", "unit tests", "a b c d", "authTOKEN x"]


def test_tokens_and_entity(spark):
    frame = column(spark, TEXTS)

    def tokens(t):
        t = re.sub(r"([a-z])([A-Z])", r"\1 \2", t).replace("_", " ").replace("-", " ")
        return re.findall(r"\w+", t.lower())

    assert results(frame, T.tokens(F.col("x"))) == [tokens(t) for t in TEXTS]

    def entity(t):
        w = tokens(t.lower())
        return len(w) <= 3 and not set(w) & set(ACTION_WORDS) and (bool(re.search("[A-Z][a-z]+[A-Z]", t)) or len(w) <= 2)

    assert results(frame, T.entity_like(F.col("x"))) == [entity(t) for t in TEXTS]


def test_intents(spark):
    asked = ["how does login work", "database connection error", "rest of the api", "unit and more test", "debug", "Try/Catch", "no_test_here", "édb"]
    assert results(column(spark, asked), T.intents(F.col("x"))) == [
        ["function_search", "authentication"], ["error_handling", "database"], ["api"], ["testing"], [], ["error_handling"], [], [],
    ]


def test_snippet(spark):
    texts = ["\n  \n  def   f(x):\n    pass", "", None, "x" * 161, "y" * 160, " \t\r\n"]
    assert results(column(spark, texts), T.snippet(F.col("x"))) == ["def f(x):", "", "", "x" * 157 + "...", "y" * 160, ""]


def embedding_text(name, kind, parent, tags, doc, body, most=2048):
    facts = [f"Name: {name or 'unknown'}", f"Type: {kind or 'unknown'}"]
    facts += [f"Context: {parent}"] if parent else []
    facts += [f"Tags: {', '.join(tags)}"] if tags else []
    left = most - sum(len(f) + 1 for f in facts) - 10
    if left <= 20:
        return f"Name: {name or 'unknown'}\n{(body or '')[: most // 2]}"
    doc = doc or ""
    share = len(doc) if len(doc) < left * 0.5 else min(len(doc), int(left * 0.3))
    header = "\n".join(facts + ([f"Docstring: {doc[:share]}"] if doc else []))
    return f"{header}\n{body[: max(0, most - len(header) - 1)]}" if body else header


def test_embedding_text(spark):
    rng = random.Random(1)
    cases = [("f", "function", "C", ["a", "b"], "d" * n, "x" * m) for n in (0, 10, 900, 1100, 5000) for m in (0, 5, 3000)]
    cases += [(None, None, None, [], None, "body"), ("n" * 2040, "t", "", None, "doc", "y" * 2000), ("n", "t", None, ["t" * 2100], "doc", None)]
    rows = [(i, *c) for i, c in enumerate(cases)]
    frame = spark.createDataFrame(rows, "i int, name string, kind string, parent string, tags array<string>, doc string, body string")
    made = T.embedding_text(*[F.col(c) for c in ("name", "kind", "parent", "tags", "doc", "body")])
    assert results(frame, made) == [embedding_text(*c) for c in cases]
    assert rng


GLOBS = ["*.py", "src/*", "src/**/test_?.py", "[a-c]*.js", "[!a]*", "a[[]b", "x[&&]y", "[]]z", "[!]]z", "a[b", "*/auth/*", "./src/*", "/abs/*", "a.b", "[^a]", "[a-", "[z-a]x"]
PATHS = ["main.py", "src/a.py", "src/x/test_1.py", "lib/b.js", "a[b", "x&y", "]z", "az", "lib/auth/login.py", "./src/q", "/abs/f", "axb", "a.b", "^", "a-", "zx"]


def test_globs(spark):
    frame = column(spark, PATHS)
    for pattern in GLOBS:
        want = []
        for p in PATHS:
            name = p.rsplit("/", 1)[-1]
            hit = fnmatch.fnmatchcase(p, pattern) or fnmatch.fnmatchcase(name, pattern)
            want.append(hit or (not pattern.startswith(("/", "./")) and fnmatch.fnmatchcase(p, f"*/{pattern}")))
        assert results(frame, globs.matches_globs(F.col("x"), pattern)) == want, pattern


def test_ids(spark):
    frame = column(spark, ["f", None])
    got = results(frame, ids.chunk_id(F.lit("a/b.py"), F.col("x"), F.lit(3), F.lit("function")))
    assert got == [hashlib.md5(f"a/b.py:{n}:3:function".encode()).hexdigest() for n in ("f", "None")]
    numbers = results(frame.na.fill("z"), ids.vector_id(F.col("x")))
    assert numbers == [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "big") & (2**63 - 1) for t in (b"f", b"z")]


def test_rules(spark):
    paths = ["a/b.PY", "x.tar.gz", ".env", "Makefile", "a.b/c", "q.c++", "n.d.ts", "f."]
    frame = column(spark, paths)
    assert results(frame, rules.ending(F.col("x"))) == [".py", ".gz", "", "", "", ".c++", ".ts", ""]
    assert results(frame, rules.language(F.col("x"))) == ["python", None, None, None, None, "cpp", "typescript", None]
    assert results(column(spark, ["a/.git/x", "build/y.py", "rebuild/y.py", "z.pyc", "ok.py"]), rules.is_ignored(F.col("x"))) == [True, True, False, True, False]
    assert results(column(spark, ["f", None]), rules.chunk_type(F.lit("function_definition"), F.col("x"))) == ["method", "function"]
    tags = rules.semantic_tags(F.lit(True), F.lit(False), F.lit(True), F.lit(None).cast("boolean"), F.lit(False), F.col("x"))
    assert results(column(spark, ["go"]), tags) == [["async", "export", "go"]]


def test_vectors(spark):
    frame = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0])], "i int, x array<float>")
    assert results(frame, vectors.norm(F.col("x"))) == [5.0, 0.0]
    assert results(frame, vectors.normalise(F.col("x"))) == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]
    assert results(frame, vectors.cosine(F.col("x"), F.array(F.lit(1.0), F.lit(0.0)))) == [pytest.approx(0.6), 0.0]


def test_rank_factors(spark):
    one = column(spark, ["x"])
    value = lambda e: results(one, e)[0]
    assert value(ranking.type_factor(F.lit("the class of it all"), F.lit("class"))) == 1.3
    assert value(ranking.type_factor(F.lit("UserAuth"), F.lit("class"))) == 1.15
    assert value(ranking.type_factor(F.lit("how to do it"), F.lit("module"))) == 0.95
    assert value(ranking.name_factor(F.lit("GetUser"), F.lit("getuser"))) == 1.4
    assert [value(ranking.name_factor(F.lit("a b c d"), F.lit(n))) for n in ("a_b_c_d", "a_b", "a", "z", "")] == [1.3, 1.2, 1.05, 1.0, 1.0]
    assert value(ranking.path_factor(F.lit("auth login"), F.lit("src/auth/login.py"))) == pytest.approx(1.1)
    assert value(ranking.tag_factor(F.lit("sql"), F.array(F.lit("database")))) == pytest.approx(1.1)
    assert value(ranking.docstring_factor(F.lit("user"), F.lit("module"), F.lit("d"))) == 1.02
    assert value(ranking.length_factor(F.lit("x" * 1001))) == 0.98


def test_embedder_registry(spark):
    model = embedding.resolve("default")
    assert embedding.resolve("some/hashing-256") is model
    with pytest.raises(KeyError):
        embedding.resolve("nothing")
    rows = results(column(spark, ["a word", None, "a word"]), embedding.embed(F.col("x")))
    assert rows[0] == rows[2] == pytest.approx(embedding.embed_query("a word"))
    assert len(rows[1]) == model.dimension and not any(rows[1])
