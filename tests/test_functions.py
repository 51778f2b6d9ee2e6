import hashlib
import posixpath

import pytest
from pyspark.sql import functions as F

from tessera.functions import grep_compat, hints
from tessera.functions import paths as P
from tessera.functions import text as T
from tessera.functions import vectors as V


def one(spark, make, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize("path,source,test,docs,workflow", [
    ("src/a.py", True, False, False, False), ("tests/test_a.py", True, True, False, False), ("docs/x.md", False, False, True, False), ("README.md", False, False, True, False),
    (".github/workflows/ci.yml", False, False, False, True), ("docs/conf.py", True, False, True, True), ("pyproject.toml", False, False, False, True), ("a\\b\\Test_x.PY", True, True, False, False), ("x.spec.ts", True, True, False, False),
])
def test_path_classes(spark, path, source, test, docs, workflow):
    assert [one(spark, f, path) for f in (P.is_source, P.is_test, P.is_docs, P.is_workflow)] == [source, test, docs, workflow]


def test_domain_scores(spark):
    assert one(spark, lambda c: P.domain_score(c, "code"), "tests/test_a.py") == 1.0
    assert one(spark, lambda c: P.domain_score(c, "code"), "tests/data.txt") == 0.82
    assert one(spark, lambda c: P.domain_score(c, "docs_policy"), "docs/a.md") == 1.0
    assert one(spark, lambda c: P.domain_score(c, "workflow_config"), "tox.ini") == 1.0
    assert one(spark, lambda c: P.quality(c, "code"), "a/vendor/b.py") == 0.0


def test_prefix_stops_at_a_boundary(spark):
    assert one(spark, lambda c: P.under(c, "src"), "src/a.py") and not one(spark, lambda c: P.under(c, "src/"), "src2/a.py")


def test_globs_cross_slashes(spark):
    assert one(spark, lambda c: P.matches_any(c, ["src/*.py"]), "src/a/b.py") and not one(spark, lambda c: P.matches_any(c, ["*.js"]), "a.py")
    assert one(spark, lambda c: P.allowed(c, ["a"], ["*.py"], ["*x*"]), "a/b.py") and not one(spark, lambda c: P.allowed(c, ["a"], ["*.py"], ["*x*"]), "a/x.py")


@pytest.mark.parametrize("p", ["a//b/./c/../d", "/../a", "../a", "a/..", "", "/", "./x/", "a/b/../../.."])
def test_norm_path(spark, p):
    assert one(spark, T.norm_path, p) == posixpath.normpath(p)


def test_module_distance(spark):
    for a, b, n in [("/r/src/main.py", "/r/src/a.py", 0), ("/r/src/main.py", "/r/tests/t.py", 2), ("/r/src/main.py", "/r/src/u/h.py", 1), ("", "/x/y", 0)]:
        assert one(spark, P.module_distance, a, b) == n


def test_relevance_of_tests(spark):
    assert one(spark, P.test_relevance, "src/net/session.py", "tests/net/test_session.py") == 4
    assert one(spark, P.test_relevance, "src/net/session.py", "tests/net/test_session_more.py") == 3
    assert one(spark, P.test_relevance, "src/net/session.py", "tests/other/test_x.py") == 0


def test_ids_match_plain_hashes(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert one(spark, T.file_node_id, "r", "a/./b.py") == "file:" + sha("r|a/b.py")
    assert one(spark, lambda a, b: T.sha(a, b, F.lit(3)), None, "x") == sha("|x|3")


def test_text_blocks(spark):
    assert one(spark, T.signature_block, "public async def f(a, b) -> int: ...") == "SIGNATURE:\nRAW: public async def f(a, b) -> int: ...\nPARAMS: a, b\nRETURNS: int\nMODIFIERS: public, async, pub"
    assert one(spark, T.signature_block, " ") == "SIGNATURE:\nRAW: <unknown>"
    assert one(spark, lambda c: T.imports_in_scope(T.import_lines(c), F.lit("json.dumps(x)")), "import json\n  from os import path\nx = 1\nuse a") == "IMPORTS_IN_SCOPE:\nimport json"
    assert one(spark, lambda c: T.clip(c, 5), "abcd efg") == "abcd ..." and one(spark, lambda c: T.clip(c, 5), "abc") == "abc"
    assert one(spark, T.strip_docstring, 'def f():\n    """doc\n    x"""\n    return """a"""') == 'def f():\n    \n    return """a"""'
    assert one(spark, T.warning_type, "Low (score=1)") == "Low"
    assert one(spark, T.token_estimate, " a  b\nc ") == 3
    assert one(spark, lambda c: F.array_join(T.reference_tokens(c, F.lit("own")), " "), "own Zed ab alpha return alpha _x9") == "Zed _x9 alpha"


def test_lines_and_spans(spark):
    files = spark.createDataFrame([("a", "é\nb\r\n\nx", "q"), ("b", "", "q"), ("c", "\n" * 100, "q")], "path string, content string, line string")
    spans = {(r.path, r.line): (r.start_byte, r.end_byte) for r in T.line_spans(files).collect()}
    assert [spans["a", i] for i in range(1, 5)] == [(0, 3), (3, 6), (6, 7), (7, 8)] and spans["b", 1] == (0, 0) and spans["c", 101] == (100, 100) and len(spans) == 106
    raw = spark.createDataFrame([(bytearray("é\nb".encode()),)], "c binary")
    assert [raw.select(T.extract_bytes("c", F.lit(a), F.lit(b)).alias("x")).first().x for a, b in ((0, 2), (3, 4), (2, 9))] == ["é", "b", None]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [1.0])], "a array<float>, b array<float>, c array<float>")
    r = df.select(V.l2("a", "b").alias("d"), V.score(V.l2("a", "b")).alias("s"), V.cosine("a", "a").alias("k"), V.l2("a", "c").alias("n"), V.cosine(F.array(F.lit(0.0), F.lit(0.0)), "a").alias("z")).first()
    assert (r.d, r.s, r.k, r.n, r.z) == (2.0, 0.0, 1.0, None, 0.0)


def test_hash_embedding(spark):
    import struct

    import numpy as np

    def ref(text):
        total = np.zeros(256)
        for w in text.split():
            total += [struct.unpack(">I", hashlib.sha256(w.encode() + struct.pack(">I", i // 8)).digest()[4 * (i % 8) : 4 * (i % 8) + 4])[0] / 0xFFFFFFFF * 2 - 1 for i in range(256)]
        return total / np.linalg.norm(total)

    got = [r.v for r in spark.createDataFrame([("foo Bar foo",), (None,), ("",)], "t string").select(V.hash_embedding("t").alias("v")).collect()]
    assert np.allclose(got[0], ref("foo bar foo")) and got[1] is None and abs(np.linalg.norm(got[2]) - 1) < 1e-9


@pytest.mark.parametrize("q,kind", [("Session.mount", "identifier"), ("after_request order", "mixed"), ("forwarded absolute uri", "mixed"), ("class Session", "declaration"), ("getName", "identifier"), ("", "natural_language"), ("foo()", "identifier")])
def test_query_kind(q, kind):
    assert hints.analyze(q).kind == kind


@pytest.mark.parametrize("q,domain", [("backport footer stable branch", "workflow_config"), ("deprecation paper trail docs/internals", "docs_policy"), ("CommonMiddleware APPEND_SLASH", "code"), ("precise", "workflow_config")])
def test_query_domain(q, domain):
    assert hints.analyze(q).domain == domain


def test_domain_by_whole_words():
    assert hints.query_domain("precise", whole_words=True) == "code"


def test_hints():
    h = hints.analyze('where is "Session.mount" in app/net.py:12')
    assert "Session.mount" in h.symbols and h.literals == ["Session.mount"] and ("app/net.py", 12) in h.stack and "session.mount" in h.tokens
    assert hints.analyze("a/b.c").verbatim == "a/b.c" and hints.literal_first("x[0]") and not hints.literal_first("x.y")
    assert hints.identifier_tail("a.b:c") == "c" and hints.identifier_tail("a b") is None
    assert hints.split_operands(["find", "me", "src/x"]) == ("find me", ["src/x"]) and hints.split_operands(["src/x"]) == ("src/x", [])
    assert hints.test_intent("run tests/ now") and not hints.test_intent("latest")


def test_grep_lines():
    g = grep_compat.parse("rg -i -w -F -g '*.py' -g '!x/*' --foo 'a b' src/")
    assert (g.pattern, g.case, g.word, g.fixed, g.include, g.exclude, g.paths, g.unknown, g.quoted) == ("a b", "ignore", True, True, ["*.py"], ["x/*"], ["src"], ["--foo"], True)
    assert grep_compat.parse("rg -A 3 foo").pattern == "foo" and grep_compat.parse("rg -A").error and grep_compat.parse("plain words").command is None
    assert grep_compat.parse("grep -e -x y").pattern == "-x"
    assert grep_compat.java_pattern("a(", "smart") == r"(?i)a\(" and grep_compat.java_pattern("A", "smart") == "A"
