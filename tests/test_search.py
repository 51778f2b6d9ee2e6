import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.hints import analyze
from tessera.operators import fusion as X
from tessera.operators import lexical as L
from tessera.operators import occurrences as O
from tessera.operators import router as R
from tessera.operators import semantic as S

FILES = {
    "src/app/session.py": "import os\nclass Session:\n    def mount(self):\n        return mount_all()\n",
    "tests/app/test_session.py": "from app import session\ndef test_mount():\n    session.mount()\n",
    "docs/guide.md": "how mount works\n",
    "src/app/other.py": "def mount_all():\n    pass\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, "python" if p.endswith("py") else "md", t, 1) for p, t in FILES.items()], "path string, language string, content string, text int")


def test_identifier_puts_definitions_first(spark, files):
    got = L.search(T.lines(files), analyze("mount"), 10).collect()
    assert got[0].match_role == "definition" and got[0].path in ("src/app/session.py", "src/app/other.py")
    roles = [r.match_role for r in got]
    assert roles == sorted(roles, key=L.ROLES.index)


def test_declaration_keeps_definitions_only(spark, files):
    assert {r.match_role for r in L.search(T.lines(files), analyze("def mount"), 10).collect()} == {"definition"}
    assert L.search(T.lines(files), analyze("def absent_name"), 10).count() == 0


def test_primary_pattern_excludes_fallback(spark, files):
    h = analyze("mount_all()/x")
    assert h.verbatim and L.search(T.lines(files), h, 5).count() == 0
    primary, fallback = L.patterns(h, locator=False)
    assert len(primary) == 1 and fallback


def test_boosts_in_a_file(spark, files):
    h = analyze("session order mount")
    rows = L.boosted(L.matches(T.lines(files), L.patterns(h)[1], h), h).collect()
    assert {r.path: r.in_file for r in rows}["tests/app/test_session.py"] == 2
    assert all(0 <= r.score <= 1 for r in rows)


def test_case_and_words(spark, files):
    ls = T.lines(files)
    assert L.scan(ls, ["SESSION"], 9).count() == 0 and L.scan(ls, ["SESSION"], 9, case="ignore").count() == 3
    assert L.scan(ls, ["mount"], 9, word=True).count() == 3 and L.scan(ls, ["mount("], 9, fixed=True).count() == 3
    assert [r.pattern_index for r in L.scan(ls, ["import os", "import"], 9).collect()] == [0, 1]
    with pytest.raises(ValueError):
        L.matches(ls, [], analyze("x"))


def test_occurrences(spark):
    f = spark.createDataFrame([("a.py", "python", "def alpha():\n    pass\ndef beta():\n    alpha(); alpha()\n")], "path string, language string, content string")
    s = spark.createDataFrame([("1", "alpha", "a.py", 1, 2, "python", None, "def alpha()", "c"), ("2", "beta", "a.py", 3, 4, "python", None, "def beta()", "c")], "id string, name string, file_path string, start_line int, end_line int, language string, container_fqname string, signature string, commit_hash string")
    occ = O.build(f, s).collect()
    assert [(r.start_line, r.end_line) for r in occ if r.symbol == "alpha" and r.kind == "def"] == [(1, 2)]
    assert [r.start_line for r in occ if r.symbol == "alpha" and r.kind == "ref"] == [4]
    keys = [(r.symbol, r.path, r.start_line) for r in occ if r.kind == "ref"]
    assert len(keys) == len(set(keys)) and "pass" in {k[0] for k in keys}
    df = O.build(f, s)
    assert [r.kind for r in O.search(df, analyze("alpha"), 9).collect()] == ["def", "ref"]
    assert [r.kind for r in O.search(df, analyze("who calls alpha"), 1).collect()] == ["ref"]
    assert [r.kind for r in O.search(df, analyze("def alpha"), 9).collect()] == ["def"]
    assert O.listing(df, ["a.py"], "python").count() == len(occ) and O.listing(df, ["a"]).count() == 0
    assert {r.symbol: (r.defs, r.refs, r.files) for r in O.token_stats(df).collect()}["alpha"] == (1, 1, 1)


def test_symbol_scores(spark):
    df = spark.createDataFrame([("Session.mount",), ("mount",), ("remount",), ("zzz",)], "n string")
    got = {r.n: r.s for r in df.select("n", O.match_score(F.col("n"), analyze("Session.mount")).alias("s")).collect()}
    assert got == {"Session.mount": 1.0, "mount": 0.96, "remount": 0.74, "zzz": 0.0}
    got = {r.n: r.s for r in df.select("n", O.match_score(F.col("n"), analyze("Session.mount"), exact_only=True).alias("s")).collect()}
    assert got["remount"] == 0.0


def test_knn(spark):
    v = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [0.0, 1.0]), ("c", [1.0, 0.0]), ("d", None), ("e", [1.0])], "id string, vector array<float>")
    assert [(r.id, r.distance) for r in S.knn(v, [0.0, 1.0], 2).collect()] == [("a", 0.0), ("b", 0.0)]
    assert S.knn(v.limit(0), [1.0], 2).count() == 0


def test_knn_batch_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:60] = x[0]
    v = spark.createDataFrame([(f"{i:03d}", x[i].tolist()) for i in range(300)] + [("odd", [1.0])], "id string, vector array<float>")
    q = v.filter("id < '007'").withColumnRenamed("id", "query_id")
    got = {}
    for r in S.knn_batch(v, q, 4, block=3, part=70).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for i in range(7):
        d = ((x.astype(float) - x[i].astype(float)) ** 2).sum(1)
        assert got[f"{i:03d}"] == [f"{j:03d}" for j in sorted(range(300), key=lambda j: (d[j], j))[:4]]


C = "chunk_id string, symbol_id string, start_line int, end_line int, chunk_part_index int, name string"
Y = "id string, name string, kind string, fqname string, file_path string, start_line int, end_line int, language string, commit_hash string"


def test_ranking_and_one_chunk_per_symbol(spark):
    s = spark.createDataFrame([("sym-src", "mount", "function", "", "/r/src/a.py", 1, 2, "python", "c"), ("sym-test", "test_mount", "function", "", "/r/tests/test_a.py", 1, 2, "python", "c")], Y)
    c = spark.createDataFrame([("chunk-src-1", "sym-src", 1, 2, 1, ""), ("chunk-src-2", "sym-src", 3, 4, 2, ""), ("chunk-test-1", "sym-test", 1, 2, 1, "")], C)
    hits = spark.createDataFrame([("chunk-src-1", 0.2), ("chunk-src-2", 0.1), ("chunk-test-1", 0.05), ("lost", 0.0)], "id string, distance double")
    got = S.search(hits, c, s, S.ranking("find it", "source-first"), 2).collect()
    assert [(r.symbol_id, r.chunk_id) for r in got] == [("sym-src", "chunk-src-2"), ("sym-test", "chunk-test-1")]
    got = S.search(hits, c, s, S.ranking("Session.mount"), 2).collect()
    assert got[0].symbol_id == "sym-src" and got[0].ranking_score >= got[0].similarity
    assert S.ranking("tests for mount", "source-first").penalise_tests is False
    assert [S.fetch_size(5, S.ranking(q, p), f) for q, p, f in (("a b", "balanced", False), ("ab", "balanced", False), ("ab", "source-first", False), ("ab", "balanced", True), ("a b", "balanced", True))] == [10, 40, 50, 60, 60]
    assert [r.chunk_id for r in S.structured(s, c, F.col("name") == "mount", 5).collect()] == ["chunk-src-1"]


def test_structural_neighbors(spark):
    s = spark.createDataFrame([(str(i), "n", "k", "", "f", 10 * i + 1, 10 * i + 4, "p", "c") for i in range(40)] + [("z", "n", "k", "", "g", 1, 500, "p", "c"), ("y", "n", "k", "", "g", 200, 300, "p", "c")], Y)
    got = {(r.symbol_id, r.neighbor_id): r.gap for r in S.structural_neighbors(s, 8).collect()}
    assert got == {(str(a), str(b)): 7 for a in range(40) for b in (a - 1, a + 1) if 0 <= b < 40} | {("z", "y"): 0, ("y", "z"): 0}


def hit(b, i, path, start, end, score, tags=(), role=None, q="q"):
    return (q, b, i, path, start, end, "snip", score, list(tags), role)


def q(spark, kind="mixed", domain="code", **k):
    return spark.createDataFrame([("q", kind, domain, k.get("tokens", ["mount"]), 3, False)], "query_id string, kind string, domain string, tokens array<string>, max_snippets int, literal_first boolean")


def test_rrf_puts_the_shared_hit_first(spark):
    h = spark.createDataFrame([hit("exact", 0, "a", 1, 1, 0.4), hit("exact", 1, "b", 1, 1, 0.3), hit("semantic", 0, "b", 1, 1, 0.3), hit("semantic", 1, "c", 1, 1, 0.2)], X.HITS)
    assert X.rrf(h, 3).orderBy("rank").first().path == "b"
    assert X.fuse(h, X.weights(X.backend_quality(h, q(spark))), 3).orderBy("idx").first().path == "b"


def test_allocation():
    assert X.allocate({"exact": 10, "semantic": 10}, {"exact": 0.75, "semantic": 0.25}, 10) == {"exact": 7, "semantic": 3}
    assert X.allocate({"exact": 1, "symbol": 0, "semantic": 9}, {"exact": 1.0, "symbol": 1.0, "semantic": 0.1}, 5) == {"exact": 1, "semantic": 4}
    assert X.allocate({"exact": 3, "semantic": 3}, {"exact": 0.0, "semantic": 0.0}, 1) == {"exact": 1, "semantic": 0}


def test_pack_interleaves_and_removes_overlaps(spark):
    rows = [hit("exact", 0, "a", 1, 9, 0.9), hit("exact", 1, "a", 2, 3, 0.8), hit("exact", 2, "a", 20, 20, 0.7), hit("exact", 3, "b", 1, 1, 0.6), hit("exact", 4, "a", 30, 30, 0.5)]
    got = X.pack(spark.createDataFrame(rows, X.HITS)).orderBy("rank").collect()
    assert [(r.path, r.start_line) for r in got] == [("a", 2), ("b", 1), ("a", 20), ("a", 30)]
    got = X.pack(spark.createDataFrame(rows, X.HITS), preserve=True, max_files=1).orderBy("rank").collect()
    assert [(r.path, r.start_line) for r in got] == [("a", 1), ("a", 20), ("a", 30)]
    assert X.pack(spark.createDataFrame(rows, X.HITS), max_chars=6).count() == 1
    assert X.pack(spark.createDataFrame([], X.HITS)).count() == 0


def test_rerank_rescue_rebalance(spark):
    lex = spark.createDataFrame([hit("exact", 0, "a", 1, 1, 0.9), hit("exact", 1, "b", 5, 5, 0.8)], X.HITS)
    sem = spark.createDataFrame([hit("semantic", 0, "b", 7, 9, 0.9), hit("semantic", 1, "z", 1, 1, 0.5)], X.HITS)
    assert [(r.path, r.overlap) for r in X.rerank(lex, sem).orderBy("new_idx").collect()] == [("b", 0.92), ("a", 0.0)]
    assert [r.path for r in X.rescue(sem, q(spark)).collect()] == ["b"]
    assert X.rescue(spark.createDataFrame([hit("semantic", 0, "b", 1, 1, 0.9), hit("semantic", 1, "c", 1, 1, 0.87)], X.HITS), q(spark)).count() == 0
    mix = spark.createDataFrame([hit("exact", 0, "docs/x.md", 1, 1, 0.9), hit("exact", 1, "tests/net/test_session.py", 1, 1, 0.5), hit("exact", 2, "src/net/session.py", 1, 1, 0.8, role="definition"), hit("exact", 3, "src/net/z.py", 1, 1, 0.8, role="import")], X.HITS)
    assert [r.idx for r in X.rebalance(mix, q(spark)).orderBy("new_idx").collect()] == [2, 1, 0, 3]
    assert [r.idx for r in X.rebalance(mix, q(spark, "identifier")).orderBy("new_idx").collect()] == [0, 1, 2, 3]


def test_decision(spark):
    def run(rows, **k):
        h, qs = spark.createDataFrame(rows, X.HITS), q(spark, **k)
        quality = X.backend_quality(h, qs)
        return X.decide(X.pack(h), X.route(quality, qs), quality, qs).first()

    d = run([hit("exact", 0, "src/mount.py", 1, 1, 1.0, ["symbol_match"], "definition")], kind="identifier")
    assert (d.strategy, d.decisive, d.next_action, d.status) == ("exact", True, "open_hit_1", "decisive")
    d = run([hit("exact", 0, "src/mount.py", 1, 1, 1.0), hit("exact", 1, "src/mount.py", 9, 9, 0.99)], kind="identifier")
    assert (d.decisive, d.next_action, d.suggested_prefix) == (False, "narrow_by_path", "src/mount.py")
    d = run([hit("semantic", 0, "x/a.txt", 1, 1, 0.1)])
    assert (d.strategy, d.status) == ("suppressed", "suppressed")


def test_routed_search(spark, files):
    s = spark.createDataFrame([("1", "mount", "src/app/session.py", 3, 4, "python", "Session", "def mount(self)", "c")], "id string, name string, file_path string, start_line int, end_line int, language string, container_fqname string, signature string, commit_hash string")
    index = R.Index(T.lines(files), O.build(files, s))
    hits, decision = R.search(index, "def mount")
    assert hits.orderBy("rank").first().path.startswith("src/app/") and decision.first().n_hits > 0
    hits, _ = R.search(index, "rg -w mount tests/", R.Intent())
    assert {r.path for r in hits.collect()} <= {"tests/app/test_session.py"}
    hits, decision = R.search(index, "absent_thing_here")
    assert hits.count() == 0 and decision.first().status in ("suppressed", "no_match")
    assert R.as_json(R.search(index, "mount", R.Intent(mode="symbol"))[0]).count() >= 1
    again = [tuple(r) for r in R.search(index, "def mount")[0].orderBy("rank").drop("tags").collect()]
    assert again == [tuple(r) for r in R.search(index, "def mount")[0].orderBy("rank").drop("tags").collect()]


def test_confidence_and_evidence(spark):
    p = X.pack(spark.createDataFrame([hit("exact", i, f"f{i}", 1, 1, s) for i, s in enumerate((0.9, 0.6, 0.3, 0.1))], X.HITS))
    assert X.retrieval_confidence(p).first().confidence == round(0.63 + 0.18, 9)
    e = X.evidence(p, 0.5, 2).first()
    assert (e.n_items, e.n_confident, e.grounded, e.reason) == (4, 2, True, "grounding_ok")
    assert [X.next_top_k(k) for k in (1, 5, 40)] == [2, 10, 64]


SEM = "path string, start_line int, end_line int, snippet string, raw_score double"


def _about(spark, files, query, near, about="how it mounts", allowed=None, **intent):
    empty = spark.createDataFrame([], "id string, name string, file_path string, start_line int, end_line int, language string, container_fqname string, signature string, commit_hash string")
    asked = []

    def semantic(hints, where, k):
        asked.append(hints.query)
        return spark.createDataFrame(near, SEM)

    health = None if allowed is None else spark.createDataFrame([(allowed,)], "semantic_allowed boolean")
    index = R.Index(T.lines(files), O.build(files, empty), semantic, health)
    hits, decision = R.search(index, query, R.Intent(about=about, **intent))
    return [(r.path, r.start_line) for r in hits.orderBy("rank").collect()], decision.first(), asked


def test_vectors_rescue_a_search_without_hits(spark, files):
    hits, d, asked = _about(spark, files, "absent thing", [("src/a.py", 3, 9, "x", 0.9), ("src/b.py", 1, 2, "x", 0.5)])
    assert hits == [("src/a.py", 3)] and (d.strategy, d.assist, d.decisive, d.reason, d.status) == ("semantic", "semantic_rescue", True, "semantic_rescue", "decisive") and asked == ["how it mounts"]
    hits, d, _ = _about(spark, files, "absent thing", [("src/a.py", 3, 9, "x", 0.9), ("src/b.py", 1, 2, "x", 0.88)])
    assert hits == [] and d.assist == "none"
    hits, d, asked = _about(spark, files, "absent thing", [("src/a.py", 3, 9, "x", 0.9)], allowed=False)
    assert hits == [] and asked == []


def test_only_documentation_is_rescued_or_suppressed(spark):
    docs = spark.createDataFrame([("docs/mount.md", "markdown", "how to mount things\nmount it\n"), ("docs/other.md", "markdown", "mount\n")], "path string, language string, content string")
    hits, d, _ = _about(spark, docs, "mount", [("src/a.py", 3, 9, "x", 0.95)])
    assert hits == [("src/a.py", 3)] and d.reason == "semantic_rescue"
    hits, d, _ = _about(spark, docs, "mount", [("src/a.py", 3, 9, "x", 0.5)])
    assert hits == [] and (d.strategy, d.reason) == ("suppressed", "semantic_rescue_not_confident")
    hits, d, _ = _about(spark, docs, "mount guide", [("src/a.py", 3, 9, "x", 0.95)])
    assert hits and d.strategy != "suppressed" and hits[0][0].startswith("docs/")


def test_vectors_reorder_lexical_hits(spark):
    src = spark.createDataFrame([(f"src/m{i}.py", "python", "x = 1\nreturn mount_order(safe)\n") for i in range(4)], "path string, language string, content string")
    plain, _, _ = _about(spark, src, "mount order", [])
    hits, d, _ = _about(spark, src, "mount order", [("src/m3.py", 2, 4, "x", 0.8)])
    assert hits[0] == ("src/m3.py", 2) and plain[0] != hits[0] and sorted(plain) == sorted(hits) and (d.assist, d.reason) == ("rerank", "semantic_rerank")


def test_retry_until_confident(spark):
    make = lambda k: spark.createDataFrame([("q", 0.3 + 0.1 * min(k, 6))], "query_id string, raw_score double")
    _, how = R.search_with_retry(make, 1, 0.85, 5)
    assert (how["final_top_k"], how["retry_attempts"], how["low_confidence"]) == (8, 3, False)
    assert R.search_with_retry(make, 1, 0.99, 2)[1] == {"initial_confidence": 0.4, "final_confidence": 0.7, "initial_top_k": 1, "final_top_k": 4, "retry_attempts": 2, "retry_performed": True, "low_confidence": True}
    assert R.search_with_retry(make, 1, 0.85, 0)[1]["retry_performed"] is False


def test_contracts(spark):
    import json

    from tessera.operators import contracts as K

    qs = spark.createDataFrame([("q", "identifier", "code", ["mount"], 3, False, "it's mount", None)], "query_id string, kind string, domain string, tokens array<string>, max_snippets int, literal_first boolean, query string, about string")

    def run(rows):
        h = spark.createDataFrame(rows, X.HITS)
        quality = X.backend_quality(h, qs)
        p = X.pack(h)
        d = X.decide(p, X.route(quality, qs), quality, qs)
        return json.loads(K.find_contract(p, d, qs).first().value), K.pack_contract(p, d, qs, K.snapshot(spark.createDataFrame([("last_success_at", "x")], "key string, value string"), "mini"))

    one, _ = run([hit("exact", 0, "src/mount.py", 1, 1, 1.0, ["symbol_match"], "definition"), hit("exact", 1, "src/z.py", 1, 1, 0.5)])
    assert one["contract_version"] == "find_v1" and len(one["hits"]) == 1 and one["decision"]["target"] == {"kind": "hit", "rank": 1, "path": "src/mount.py", "start_line": 1, "end_line": 1} and "suggested_next_command" not in one["decision"]
    two, packs = run([hit("exact", 0, "src/mount.py", 1, 1, 1.0), hit("exact", 1, "src/mount.py", 9, 9, 0.99)])
    assert two["decision"]["suggested_next_command"] == "tessera find 'it'\"'\"'s mount' --file src/mount.py" and two["decision"]["target"] == {"kind": "file", "path": "src/mount.py"} and len(two["hits"]) == 2
    dirs, _ = run([hit("exact", 0, "src/a b/x.py", 1, 1, 0.9), hit("exact", 1, "src/a b/y.py", 9, 9, 0.9)])
    assert dirs["decision"]["suggested_next_command"].endswith("--path-prefix 'src/a b'") and dirs["decision"]["target"]["kind"] == "path_prefix"
    v2 = json.loads(packs.first().value)
    assert v2["schema_version"] == 2 and v2["summary"]["needs_reindex"] is True and v2["hits"][0]["span"] == {"start_line": 1, "end_line": 1}
    assert [(r.file, r.line, r.ranking_score) for r in K.legacy_results(packs).orderBy("rank").collect()] == [("src/mount.py", 1, 1.0), ("src/mount.py", 9, 0.99)]


def test_state_of_an_index(spark):
    from tessera.operators import contracts as K

    def state(**m):
        return K.snapshot(spark.createDataFrame([*m.items()], "key string, value string"), "mini", "2").first()

    good = dict(last_success_at="t", index_profile="mini|edges", vector_cache="passed", chunk_span="passed", tool_version="2")
    assert state(**good).asDict() == {"needs_reindex": False, "reindex_reason": None, "semantic_allowed": True, "warning_codes": []}
    assert state(**good | {"index_profile": "big"}).reindex_reason == "embedding profile changed" and not state(**good | {"index_profile": "big"}).semantic_allowed
    assert state(**good | {"vector_cache": "failed", "tool_version": "1"}).warning_codes == ["tool_version_changed", "vector_integrity_failed"]
    assert state(build_state="interrupted").warning_codes == ["reindex_required", "index_interrupted", "vector_integrity_missing", "chunk_span_integrity_missing"]
    assert K.provenance_warnings({}) == ["artifact_manifest_provenance_missing"] and K.provenance_warnings({"provenance": {}}) == []
