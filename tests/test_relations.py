import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import chunking as C
from tessera.operators import coverage as V
from tessera.operators import guidance as U
from tessera.operators import metrics as M
from tessera.operators import relations as R

NOW = dt.datetime(2025, 1, 1)


def test_schemas_conform(spark):
    for name in R.SCHEMAS:
        assert R.conform(R.empty(spark, name), name).dtypes == R.empty(spark, name).dtypes
    df = R.conform(spark.createDataFrame([("a", 1)], "path string, extra int"), "files")
    assert df.columns == ["path", "language", "content_hash", "last_indexed"] and df.first().path == "a"


def test_filters(spark):
    s = spark.createDataFrame([("1", "class", "src/a.py", "python"), ("2", "function", "src2/a.py", "python"), ("3", "class", "src/b.js", "javascript")], "id string, kind string, file_path string, language string")
    ids = lambda **k: sorted(r.id for r in R.filter_symbols(s, **k).collect())
    assert ids(file_path="src") == ["1", "3"] and ids(kinds=["class"], language="python") == ["1"] and ids(file_path="./src/a.py") == ["1"] and ids() == ["1", "2", "3"]
    assert [r.file_path for r in R.sample_paths(s, 2).collect()] == ["src/a.py", "src/b.js"]


def test_changes(spark):
    old = spark.createDataFrame([("1", "a", "h1"), ("2", "a", "h2"), ("3", "b", "h3"), ("4", "c", None)], "id string, file_path string, body_hash string")
    new = spark.createDataFrame([("1", "a", "h1"), ("2", "a", "x"), ("5", "b", "h5"), ("4", "c", None)], "id string, file_path string, body_hash string")
    assert {r.file_path: (r.added, r.updated, r.removed) for r in R.symbol_changes(old, new).collect()} == {"a": (0, 1, 0), "b": (1, 0, 1), "c": (0, 0, 0)}
    assert {r.id: r.body_hash for r in R.upsert(old, new, ["id"]).collect()} == {"1": "h1", "2": "x", "3": "h3", "4": None, "5": "h5"}
    touched = spark.createDataFrame([("a",)], "p string")
    assert sorted(r.id for r in R.replace_files(old, new.filter("id = '2'"), touched, "file_path").collect()) == ["2", "3", "4"]
    assert sorted(r.id for r in R.delete(old, new, ["id"]).collect()) == ["3"]
    kept = R.prune({"symbols": old, "metadata": old}, touched)
    assert sorted(r.id for r in kept["symbols"].collect()) == ["1", "2"] and kept["metadata"].count() == 4
    assert sorted(r.id for r in R.prune({"symbols": old}, touched, "b")["symbols"].collect()) == ["1", "2", "4"]
    plan = R.change_plan(old.selectExpr("file_path AS path", "body_hash AS content_hash").filter("path <> 'c'").dropDuplicates(["path"]), spark.createDataFrame([("b", "h3"), ("n", "q")], "path string, content_hash string"))
    assert {r.path: r.change for r in plan.collect()} == {"a": "removed", "b": "unchanged", "n": "added"}
    assert tuple(R.reconcile(old, new, "id").first()) == (3, 1, 1)
    assert tuple(R.reconcile(old, new, "id", touched).first()) == (1, 1, 3)


def test_ledger(spark):
    led = spark.createDataFrame([("p", "chunk", "h", [1.0], 1, NOW, NOW), ("p", "chunk", "h", [2.0], 1, NOW + dt.timedelta(1), NOW + dt.timedelta(1)), ("q", "chunk", "h", [9.0], 1, NOW, NOW)], R.SCHEMAS["embedding_ledger"])
    got = {r.embedding_profile: r for r in R.ledger_merge(led, led.limit(0)).collect()}
    assert got["p"].vector == [2.0] and got["p"].created_at == NOW and got["q"].vector == [9.0]
    texts = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")
    led2 = led.withColumn("text_hash", F.sha2(F.lit("b"), 256))
    rows, todo = R.ledger_lookup(texts, led2, "p", "chunk")
    assert [r.text for r in todo.collect()] == ["a"] and rows.count() == 4 and rows.filter("vector IS NOT NULL").count() == 1
    assert R.ledger_lookup(texts, led2, "other", "chunk")[1].count() == 2


def test_audit_rows(spark):
    old = spark.createDataFrame([("s", ["w"], 0.5, None, "p"), ("t", [], None, None, None)], R.SCHEMAS["audits"])
    new = spark.createDataFrame([("s", ["v"], None, None, None), ("u", ["z"], None, None, "k")], R.SCHEMAS["audits"])
    got = {r.symbol_id: (r.warnings, r.file_path) for r in R.audit_merge(old, new).collect()}
    assert got == {"s": (["v"], "p"), "t": ([], None), "u": (["z"], "k")}
    syms = spark.createDataFrame([("t", "p")], "id string, file_path string")
    assert sorted(r.symbol_id for r in R.audits_for_file(old, syms, "p").collect()) == ["s", "t"]
    assert [r.symbol_id for r in R.reusable_audits(old, spark.createDataFrame([("p", "1"), ("k", "2")], "path string, content_hash string"), spark.createDataFrame([("p", "1"), ("k", "3")], "path string, content_hash string")).collect()] == ["s"]


def test_store_publishes_at_once(spark, tmp_path):
    st = R.Store(spark, str(tmp_path / "s"), keep=1)
    a = spark.createDataFrame([("a", "x", "h", NOW)], R.SCHEMAS["files"])
    assert st.read("files").count() == 0
    b = st.stage({"files": a}, "one")
    assert st.read("files").count() == 0
    st.publish(b)
    st.publish(st.stage({"files": a.unionByName(a)}, "two"))
    assert st.current() == "two" and st.read("files").count() == 2 and not (tmp_path / "s/builds/one").exists()


def test_codes_and_checkpoints(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", None, "c"])], "x array<string>, y array<string>")
    assert df.select(R.merge_codes(F.col("x"), F.col("y"), F.lit(None).cast("array<string>")).alias("z")).first().z == ["a", "b", "c"]
    log = spark.createDataFrame([("p", "old", 1), ("p", "new", 2)], "path string, state string, updated_at int")
    assert [(r.path, r.state) for r in R.checkpoint_log(log).collect()] == [("p", "new")]


def test_merged_lines(spark):
    s = spark.createDataFrame([("a", 1, 5), ("a", 3, 8), ("a", 9, 10), ("a", 20, 20), ("a", 20, 20), ("b", 5, 4), (None, 1, 2)], "path string, start_line int, end_line int")
    assert [tuple(r) for r in M.merged_line_count(s).collect()] == [("a", 11, 15)]


def test_warning_summary(spark):
    a = spark.createDataFrame([("1", ["Missing docstring", "Low (x)"]), ("2", ["Low (y)"]), ("3", [])], "symbol_id string, warnings array<string>")
    p = spark.createDataFrame([("1", "src/a"), ("2", "tests/b"), ("3", "src/c")], "symbol_id string, file_path string")
    got = {(r.grouping, r.key): r.n for r in M.warning_summary(a, p).collect()}
    assert got == {("type", "Missing docstring"): 1, ("type", "Low"): 2, ("path_class", "src"): 2, ("path_class", "tests"): 1, ("path_class", "scripts"): 0, ("path_class", "other"): 0, ("file", "src/a"): 2, ("file", "tests/b"): 1}
    assert [(r.key, r.n) for r in M.top_files(M.warning_summary(a, p), 1).collect()] == [("src/a", 2)]


def test_small_summaries(spark):
    e = spark.createDataFrame([("c1", ["a", "b"], ["z"], False), ("c2", ["a"], ["q"], True), ("c3", [], [], False)], "case_id string, expected array<string>, forbidden array<string>, known_gap boolean")
    g = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "q")], "case_id string, name string")
    assert {r.case_id: r.status for r in M.capability_check(e, g).collect()} == {"c1": "pass", "c2": "gap", "c3": "pass"}
    c = M.comparison(spark.createDataFrame([("m", 2.0, 4.0), ("n", 1.0, 0.0)], "metric string, current double, baseline double"), False).collect()
    assert [(r.delta_pct, r.verdict) for r in c] == [(-50.0, "improved"), (None, "regressed")]
    assert tuple(M.checkpoint_stats(spark.createDataFrame([("extract_complete",), ("embedded_complete",)], "state string")).first()) == (2, 1, 1)


def test_coverage(spark):
    s = spark.createDataFrame([("func1", "m.py", 5, 10, ["old"], "c"), ("func2", "m.py", 15, 20, ["old"], "c"), ("func3", "m.py", 30, 31, ["old"], "c"), ("far", "n.py", 1, 2, ["keep"], "c")], "id string, file_path string, start_line int, end_line int, covered_by array<string>, commit_hash string")
    cov = spark.createDataFrame([("test_func1", "m.py", 6), ("test_func1", "m.py", 7), ("test_integration", "m.py", 9), ("test_integration", "m.py", 16)], "test_id string, path string, line int")
    assert {r.id: r.covered_by for r in V.apply_coverage(s, cov).collect()} == {"func1": ["old", "test_func1", "test_integration"], "func2": ["old", "test_integration"], "func3": [], "far": ["keep"]}
    assert {(r.id, r.test_id) for r in V.covering_tests(cov, s, band=2).collect()} == {("func1", "test_func1"), ("func1", "test_integration"), ("func2", "test_integration")}
    ctx = V.import_contexts(spark.createDataFrame([(1, "suite::test_add|run"), (2, "plain_context"), (3, "")], "id int, context string"), spark.createDataFrame([(1, "src/service.py")], "id int, path string"), spark.createDataFrame([(1, 1, 12), (1, 2, 14), (99, 1, 20), (1, 99, 30), (1, 3, 1)], "file_id int, context_id int, line int"))
    assert {tuple(r) for r in ctx.collect()} == {("suite::test_add", "src/service.py", 12), ("plain_context", "src/service.py", 14)}


def test_audit(spark):
    S = "id string, kind string, docstring string, file_path string, language string, commit_hash string"
    s = spark.createDataFrame([("a", "function", None, "p", "python", "c"), ("b", "method", None, "p", "python", "c"), ("c", "class", "alpha beta gamma", "p", "python", "c"), ("d", "function", "zzz qqq", "p", "python", "c"), ("e", "function", "x", "p", "python", "c")], S)
    code = spark.createDataFrame([("c", "class A:\n    alpha beta gamma delta epsilon zeta"), ("d", "def d():\n    alpha beta gamma delta epsilon zeta eta"), ("e", "def e(): 1")], "id string, code string")
    got = {r.symbol_id: r for r in A.audit(s, A.scores(s, code)).collect()}
    assert set(got) == {"a", "c", "d", "e"} and got["a"].warnings == ["Missing docstring"] and got["c"].warnings == [] and got["c"].semantic_score > 0.3
    assert got["d"].warnings[0].startswith("Low semantic similarity (score=") and got["e"].skip_reason == "code_body_too_short (len=10 < min_code=30)"


def test_guidance(spark):
    s = spark.createDataFrame([("f", "fn", "a.py", 1, 2, ["t", "lost"], [], ["x > 1"], "c"), ("t", "tt", "t.py", 1, 2, [], ["fn"], None, "c"), ("g", "gg", "a.py", 5, 6, None, None, ["y"], "c")], "id string, name string, file_path string, start_line int, end_line int, covered_by array<string>, calls array<string>, invariants array<string>, commit_hash string")
    assert {(r.symbol_id, r.test_id, r.strength) for r in U.constraining_tests(s).collect()} == {("f", "t", "strong"), ("f", "lost", "moderate")}
    assert {r.symbol_id: (r.risk, len(r.warnings)) for r in U.untested(s).collect()} == {"f": ("low", 0), "t": ("high", 1), "g": ("high", 2)}
    c = {r.symbol_id: r.context for r in U.agent_context(s).collect()}
    assert c["f"].impact_count == 1 and c["f"].nearest == ["g"] and len(c["f"].constraining_tests) == 2 and c["t"].impact_count == 0


def test_chunks(spark):
    text = "import json\ndef f(a) -> int:\n    x = json.dumps(a)\n" + "    y = 1\n" * 60
    f = spark.createDataFrame([("m.py", "python", text)], "path string, language string, content string")
    s = spark.createDataFrame([("s1", "f", "function", "m.f", "m.py", 2, 63, "def f(a) -> int", "python", "r", "c"), ("s2", "g", "function", None, "m.py", 2, 3, None, "python", "r", "c")], "id string, name string, kind string, fqname string, file_path string, start_line int, end_line int, signature string, language string, repo_id string, commit_hash string")
    rows = C.build(f, s, 400).orderBy("symbol_id", "chunk_part_index").collect()
    mine = [r for r in rows if r.symbol_id == "s1"]
    assert len(mine) > 1 and all(len(r.text.encode()) <= 400 for r in mine) and [r.chunk_part_index for r in mine] == list(range(1, len(mine) + 1))
    assert mine[0].start_line == 2 and mine[-1].end_line == 63 and all(a.end_line + 1 == b.start_line for a, b in zip(mine, mine[1:]))
    assert mine[0].text.startswith("FQNAME: m.f\nKIND: function\nFILE: m.py\nLINES: 2-63\n\nSIGNATURE:\nRAW: def f(a) -> int\nPARAMS: a\nRETURNS: int\nMODIFIERS: <none>\n\nIMPORTS_IN_SCOPE:\nimport json\n\nBODY:\n\ndef f(a)")
    assert mine[0].start_byte == 12 and text.encode()[mine[0].start_byte : mine[0].end_byte].decode().startswith("def f(a)")
    assert [r.text.split("\n")[0] for r in rows if r.symbol_id == "s2"] == ["FQNAME: g"] and len({r.chunk_id for r in rows}) == len(rows)
    assert C.span_violations(s, C.build(f, s, 400)).count() == 0
    assert C.pack_lines(["a" * 50, "b", "c"], 1, 0, 20) == [(1, 1, "a" * 50), (2, 3, "b\nc")]


def test_line_packing_equals_the_plain_fold():
    import random

    def plain(rows, start, fixed, most):
        out, cur, first = [], [], start
        for i, r in enumerate(rows):
            if cur and len("\n".join([*cur, r]).strip().encode()) + fixed > most:
                out.append((first, start + i - 1, "\n".join(cur).strip()))
                cur, first = [], start + i
            cur.append(r)
        return [*out, (first, start + len(rows) - 1, "\n".join(cur).strip())]

    r = random.Random(3)
    for _ in range(300):
        rows = [r.choice(["", "  ", "x" * r.randrange(30), " é" * r.randrange(9), "\ty "]) for _ in range(r.randrange(1, 25))]
        most = r.randrange(5, 90)
        assert C.pack_lines(rows, 7, 3, most) == plain(rows, 7, 3, most)


def test_audit_scores_whole_code(spark):
    ddl = "symbol_id string, chunk_id string, chunk_part_index int, text string"
    long = "x" * 5000
    rows = [("s", "2", 2, "h\nBODY:\na = 2"), ("s", "1", 1, "h\nBODY:\nz = 1"), ("s", "1", 1, "h\nBODY:\nz = 1"), ("s", "10", 10, f"h\nBODY:\n{long} end"), (None, "3", 1, "no")]
    code = A.whole_code(spark.createDataFrame(rows, ddl))
    assert [tuple(r) for r in code.collect()] == [("s", f"h\nBODY:\nz = 1\na = 2\n{long} end")]
    s = spark.createDataFrame([("s", "some documentation", "go", "c")], "id string, docstring string, language string, commit_hash string")
    whole, cut = (A.scores(s, code, max_code=m).first().semantic_score for m in (None, 4000))
    assert whole != cut


def test_a_crash_between_any_two_steps_leaves_a_whole_build(spark, tmp_path):
    """Every change to the file system is a step; whatever fails, readers see the rows of the former build or those of the new one."""
    one, two = (spark.createDataFrame([(f"p{i}", "python", h, None) for i in range(6)], R.SCHEMAS["files"]) for h in ("one", "two"))
    step, failed = 0, True
    while failed:
        root = str(tmp_path / f"s{step}")
        store = R.Store(spark, root, buckets=2, keep=1)
        store.publish(store.stage({"files": one}, "one"))
        fs, count = store._fs, [0]

        class Failing:
            def __getattr__(self, name):
                f = getattr(fs, name)
                if name not in ("create", "rename", "delete", "mkdirs"):
                    return f

                def run(*a):
                    count[0] += 1
                    if count[0] == step + 1:
                        raise RuntimeError("crash")
                    return f(*a)

                return run

        store._fs, failed = Failing(), False
        try:
            store.publish(store.stage({"files": two}, "two"))
        except RuntimeError:
            failed = True
        again = R.Store(spark, root)
        got = {r.content_hash for r in again.read("files").collect()}
        assert got in ({"one"}, {"two"}) and again.read("files").count() == 6, step
        if not failed:
            assert got == {"two"}
        step += 1
    assert step > 5


def test_old_builds_stay_for_their_readers(spark, tmp_path):
    store = R.Store(spark, str(tmp_path / "s"), buckets=4, keep=2)
    make = lambda h: spark.createDataFrame([(f"p{i}", "python", h, None) for i in range(20)], R.SCHEMAS["files"])
    store.publish(store.stage({"files": make("0")}, "b0"))
    reader = store.read("files")
    store.publish(store.stage_changes({"files": make("1").filter("path = 'p3'")}, make("1").filter("path = 'p3'"), ["files"], "b1"))
    assert {r.content_hash for r in reader.collect()} == {"0"} and store.read("files").filter("content_hash = '1'").count() == 1
    for k in range(2, 5):
        store.publish(store.stage_changes({"files": make(str(k)).filter("path = 'p3'")}, make("1").filter("path = 'p3'"), ["files"], f"b{k}"))
    assert store.read("files").count() == 20 and {r.content_hash for r in store.read("files").filter("path = 'p3'").collect()} == {"4"}
    assert "b0" in store._names("builds") and "b1" not in store._names("builds")  # most buckets are still those of the first build
    store.publish(store.stage({"files": make("9")}, "whole"))
    store.publish(store.stage({"files": make("8")}, "more"))
    assert store._names("builds") == ["more", "whole"]


def test_one_writer_at_a_time(spark, tmp_path):
    import pytest

    store = R.Store(spark, str(tmp_path / "s"))
    with store.writer():
        with pytest.raises(TimeoutError), store.writer(total_ms=100):
            pass
        with store.writer(total_ms=100, stale_ms=-1):
            pass
    with store.writer():
        pass
