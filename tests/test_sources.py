import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions import sql_register
from tessera.sources import coverage_files, parse, scan, settings, sinks


@pytest.fixture
def tree(tmp_path):
    for p, b in {
        "src/a.py": b"x = 1\n", "src/b.min.js": b"1", "src/c.js": b"let a\n", "node_modules/d.js": b"1", "env/pyvenv.cfg": b"home", "env/lib/python3/site-packages/m.py": b"1", "alt/bin/python3": b"elf", "alt/lib/python3.9/site-packages/k.py": b"1",
        "src/bin.py": b"a\x00b", "src/bad.py": b"\xff\xfe", "notes.txt": b"t", "src/.hidden.py": b"1",
    }.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b)
    return tmp_path


def test_scan(spark, tree):
    rows = {r.path.removeprefix(f"{tree}/"): r for r in scan.source_files(spark, str(tree)).collect()}
    assert set(rows) == {"src/a.py", "src/c.js"} and rows["src/a.py"].language == "python" and rows["src/a.py"].content == "x = 1\n"
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in scan.rejected_files(spark, str(tree)).collect()} == {"bin.py": "binary", "bad.py": "not_utf8"}
    m = scan.manifest(spark, str(tree / "src"))
    assert "a.py" in {r.path for r in m.collect()}
    other = m.filter("path <> 'c.js'").withColumn("sha256", F.when(F.col("path") == "a.py", "0").otherwise(F.col("sha256"))).unionByName(spark.createDataFrame([("n", 1, "2")], "path string, bytes bigint, sha256 string"))
    assert {r.path: r.problem for r in scan.manifest_check(m, other).collect()} == {"a.py": "changed", "c.js": "missing", "n": "unexpected"}


def test_coverage_files(spark, tmp_path):
    db = tmp_path / "c.sqlite"
    con = sqlite3.connect(db)
    con.executescript("CREATE TABLE context(id, context); CREATE TABLE file(id, path); CREATE TABLE line_bits(file_id, context_id, numbits); INSERT INTO context VALUES (1, 't::a|run'), (2, ''); INSERT INTO file VALUES (1, 'm.py');")
    con.execute("INSERT INTO line_bits VALUES (1, 1, ?), (1, 2, ?)", (bytes([0b10, 0b1]), bytes([2])))
    con.commit()
    con.close()
    assert {tuple(r) for r in coverage_files.importer("coverage-sqlite")(spark, str(db)).collect()} == {("t::a", "m.py", 1), ("t::a", "m.py", 8)}
    (tmp_path / "c.json").write_text('{"t": {"m.py": [1, 2]},\n "u": {}}')
    assert {tuple(r) for r in coverage_files.importer("coverage-json")(spark, str(tmp_path / "c.json")).collect()} == {("t", "m.py", 1), ("t", "m.py", 2)}
    (tmp_path / "bad.json").write_text('{"t": [1]}')
    with pytest.raises(Exception):
        coverage_files.json_contexts(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(KeyError):
        coverage_files.importer("none")


def test_settings(tmp_path):
    (tmp_path / "s.toml").write_text("top_k = 900\nmax_files = '3'\nother = 1\n")
    s = settings.load_settings(str(tmp_path / "s.toml"), {"TESSERA_HIDDEN": "yes", "TESSERA_MAX_FILES": "4"}, max_chars=1, top_k=None)
    assert (s.top_k, s.max_files, s.hidden, s.max_chars) == (250, 4, True, 200)
    with pytest.raises(ValueError, match="top_k"):
        settings.load_settings(None, {}, top_k="many")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    sinks.json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and sorted(sinks.stream_json(df)) == ['{"k":"a","v":1}', '{"k":"b","v":null}']
    sinks.log_searches(spark.createDataFrame([("q", "exact")], "query_id string, strategy string"), spark.createDataFrame([("q", "secret words")], "query_id string, query string"), str(tmp_path / "log"))
    assert "secret" not in "".join(p.read_text() for p in (tmp_path / "log").glob("*.json"))
    sinks.write_by_file(df, str(tmp_path / "b"), "k", 4)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
    a, b = tmp_path / "a.tgz", tmp_path / "b.tgz"
    assert sinks.archive({"x/y": b"1", "z": b"2"}, str(a)) == sinks.archive({"z": b"2", "x/y": b"1"}, str(b)) and a.read_bytes() == b.read_bytes()
    assert sinks.check_archive(str(a)) == [] and sinks.restore_archive(str(a), str(tmp_path / "out")) == ["manifest.json", "x/y", "z"]
    with pytest.raises(FileExistsError):
        sinks.restore_archive(str(a), str(tmp_path / "out"))


PY = '''import json
@pytest.fixture
def data():
    """Doc."""
    return json.dumps({})
class Store:
    async def _load(self, x):
        assert x > 0, "m"
        return self.fetch(x)
def test_load_twice():
    pass
'''


def test_python_symbols(spark):
    f = spark.createDataFrame([("p/m.py", "python", PY), ("bad.py", "python", "def ("), ("e.py", "python", "")], "path string, language string, content string")
    df = parse.symbols(f, "r")
    rows = {r.name: r for r in df.collect()}
    assert set(rows) == {"data", "Store", "_load", "test_load_twice"}
    assert (rows["data"].kind, rows["data"].start_line, rows["data"].docstring, rows["data"].is_serialization_boundary) == ("fixture", 2, "Doc.", True)
    assert (rows["_load"].fqname, rows["_load"].container_id, rows["_load"].visibility, rows["_load"].calls, rows["_load"].invariants) == ("m.Store._load", rows["Store"].id, "private", ["self.fetch"], ["x > 0, 'm'"])
    assert rows["test_load_twice"].implicit_contract == "load twice"
    same = parse.project_signals(df.drop("invariants", "calls", "is_serialization_boundary", "implicit_contract"))
    assert {r.name: (sorted(r.calls), r.is_serialization_boundary) for r in same.collect()} == {n: (sorted(r.calls), r.is_serialization_boundary) for n, r in rows.items()}


@pytest.mark.parametrize("language,text,want", [
    ("typescript", "// doc\nexport class A {\n  private go(x: number): void {\n    run(x); // }\n  }\n}\nexport const f = (a) => {\n}\ninterface I { }\n", {("A", "class", 2, 6), ("go", "method", 3, 5), ("f", "function", 7, 8), ("I", "interface", 9, 9)}),
    ("go", "package m\nfunc (s *S) Do(a int) error {\n\treturn x(\"}\")\n}\ntype S struct {\n}\nfunc free() {}\n", {("Do", "method", 2, 4), ("S", "type", 5, 6), ("free", "function", 7, 7)}),
    ("rust", "pub struct P {\n}\nimpl P {\n    #[inline]\n    pub fn go(&self) {\n        let c = '{';\n    }\n}\nfn free() {\n}\n", {("P", "type", 1, 2), ("P", "class", 3, 8), ("go", "method", 4, 7), ("free", "function", 9, 10)}),
    ("java", "class K {\n  /** d */\n  @Override\n  public int go(int a) {\n    if (a > 0) {\n    }\n    return 1;\n  }\n}\n", {("K", "class", 1, 9), ("go", "method", 3, 8)}),
    ("cpp", "class W : B {\n};\nint W::run(int a) {\n  return a;\n}\n", {("W", "class", 1, 2), ("run", "function", 3, 5)}),
])
def test_brace_symbols(language, text, want):
    rows = parse.parse_text("d/x", language, text, "r")
    assert {(r["name"], r["kind"], r["start_line"], r["end_line"]) for r in rows} == want


def test_sql_functions(spark):
    sql_register.register(spark)
    assert spark.sql("SELECT l2_distance(array(1F, 0F), array(0F, 0F)) AS d, distance_score(1D) AS s, token_estimate(' a b ') AS t, path_class('a/tests/x') AS p, warning_type('A (b)') AS w").first().asDict() == {"d": 1.0, "s": 0.5, "t": 2, "p": "tests", "w": "A"}
    spark.createDataFrame([("m.py", "python", PY)], "path string, language string, content string").createOrReplaceTempView("some_files")
    assert spark.sql("SELECT f.path, s.name FROM some_files f, LATERAL parse_symbols(f.path, f.language, f.content) s").count() == 4
    e = sql_register.embed(spark.createDataFrame([("a",), ("a",), (None,)], "text string"))
    assert e.filter("vector IS NOT NULL").count() == 2 and e.count() == 3
    with pytest.raises(KeyError):
        sql_register.provider("absent")
    assert parse.languages(spark).filter("language = 'rust' AND imports").count() == 1


def test_bound_functions():
    text = "const api = {\n  load: function (a) { go(a); },\n  save(x) {\n    put(x)\n  },\n  n: 1,\n  run: async () => { z() },\n};\nconst p = api;\nObject.defineProperty(p, 'size', {\n  get: function () { return 1; }\n});\n// Object.defineProperty(p, 'no', { get() {} })\n"
    rows = {r["fqname"]: r for r in parse.parse_text("d/x.js", "javascript", text, "r")}
    assert {k: (r["kind"], r["start_line"]) for k, r in rows.items()} == {"api.load": ("method", 2), "api.save": ("method", 3), "api.run": ("method", 7), "api.size": ("method", 10)}
    assert rows["api.load"]["calls"] == ["go"]


def test_macro_symbols():
    text = "#define MAKE(T) class T { \\\n };\n#define METHOD(O, F) int O::F(int a) { return a; }\nMAKE(Widget)\nMETHOD(Widget, run)\nclass Known {\n};\nMAKE(Known)\nMAKE(1x)\n"
    rows = parse.parse_text("d/x.cpp", "cpp", text, "r")
    assert {(r["kind"], r["fqname"].split("x.")[-1]) for r in rows if r["name"] in ("Widget", "run")} == {("class", "Widget"), ("method", "Widget.run")}
    assert len([r for r in rows if r["name"] == "Known"]) == 1


def test_archive_of_files_on_disk(tmp_path):
    from tessera.sources import sinks

    (tmp_path / "big").write_bytes(b"x" * 3_000_000)
    a, b = tmp_path / "a.tgz", tmp_path / "b.tgz"
    assert sinks.archive({"big": tmp_path / "big", "s": b"1"}, str(a)) == sinks.archive({"s": b"1", "big": b"x" * 3_000_000}, str(b)) and sinks.check_archive(str(a)) == []
    sinks.restore_archive(str(a), str(tmp_path / "out"))
    assert (tmp_path / "out/big").read_bytes() == b"x" * 3_000_000


def test_factories_by_name():
    import pytest

    from tessera.sources import plugins

    r = plugins.Registry("tessera.none", {"a": dict}, {"x": "a"})
    assert r.resolve("x") is dict and r.available() == [("a", "builtin")]
    assert r.resolve("whatever", "collections:OrderedDict").__name__ == "OrderedDict"
    with pytest.raises(LookupError):
        r.resolve("b")
    with pytest.raises(LookupError):
        r.resolve("b", "collections:nothing")
    assert plugins.stores().resolve("parquet").__name__ == "Store" and plugins.hosts().resolve("default").__name__ == "serve"


def test_vectors_from_a_matrix_file(spark, tmp_path):
    import json

    import numpy as np
    import pytest

    from tessera.sources.vector_files import load_vectors

    x = np.arange(40, dtype=np.float32).reshape(10, 4)
    np.save(tmp_path / "v.npy", x)
    (tmp_path / "ids.json").write_text(json.dumps({"schema_version": 2, "ids": {f"c{i}": i for i in range(12)}}))
    got = {r.id: list(r.vector) for r in load_vectors(spark, str(tmp_path / "v.npy"), str(tmp_path / "ids.json"), step=4).collect()}
    assert got == {f"c{i}": x[i].tolist() for i in range(10)}
    (tmp_path / "ids.json").write_text(json.dumps({"order": ["a", "b"]}))
    assert {r.id: r.position for r in load_vectors(spark, str(tmp_path / "v.npy"), str(tmp_path / "ids.json")).collect()} == {"a": 0, "b": 1}
    assert load_vectors(spark, str(tmp_path / "none.npy"), str(tmp_path / "ids.json")).count() == 0
    (tmp_path / "ids.json").write_text(json.dumps({"schema_version": 1}))
    with pytest.raises(ValueError):
        load_vectors(spark, str(tmp_path / "v.npy"), str(tmp_path / "ids.json"))


def test_python_with_an_error_is_scanned():
    from tessera.sources.parse import parse_python, scan_python

    good = "@d\nclass A:\n    \"\"\"Doc of A (\n    def no(): pass\n    \"\"\"\n    async def f(\n        self,\n    ):\n        'Says x'\n        return g.h(1)\n\n    x = 1\n\ndef z():  # def y():\n    assert a > 1\n"
    keep = ("name", "kind", "fqname", "start_line", "end_line", "docstring", "calls", "invariants")
    assert [{k: r[k] for k in keep} for r in scan_python("m.py", good, "r")] == [{k: r[k] for k in keep} for r in parse_python("m.py", good, "r")]
    bad = good + "\ndef w(:\n    return ((\n"
    assert [r["name"] for r in parse_python("m.py", bad, "r")] == ["A", "f", "z", "w"] and scan_python("m.py", "", "r") == []
