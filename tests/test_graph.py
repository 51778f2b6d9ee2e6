from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators.relations import SCHEMAS

EDGES = SCHEMAS["edges"]
SYM = "id string, name string, kind string, fqname string, file_path string, start_line int, end_line int, container_id string, container_fqname string, calls array<string>, covered_by array<string>, repo_id string, commit_hash string, language string, line string"


def edge(i, frm, to, path, conf, commit, line=1, kind="CALLS", vec=None):
    return (i, kind, frm, to, "function", "function", path, line, conf, "r", commit, None, vec)


def symbol(i, name, path, start, end, fq=None, box=None, box_fq=None, calls=(), tests=()):
    return (i, name, "function", fq or f"m.{name}", path, start, end, box, box_fq, list(calls), list(tests), "r", "c", "python", "x")


def test_neighbor_order(spark):
    e = spark.createDataFrame([edge("a", "sym-anchor", "x", "/repo/src/a.py", 0.80, "aaa111"), edge("b", "y", "sym-anchor", "/repo/tests/test_main.py", 0.95, "bbb222"), edge("c", "sym-anchor", "z", "/repo/src/utils/helpers.py", 0.70, "bbb222"), edge("q", "m", "n", "/repo", 1.0, None)], EDGES)
    anchors = spark.createDataFrame([("sym-anchor", "/repo/src/main.py")], "symbol_id string, anchor_path string")
    got = G.neighbors(e, anchors, 10).orderBy("rank").collect()
    assert [r.edge_id for r in got] == ["b", "a", "c"] and [r.commit_penalty for r in got] == [0, 1, 0] and [r.module_distance for r in got] == [2, 0, 1]
    assert [r.edge_id for r in G.neighbors(e, anchors, 1, "outgoing").collect()] == ["a"]
    assert [r.edge_id for r in G.neighbors(e, anchors, 9, "incoming").collect()] == ["b"]
    assert G.as_payload(G.neighbors(e, anchors, 9)).select("ranking.endpoint_match").count() == 3
    assert G.latest_commit(e).first().latest_commit == "bbb222"
    assert G.neighbors(e.limit(0), anchors, 3).count() == 0


def test_self_edge_counts_twice(spark):
    e = spark.createDataFrame([edge("s", "x", "x", "p", 0.1, "c"), edge("t", "x", "y", "p", 0.9, "c")], EDGES)
    got = G.neighbors(e, spark.createDataFrame([("x", None)], "symbol_id string, anchor_path string"), 5).orderBy("rank").collect()
    assert [(r.edge_id, r.endpoint_match) for r in got] == [("s", 2), ("t", 1)]


def test_edge_vectors(spark):
    e = spark.createDataFrame([edge("a", "f", "t", "p", 0.8, "c", vec=[1.0, 0.0]), edge("b", "f", "t", "p", 0.9, "c", vec=[0.0, 1.0]), edge("c", "f", "t", "p", 0.9, "c"), edge("d", "f", "t", "p", 0.9, "c", vec=[1.0])], EDGES)
    assert [(r.edge_id, r.similarity) for r in G.search_edges(e, [1.0, 0.0], 5).collect()] == [("a", 1.0), ("b", 0.0)]


def test_extraction(spark):
    files = spark.createDataFrame([("m.py", "python", "import math\nfrom a import (b, c as d)\ndef target():\n    helper()\n    unknown_api()\ndef helper():\n    pass\n", "x")], "path string, language string, content string, line string")
    s = spark.createDataFrame([symbol("sym-target", "target", "m.py", 3, 5, calls=["helper", "unknown_api", " "], tests=["sym-test-target", "t.lost"]), symbol("sym-helper", "helper", "m.py", 6, 7, box="sym-target"), symbol("sym-test-target", "test_target", "t.py", 1, 2)], SYM)
    rows = G.extract(files, s).collect()
    got = {(r.edge_type, r.from_id, r.to_id): r for r in rows}
    node = next(r.from_id for r in rows if r.edge_type == "DEFINES" and r.to_id == "sym-target")
    assert node.startswith("file:") and ("CONTAINS", "sym-target", "sym-helper") in got
    assert got["CALLS", "sym-target", "sym-helper"].confidence == 0.85 and got["CALLS", "sym-target", "unresolved:unknown_api"].confidence == 0.15
    assert got["TESTS", "sym-test-target", "sym-target"].confidence == 0.95 and got["TESTS", "unresolved:t.lost", "sym-target"].confidence == 0.25
    assert {(r.to_id, r.line) for r in rows if r.edge_type == "IMPORTS"} == {("unresolved:math", 1), ("unresolved:a.b", 2), ("unresolved:a.c", 2)}
    assert got["REFERENCES", "sym-target", "sym-helper"].confidence == 0.45 and ("CALLS", "sym-target", "unresolved:<empty>") in got
    assert len({r.edge_id for r in rows}) == len(rows) and got["CALLS", "sym-target", "sym-helper"].text.endswith("CONFIDENCE: 0.850")
    shuffled = G.extract(files, s.orderBy(F.rand(3)).repartition(3)).collect()
    assert {tuple(r) for r in shuffled} == {tuple(r) for r in rows}


def test_resolution_tiers(spark):
    s = spark.createDataFrame([symbol("1", "f", "a.py", 1, 2, "a.f"), symbol("2", "f", "b.py", 1, 2, "b.f"), symbol("3", "g", "b.py", 5, 6, "B.g"), symbol("4", "x", "c.py", 1, 1, "dup"), symbol("5", "y", "c.py", 2, 2, "dup")], SYM)
    refs = spark.createDataFrame([("a.f", "z.py", None), ("g", "z.py", "B"), ("g", "z.py", None), ("g", "b.py", None), ("f", "b.py", None), ("f", "z.py", None), ("q.h", "z.py", None), ("dup", "z.py", None)], "target string, file string, container_fqname string")
    got = {(r.target, r.file, r.container_fqname): (r.to_id, r.confidence) for r in G.resolve(refs, G.catalog(s)).collect()}
    assert got == {("a.f", "z.py", None): ("1", 0.95), ("g", "z.py", "B"): ("3", 0.9), ("g", "z.py", None): ("3", 0.75), ("g", "b.py", None): ("3", 0.85), ("f", "b.py", None): ("2", 0.65), ("f", "z.py", None): ("1", 0.45), ("q.h", "z.py", None): ("unresolved:q.h", 0.15), ("dup", "z.py", None): ("5", 0.95)}


def test_go_import_blocks(spark):
    f = spark.createDataFrame([("a.go", "go", 'import (\n  "x/y"\n  z "q"\n)\nimport "k"\n"no"'), ("b.ts", "typescript", "import {a} from './m'\nimport 's'"), ("c.rs", "rust", "use a::b;"), ("d.java", "java", "import a.b.C;")], "path string, language string, content string")
    assert {(r.path, r.line, r.target) for r in G.import_targets(f).collect()} == {("a.go", 2, "x/y"), ("a.go", 3, "q"), ("a.go", 5, "k"), ("b.ts", 1, "./m"), ("b.ts", 2, "s"), ("c.rs", 1, "a::b"), ("d.java", 1, "a.b.C")}
