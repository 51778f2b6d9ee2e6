import pytest

from tessera.llm import documented as D

SYM = "id string, name string, kind string, language string, signature string, docstring string, file_path string, start_line int, path string, line int"
SRC = "path string, language string, content string, kind string"
GOOD = "Loads every record quickly from disk"

PY = '''# Loads every record quickly from disk
def above(x):
    return "# no"

@cached(
    1)
@other
def deco(a,
         b="):"):
    r"""Loads every record quickly from disk
    @param a: nothing
    :return: nothing"""
    def inner():
        \'\'\'TODO loads every record quickly from disk\'\'\'
    return 1

def blankdoc():

    "Loads every record quickly from disk"

# far comment loads every record quickly

def far(): pass
x = """
def fake():
    \\"\\"\\"Loads every record quickly from disk\\"\\"\\"
"""
'''
JS = '''/**
 * Loads every record quickly from disk
 * @returns x
 */
function blk(a) { return "}"; }
// Loads every
// record quickly from disk
@Deco()
run(a) {
  if (`${"}"}`) { }
}
const s = "// Loads every record quickly";
function none() {}
x(); // Loads every record quickly from disk
function trailing() {}
'''
RS = '/* a /* nested */ Loads every record quickly from disk */\nfn nest<\'a>(x: &\'a str) -> char { \'{\' }\n/// Loads every record\n/// quickly from disk\n#[inline]\npub fn attr() { let s = r#"}"#; }\n'


def sym(i, name, path, line, doc=None, kind="function"):
    return (i, name, kind, "x", f"sig {name}", doc, path, line, "p", 0)


def run(spark, symbols, sources):
    return {r.id: r for r in D.pairs(spark.createDataFrame(symbols, SYM), spark.createDataFrame(sources, SRC)).collect()}


def test_python(spark):
    s = [sym("above", "above", "a.py", 2), sym("deco", "deco", "a.py", 5), sym("inner", "inner", "a.py", 13), sym("blankdoc", "blankdoc", "a.py", 17), sym("far", "far", "a.py", 23), sym("fake", "fake", "a.py", 25)]
    got = run(spark, s, [("a.py", "python", PY, "k"), ("a.py", "python", PY, "k"), ("b.py", "python", "", "k"), (None, "python", PY, "k"), ("c.py", None, None, "k")])
    assert set(got) == {"above", "deco"}
    assert got["deco"].description == GOOD and got["deco"].code.startswith("@cached(") and got["deco"].code.rstrip().endswith("return 1")
    assert got["above"].description == GOOD and got["above"].signature == "sig above"


def test_braces(spark):
    s = [sym("blk", "blk", "a.js", 5), sym("run", "run", "a.js", 8, kind=" METHOD "), sym("none", "none", "a.js", 13), sym("trailing", "trailing", "a.js", 15), sym("nest", "nest", "r.rs", 2), sym("attr", "attr", "r.rs", 5)]
    got = run(spark, s, [("a.js", "javascript", JS, "k"), ("r.rs", "rust", RS, "k")])
    assert set(got) == {"blk", "run", "nest", "attr"}
    assert got["blk"].code == 'function blk(a) { return "}"; }' and got["run"].code.endswith('{ }\n}') and got["attr"].code.startswith("#[inline]") and got["attr"].code.endswith("}")


def test_table_documentation_comes_first(spark):
    s = [sym("a", "f", "a.py", 2, "    /** Loads every record quickly from disk */"), sym("b", "f", "z", 1, "  "), sym("c", "f", "z", 1, "todo loads every record quickly from disk"), sym("d", "f", "z", 1, None), sym("e", "f", "z", 1, GOOD, "class"), (None, "f", "function", "", "", GOOD, "z", 1, "p", 0), sym("a", "f", "a.py", 2, "    /** Loads every record quickly from disk */"), sym("g", "f", "z", 1, GOOD, None)]
    got = run(spark, s, [("a.py", "python", PY, "k")])
    assert set(got) == {"a"} and got["a"].description == GOOD


@pytest.mark.parametrize("doc,name,ok", [
    ("one two three four five", "x", True), ("one two three four", "x", False), ("loads every record from disk now", "loadEveryRecord", False), ("Loads every record from disk fast now today", "loads_every", True),
    ("@param one two three four five", "x", False), (": one two three four five", "x", False), ('u"""one two three four five"""', "x", True), ("fixme: one two three four five six", "x", False), ("# one two\n# three four\n# five", "x", True), ("été лес дом мир сад ёлка", "x", True), ("a b c d e f g", "x", False), ("", "x", False), ("///\n/// xxx one two three four five", "x", False),
    ("HTTPServer one two three four", "HTTPServer", True), ("http server one two three four", "HTTPServer", False),
])
def test_trivial(doc, name, ok):
    assert D.says_something(D.description(doc), name) is ok


def test_names():
    assert D.name_words("parseHTTPFile_v2X") == {"parse", "http", "file", "v", "x"}


def test_unclosed_and_long_files(spark):
    long = "// x\n" * 20_000 + "// Loads every record quickly from disk\nfunc f() {\n" + "a()\n" * 20_000
    got = run(spark, [sym("f", "f", "l.go", 20_002), sym("g", "g", "u.js", 2)], [("l.go", "go", long, "k"), ("u.js", "javascript", "/* open", "k"), ("v.py", "python", "def f(:\n  '''", "k"), ("w.py", "python", "def f(", "k")])
    assert set(got) == {"f"}


def test_empty(spark):
    assert D.pairs(spark.createDataFrame([], SYM), spark.createDataFrame([], SRC)).count() == 0


def test_code_without_a_comment_above(spark):
    text = "class A {\n  @Override\n  public int f(int x) {\n    return x;\n  }\n\n  int g() { return 1; }\n}\n"
    doc = "Gives back whatever number the caller passed along here."
    S = "id string, name string, kind string, language string, signature string, docstring string, file_path string, start_line int"
    symbols = [("s", "f", "method", "java", "f", doc, "a.java", 2), ("t", "g", "method", "java", "g", doc, "a.java", 7), ("u", "h", "method", "java", "h", doc, "none.java", 1)]
    got = {r.id: r.code for r in D.pairs(spark.createDataFrame(symbols, S), spark.createDataFrame([("a.java", "java", text)], "path string, language string, content string")).collect()}
    assert got == {"s": "  @Override\n  public int f(int x) {\n    return x;\n  }", "t": "  int g() { return 1; }", "u": None}


def test_functions_of_source_files(spark):
    files = [
        ("a.go", "go", "// Opens the gate slowly\nfunc (r *T) Open(x int) error {\n\ts := \"func no() {\"\n\treturn nil\n}\n"),
        ("b.ts", "typescript", "class A {\n  /** Counts all rows of a table */\n  @log()\n  count(a: number): number {\n    if (a) { return 1; }\n    call(a);\n  }\n}\nexport const go = (x) => {\n  return x;\n};\n"),
        ("C.java", "java", "class C {\n  @Override\n  public List<String> names(int a) throws E {\n    for (int i : x) { y(); }\n    return new B(a) {};\n  }\n}\n"),
        ("d.rs", "rust", "/// Says where it went\n#[inline]\npub(crate) async fn go_on<'a>(x: &'a str) -> u8 {\n  1\n}\n"),
        ("e.py", "python", "@deco\ndef f(\n  a,\n):\n    'Reads the rows'\n    return 1\n"),
        ("f.js", "javascript", None), (None, "go", "func x() {}"), ("g.js", "javascript", ""),
    ]
    rows = spark.createDataFrame([(*f, 1) for f in files] + [(*files[0], 2)], "path string, language string, content string, name int")
    got = {(r.path, r.name): (r.start_line, r.end_line, r.doc, r.code) for r in D.source_functions(rows).collect()}
    assert {k: v[:2] for k, v in got.items()} == {("a.go", "Open"): (2, 5), ("b.ts", "count"): (3, 7), ("b.ts", "go"): (9, 11), ("C.java", "names"): (2, 6), ("d.rs", "go_on"): (2, 5), ("e.py", "f"): (1, 6)}
    assert got["a.go", "Open"][2] == "// Opens the gate slowly" and got["b.ts", "count"][2].startswith("/** Counts") and got["d.rs", "go_on"][2].startswith("/// Says") and got["e.py", "f"][2] == "'Reads the rows'"
    assert all(v[3] for v in got.values()) and D.source_pairs(rows).filter("code IS NULL").count() == 0
