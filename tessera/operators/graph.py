"""Edges: resolving names to symbols, extraction of the six kinds, ranked neighbours and search over edge facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions.text import edge_id, edge_text, file_node_id, lines, reference_tokens, split_lines
from tessera.functions.vectors import l2, score
from tessera.runtime import Scratch, one_per_id

# Confidence by tier of resolution.
FQNAME, IN_CONTAINER, ONLY_HERE, ONLY_ELSE, MANY_HERE, MANY_ELSE, UNRESOLVED = 0.95, 0.9, 0.85, 0.75, 0.65, 0.45, 0.15
IMPORT_LEAST, REFERENCE_MOST, TEST_ID, TEST_FQNAME, TEST_LEAST, TEST_UNRESOLVED = 0.2, 0.45, 0.95, 0.9, 0.6, 0.25
# Import lines by language, the target in the first group.
IMPORTS = {
    "javascript": [r"^\s*import\s+.+\s+from\s+['\"]([^'\"]+)['\"]", r"^\s*import\s+['\"]([^'\"]+)['\"]"],
    "rust": [r"^\s*use\s+([^;]+);"],
    "java": [r"^\s*import\s+([A-Za-z0-9_\.\\*]+)\s*;"],
    "go": [r"^\s*import\s+\"([^\"]+)\""],
}
PY_FROM, PY_IMPORT = r"^\s*from\s+([A-Za-z0-9_\.]+)\s+import\s+(.+)$", r"^\s*import\s+(.+)$"
GO_OPEN, GO_ENTRY = r"^\s*import\s*\(\s*$", r"^\s*(?:[A-Za-z_][A-Za-z0-9_]*\s+)?\"([^\"]+)\""
SYMBOL = ["id", "name", "kind", "fqname", "file_path", "start_line", "end_line"]


def catalog(symbols: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """One row per id; rows of the overlay win."""
    cols = [F.col(c) for c in SYMBOL]
    rows = symbols.select(*cols, F.lit(0).alias("prio"))
    if overlay is not None:
        rows = rows.unionByName(overlay.select(*cols, F.lit(1).alias("prio")))
    return rows.filter("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("prio", *SYMBOL[1:])).alias("r")).select("id", *(f"r.{c}" for c in SYMBOL[1:]))


def _winners(cat: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lookups with one row per key, so that joins stay one to one: by fqname (last), by name and file (first), by name (first, with how many)."""
    by_fq = cat.filter("fqname <> ''").groupBy(F.col("fqname").alias("key")).agg(F.max(F.struct("file_path", "start_line", "end_line", "id", "kind")).alias("r")).select("key", F.col("r.id").alias("to"), F.col("r.kind").alias("to_kind"))
    first = F.min(F.struct("file_path", "start_line", "id", "kind")).alias("r")
    here = cat.groupBy(F.col("name").alias("key"), F.col("file_path").alias("file")).agg(first).select("key", "file", F.col("r.id").alias("to"), F.col("r.kind").alias("to_kind"))
    named = cat.groupBy(F.col("name").alias("key")).agg(first, F.count("*").alias("n")).select("key", "n", F.col("r.id").alias("to"), F.col("r.kind").alias("to_kind"), F.col("r.file_path").alias("file"))
    return by_fq, here, named


def resolve(refs: DataFrame, cat: DataFrame, unresolved: float = UNRESOLVED) -> DataFrame:
    """Adds to_id, to_kind and confidence to refs (target, file, container_fqname, ...).

    Targets repeat a lot, so each distinct (target, file, container) is resolved once: the lookups are joined to the distinct ones,
    which also takes the heat out of a target that a tenth of all rows share, and the answers are joined back null-safely.
    """
    by_fq, here, named = _winners(cat)
    key = ["target", "file", "container_fqname"]
    t = F.regexp_replace("target", r"^\s+|\s+$", "")
    one = refs.select(*key).distinct().withColumns({"t": t, "name": F.element_at(F.split(t, r"\."), -1), "inner": F.when(F.coalesce("container_fqname", F.lit("")) != "", F.concat("container_fqname", F.lit("."), t))})
    tier = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    a, b, c, d = tier(by_fq, "a"), tier(by_fq, "b"), tier(here, "c"), tier(named, "d")
    x = one.join(a, F.col("t") == F.col("a_key"), "left").join(b, F.col("inner") == F.col("b_key"), "left")
    x = x.join(c, (F.col("name") == F.col("c_key")) & (F.col("file") == F.col("c_file")), "left").join(d, F.col("name") == F.col("d_key"), "left")
    pick = [
        (F.col("t") == "", F.lit("unresolved:<empty>"), F.lit("unresolved"), F.lit(unresolved)),
        (F.col("a_to").isNotNull(), F.col("a_to"), F.col("a_to_kind"), F.lit(FQNAME)),
        (F.col("b_to").isNotNull(), F.col("b_to"), F.col("b_to_kind"), F.lit(IN_CONTAINER)),
        (F.col("d_n") == 1, F.col("d_to"), F.col("d_to_kind"), F.when(F.col("d_file").eqNullSafe(F.col("file")), ONLY_HERE).otherwise(ONLY_ELSE)),
        (F.col("c_to").isNotNull(), F.col("c_to"), F.col("c_to_kind"), F.lit(MANY_HERE)),
        (F.col("d_to").isNotNull(), F.col("d_to"), F.col("d_to_kind"), F.lit(MANY_ELSE)),
    ]
    case = lambda i, other: _case([(p[0], p[i]) for p in pick], other)
    got = x.select(*(F.col(k).alias(f"k_{k}") for k in key), case(1, F.concat(F.lit("unresolved:"), "t")).alias("to_id"), case(2, F.lit("unresolved")).alias("to_kind"), case(3, F.lit(unresolved)).alias("confidence"))
    same = [refs[k].eqNullSafe(got[f"k_{k}"]) for k in key]
    return refs.join(got, same[0] & same[1] & same[2]).drop(*(f"k_{k}" for k in key))


def _case(pairs: list[tuple[Column, Column]], other: Column) -> Column:
    out = F.when(*pairs[0])
    for p in pairs[1:]:
        out = out.when(*p)
    return out.otherwise(other)


def _trimmed(c: str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _test_ends(resolved: DataFrame, cat: DataFrame) -> DataFrame:
    """Adds test_id, test_kind and confidence to covered_by entries (reference) whose last name is resolved: by id, by fqname, then by that name."""
    by_id = cat.select(F.col("id").alias("i_id"), F.col("kind").alias("i_kind"))
    by_fq = _winners(cat)[0].select(F.col("key").alias("f_key"), F.col("to").alias("f_to"), F.col("to_kind").alias("f_kind"))
    x = resolved.withColumn("t", _trimmed("reference")).join(by_id, F.col("t") == F.col("i_id"), "left").join(by_fq, F.col("t") == F.col("f_key"), "left")
    lost = F.col("to_kind") == "unresolved"
    pick = [
        (F.col("t") == "", F.lit("unresolved:<empty>"), F.lit("test"), F.lit(0.2)),
        (F.col("i_id").isNotNull(), F.col("i_id"), F.col("i_kind"), F.lit(TEST_ID)),
        (F.col("f_to").isNotNull(), F.col("f_to"), F.col("f_kind"), F.lit(TEST_FQNAME)),
        (lost, F.concat(F.lit("unresolved:"), "t"), F.lit("test"), F.lit(TEST_UNRESOLVED)),
    ]
    case = lambda i, other: _case([(p[0], p[i]) for p in pick], other)
    rest = [c for c in resolved.columns if c not in ("to_id", "to_kind", "confidence")]
    return x.select(*rest, case(1, F.col("to_id")).alias("test_id"), case(2, F.col("to_kind")).alias("test_kind"), case(3, F.greatest("confidence", F.lit(TEST_LEAST))).alias("confidence"))


def resolve_tests(refs: DataFrame, cat: DataFrame) -> DataFrame:
    """The same for covered_by entries (reference, file): test_id, test_kind and confidence."""
    last = F.element_at(F.split(F.element_at(F.split(_trimmed("reference"), ":"), -1), r"\."), -1)
    rows = refs.withColumns({"target": last, "container_fqname": F.lit(None).cast("string")})
    return _test_ends(resolve(rows, cat), cat).select(*refs.columns, "test_id", "test_kind", "confidence")


def import_targets(files: DataFrame) -> DataFrame:
    """path, line, target of the import lines of Python, JavaScript, TypeScript, Rust, Java and Go; Go's blocks by the last bracket before a line."""
    rows = lines(files).join(files.select("path", F.lower("language").alias("language")).distinct(), "path").withColumn("s", F.trim("text"))
    lang = F.when(F.col("language").isin("typescript", "tsx", "javascript"), "javascript").otherwise(F.col("language"))
    rows = rows.withColumn("language", lang)
    go = rows.filter("language = 'go'")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("s").rlike(GO_OPEN), True).when(F.col("s").startswith(")"), False)
    go = go.withColumn("inside", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))
    block = go.filter(F.col("inside") & ~F.col("s").startswith(")")).select("path", "line", F.regexp_extract("s", GO_ENTRY, 1).alias("target"))
    parts = [block, go.filter(~F.col("inside")).select("path", "line", F.regexp_extract("s", IMPORTS["go"][0], 1).alias("target"))]
    for k in ("javascript", "rust", "java"):
        found = F.coalesce(*(F.nullif(F.regexp_extract("s", r, 1), F.lit("")) for r in IMPORTS[k]))
        parts.append(rows.filter(F.col("language") == k).select("path", "line", F.trim(found).alias("target")))
    py = rows.filter("language = 'python'")
    clean = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(F.substring_index(F.trim(x), " as ", 1))), lambda x: x != "")
    frm = py.filter(F.col("s").rlike(PY_FROM)).select("path", "line", F.regexp_extract("s", PY_FROM, 1).alias("m"), F.explode(clean(F.translate(F.regexp_extract("s", PY_FROM, 2), "()", ""))).alias("n"))
    parts.append(frm.select("path", "line", F.concat_ws(".", "m", "n").alias("target")))
    parts.append(py.filter(~F.col("s").rlike(PY_FROM) & F.col("s").rlike(PY_IMPORT)).select("path", "line", F.explode(clean(F.regexp_extract("s", PY_IMPORT, 1))).alias("target")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("target <> ''")


def extract(files: DataFrame, symbols: DataFrame, others: DataFrame | None = None, with_text: bool = True) -> DataFrame:
    """The edges of files (path, language, content) and their symbols; `others` are further symbols that names may resolve to."""
    own = one_per_id(symbols)
    cat = catalog(own if others is None else others, None if others is None else own)
    base = own.select("id", "name", "kind", "file_path", "start_line", "end_line", "container_id", "container_fqname", "calls", "covered_by", "repo_id", "commit_hash")
    node = file_node_id("repo_id", "file_path")
    keep = ["repo_id", "commit_hash"]
    none = F.lit(None).cast("string")

    def known(rows: DataFrame, order: int, kind: str, from_id: Column, from_kind: str) -> DataFrame:
        return rows.select(F.lit(order).alias("ord"), F.lit(kind).alias("edge_type"), from_id.alias("from_id"), F.col("id").alias("to_id"), F.lit(from_kind).alias("from_kind"), F.col("kind").alias("to_kind"), "file_path", F.col("start_line").alias("line"), F.lit(1.0).alias("confidence"), *keep)

    def named(rows: DataFrame, order: int, kind: str, target: Column, given: Column, own_id: Column, own_kind: Column, line: str, container: str | None) -> DataFrame:
        """References by name of all kinds in one shape, so that they are resolved together."""
        return rows.select(F.lit(order).alias("ord"), F.lit(kind).alias("edge_type"), own_id.alias("own_id"), own_kind.alias("own_kind"), F.col("file_path"), F.col(line).alias("line"), *keep, target.alias("target"), given.alias("reference"), F.col("file_path").alias("file"), (F.col(container) if container else none).alias("container_fqname"))

    defines = known(base, 0, "DEFINES", node, "file")
    contains = known(base.filter("container_id <> ''"), 1, "CONTAINS", F.col("container_id"), "container")
    calls = base.withColumn("t", F.explode("calls")).filter("t IS NOT NULL")
    text = files.select(F.col("path").alias("file_path"), "content").dropDuplicates(["file_path"])
    body = F.array_join(F.slice(split_lines("content"), F.greatest(F.lit(1), F.col("start_line")), F.greatest(F.lit(0), F.col("end_line") - F.greatest(F.lit(1), F.col("start_line")) + 1)), "\n")
    used = base.join(text, "file_path").withColumn("t", F.explode(reference_tokens(body, "name")))
    tests = base.withColumn("r", F.explode(F.array_distinct("covered_by"))).filter("r IS NOT NULL")
    last = F.element_at(F.split(F.element_at(F.split(_trimmed("r"), ":"), -1), r"\."), -1)
    repo = own.groupBy("file_path").agg(F.min("repo_id").alias("repo_id"), F.min("commit_hash").alias("commit_hash"))
    imports = import_targets(files.dropDuplicates(["path"])).withColumnRenamed("path", "file_path").join(repo, "file_path")
    refs = named(calls, 2, "CALLS", F.col("t"), none, F.col("id"), F.col("kind"), "start_line", "container_fqname")
    refs = refs.unionByName(named(used, 3, "REFERENCES", F.col("t"), none, F.col("id"), F.col("kind"), "start_line", "container_fqname"))
    refs = refs.unionByName(named(tests, 4, "TESTS", last, F.col("r"), F.col("id"), F.col("kind"), "start_line", None))
    refs = refs.unionByName(named(imports, 5, "IMPORTS", F.col("target"), none, node, F.lit("file"), "line", None))
    scratch = Scratch(symbols.sparkSession, "edges")  # read by the distinct names and by what their answers are joined to
    refs, cat = scratch.cut(refs, "references"), scratch.cut(cat, "catalog")
    got = resolve(refs, cat)
    plain = got.filter("edge_type <> 'TESTS' AND (edge_type <> 'REFERENCES' OR to_id <> own_id)")
    c = F.col("confidence")
    weight = F.when(F.col("edge_type") == "REFERENCES", F.least(c, F.lit(REFERENCE_MOST))).when(F.col("edge_type") == "IMPORTS", F.greatest(c, F.lit(IMPORT_LEAST))).otherwise(c)
    plain = plain.select("ord", "edge_type", F.col("own_id").alias("from_id"), "to_id", F.col("own_kind").alias("from_kind"), "to_kind", "file_path", "line", weight.alias("confidence"), *keep)
    covered = _test_ends(got.filter("edge_type = 'TESTS'"), cat).select("ord", "edge_type", F.col("test_id").alias("from_id"), F.col("own_id").alias("to_id"), F.col("test_kind").alias("from_kind"), F.col("own_kind").alias("to_kind"), "file_path", "line", "confidence", *keep)
    out = defines.unionByName(contains).unionByName(plain).unionByName(covered)
    key = ["edge_type", "from_id", "to_id", "file_path", "line"]
    rest = ["from_kind", "to_kind", "confidence", *keep]
    out = out.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("ord", -F.col("confidence"), "to_kind")).alias("r")).select(*key, *(f"r.{c}" for c in rest))
    out = out.withColumn("edge_id", edge_id("repo_id", "edge_type", "from_id", "to_id", "file_path", "line"))
    return out.withColumn("text", edge_text("edge_type", "from_id", "to_id", "file_path", "line", "confidence") if with_text else F.lit(None).cast("string"))


def incident(edges: DataFrame, anchors: DataFrame, direction: str = "both", edge_type: str | None = None) -> DataFrame:
    """Edges of each anchor (symbol_id, anchor_path), one row per anchor and edge id, with endpoint_match.

    Two equi joins instead of one with OR, so each is a hash or merge join on its endpoint.
    """
    e = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    e = e.dropDuplicates(["edge_id"])
    sides = {"incoming": ["to_id"], "outgoing": ["from_id"], "both": ["from_id", "to_id"]}[direction]
    out = None
    for side in sides:
        part = e.join(anchors, e[side] == anchors.symbol_id)
        if side == "to_id" and len(sides) == 2:
            part = part.filter("from_id <> to_id OR from_id IS NULL")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("endpoint_match", (F.col("from_id") == F.col("symbol_id")).cast("int") + (F.col("to_id") == F.col("symbol_id")).cast("int"))


def neighbors(edges: DataFrame, anchors: DataFrame, k: int, direction: str = "both", edge_type: str | None = None) -> DataFrame:
    """Up to k edges of every anchor by endpoint match, confidence, module distance, latest commit, path, line and id."""
    rows = incident(edges, anchors, direction, edge_type)
    named = F.when((F.col("commit_hash") != "unknown") & (F.col("commit_hash") != ""), F.col("commit_hash"))
    # summed on the map side and joined back, so that the row number below can drop a hub's rows before they are shuffled
    latest = rows.groupBy(F.col("symbol_id").alias("l_id")).agg(F.max(named).alias("latest"))
    rows = rows.join(latest, F.col("symbol_id") == F.col("l_id")).withColumn("commit_penalty", F.when(F.col("commit_hash") == F.col("latest"), 0).otherwise(1)).withColumn("module_distance", P.module_distance("anchor_path", "file_path"))
    order = [F.desc("endpoint_match"), F.desc("confidence"), "module_distance", "commit_penalty", "file_path", "line", "edge_id"]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("symbol_id").orderBy(*order))).filter(F.col("rank") <= k)
    return rows.select("symbol_id", "rank", "edge_id", "edge_type", "from_id", "to_id", "file_path", "line", "confidence", "endpoint_match", "module_distance", "commit_penalty")


def latest_commit(edges: DataFrame) -> DataFrame:
    """One row: the largest commit that is neither empty nor unknown."""
    return edges.agg(F.max(F.when((F.col("commit_hash") != "unknown") & (F.col("commit_hash") != ""), F.col("commit_hash"))).alias("latest_commit"))


def search_edges(edges: DataFrame, query: list[float], k: int, edge_type: str | None = None, vector: str = "embedding_vector") -> DataFrame:
    """Nearest edge facts: similarity, then confidence, path, line, id; vectors of another length don't count."""
    e = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = e.select("edge_id", "edge_type", "from_id", "to_id", "file_path", "line", "confidence", l2(vector, q).alias("distance")).filter("distance IS NOT NULL")
    rows = rows.withColumn("similarity", F.round(score("distance"), 9))
    return rows.orderBy(F.desc("similarity"), F.desc("confidence"), "file_path", "line", "edge_id").limit(k).drop("distance")


def as_payload(ranked: DataFrame) -> DataFrame:
    """The ranked edge with its ranking as a nested struct."""
    rank = ["endpoint_match", "module_distance", "commit_penalty"]
    return ranked.select(*(c for c in ranked.columns if c not in rank), F.struct(*rank).alias("ranking"))
