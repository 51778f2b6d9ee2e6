"""Queries over the upkeep of the relations, path and text functions and the remaining metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import chunking as C
from tessera.operators import coverage as W
from tessera.operators import fusion as X
from tessera.operators import graph as G
from tessera.operators import guidance as U
from tessera.operators import metrics as M
from tessera.operators import occurrences as O
from tessera.operators import orphans as ORPHANS
from tessera.operators import relations as R
from tessera.operators import semantic as S
from tessera.plans.index_queries import _LINES, _SRC, _SYM, sources
from tessera.plans.search_queries import _HITS, _QUALITY, _RANKED, _SOURCE, _TEST, _hits
from tessera.runtime import load, one_per_id
from tessera.sources import scan

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Scans and look-ups


@query("SELECT id, file_path, start_line FROM symbols")
def list_symbols(spark, d):
    return R.listing(load(spark, d, "symbols"), "symbols").select("id", "file_path", "start_line")


@query("SELECT chunk_id, file_path, start_line, chunk_part_index FROM chunks")
def list_chunks(spark, d):
    return R.listing(load(spark, d, "chunks"), "chunks").select("chunk_id", "file_path", "start_line", "chunk_part_index")


@query("SELECT edge_id, file_path, line, edge_type FROM edges")
def list_edges(spark, d):
    return R.listing(load(spark, d, "edges"), "edges").select("edge_id", "file_path", "line", "edge_type")


@query("SELECT DISTINCT file_path FROM symbols ORDER BY file_path LIMIT 25")
def sample_paths(spark, d):
    return R.sample_paths(load(spark, d, "symbols"), 25)


@query("SELECT id, name, kind FROM symbols WHERE id IN (SELECT symbol_id FROM chunks WHERE chunk_part_total > 1)")
def lookup_symbols(spark, d):
    ids = load(spark, d, "chunks").filter("chunk_part_total > 1").select(F.col("symbol_id").alias("id"))
    return R.lookup(load(spark, d, "symbols"), ids, "id").select("id", "name", "kind")


@query("SELECT chunk_id, symbol_id FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE embedding_vector IS NULL)")
def lookup_chunks(spark, d):
    c = load(spark, d, "chunks")
    return R.lookup(c, c.filter("embedding_vector IS NULL"), "chunk_id").select("chunk_id", "symbol_id")


_OCC = f"""k AS (SELECT DISTINCT file_path, start_line, name FROM symbols),
t AS (SELECT DISTINCT path, line, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS s FROM lines_),
occ AS (SELECT s AS symbol, 'ref' AS kind, path, line AS start_line, line AS end_line, src.language FROM t JOIN src USING (path) WHERE length(s) >= 3 AND lower(s) NOT IN ({", ".join(f"'{w}'" for w in T.REFERENCE_KEYWORDS)})
    AND NOT EXISTS (SELECT 1 FROM k WHERE file_path = path AND start_line = line AND name = s)
  UNION ALL SELECT DISTINCT name, 'def', file_path, start_line, end_line, symbols.language FROM symbols JOIN src ON path = file_path WHERE start_line >= 1 AND end_line <= len(string_split(content, chr(10))))"""


@query(f"WITH {_SRC}, {_LINES}, {_OCC} SELECT DISTINCT symbol, kind, path, start_line, end_line FROM occ WHERE language = 'python' AND (starts_with(path, '/work/') AND contains(path, '/src/'))")
def occurrence_listing(spark, d):
    occ = O.build(sources(spark, d), load(spark, d, "symbols"))
    rows = O.listing(occ, ["/work"], "python").filter(P.in_src("path"))
    return rows.select("symbol", "kind", "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line")).distinct()


@query(f"WITH {_RANKED} SELECT symbol_id, row_number() OVER (PARTITION BY symbol_id ORDER BY confidence DESC, md, cp2, file_path, line, edge_id) AS rank, edge_id FROM (SELECT *, CASE WHEN commit_hash = max(commit_hash) OVER (PARTITION BY symbol_id) THEN 0 ELSE 1 END AS cp2 FROM m WHERE from_id = symbol_id AND from_id IS DISTINCT FROM to_id AND edge_type = 'CALLS') QUALIFY rank <= 3")
def neighbors_outgoing(spark, d):
    cols = ["edge_type", "from_id", "to_id", "file_path", "line", "confidence", "commit_hash"]
    e = load(spark, d, "edges").groupBy("edge_id").agg(F.min_by(F.struct(*cols), "commit_hash").alias("r"), F.min(F.struct(*cols)).alias("z")).select("edge_id", F.coalesce("r", "z").alias("r")).select("edge_id", "r.*")
    anchors = load(spark, d, "symbols").groupBy(F.col("id").alias("symbol_id")).agg(F.min("file_path").alias("anchor_path"))
    return G.neighbors(e.filter("NOT from_id <=> to_id"), anchors, 3, "outgoing", "CALLS").select("symbol_id", F.col("rank").cast("long").alias("rank"), "edge_id")


@query("SELECT from_id AS symbol_id, count(DISTINCT edge_id) AS n, count(DISTINCT edge_type) AS types FROM edges WHERE from_id IN (SELECT id FROM symbols) GROUP BY from_id")
def outgoing_counts(spark, d):
    anchors = load(spark, d, "symbols").select(F.col("id").alias("symbol_id")).distinct()
    return G.incident(load(spark, d, "edges"), anchors, "outgoing").groupBy("symbol_id").agg(F.count("*").alias("n"), F.count_distinct("edge_type").alias("types"))


# Changes

_GONE = "gone AS (SELECT path FROM file_changes GROUP BY path HAVING arg_max(op, seq) = 'deleted'), moved AS (SELECT path FROM file_changes GROUP BY path HAVING arg_max(op, seq) = 'modified')"


def _moved(spark, d) -> DataFrame:
    """Paths whose last change is a modification."""
    c = load(spark, d, "file_changes").filter("path IS NOT NULL").groupBy("path").agg(F.max_by("op", "seq").alias("op"))
    return c.filter("op = 'modified'").select("path")


@query(f"WITH {_GONE} SELECT edge_id, file_path, CASE WHEN file_path IN (FROM moved) THEN line + 1 ELSE line END AS line FROM edges")
def replace_file_edges(spark, d):
    """Edges of changed files are replaced by new ones, a line further down."""
    e, touched = load(spark, d, "edges"), _moved(spark, d)
    new = e.join(touched.withColumnRenamed("path", "file_path"), "file_path", "left_semi").withColumn("line", F.col("line") + 1)
    return R.replace_files(e, new, touched, "file_path").select("edge_id", "file_path", "line")


@query(f"WITH {_GONE} SELECT path, content_hash FROM files WHERE path NOT IN (FROM moved) UNION ALL SELECT path, 'touched' FROM moved WHERE path IN (SELECT path FROM files)")
def replace_file_rows(spark, d):
    """The rows of changed files in the files relation give way to one row each with the new hash."""
    f, touched = load(spark, d, "files"), _moved(spark, d)
    new = f.join(touched, "path", "left_semi").select("path", "language", F.lit("touched").alias("content_hash"), "last_indexed").dropDuplicates(["path"])
    return R.replace_files(f, new, touched, "path").select("path", "content_hash")


@query(f"WITH {_GONE} SELECT chunk_id, symbol_id FROM chunks WHERE symbol_id IS NULL OR symbol_id NOT IN (SELECT id FROM symbols WHERE file_path IN (FROM gone))")
def delete_by_symbols(spark, d):
    lost = load(spark, d, "symbols").join(ORPHANS.removed_files(load(spark, d, "file_changes")), "file_path", "left_semi")
    return R.delete(load(spark, d, "chunks"), lost.select(F.col("id").alias("symbol_id")), ["symbol_id"]).select("chunk_id", "symbol_id")


@query("""WITH c AS (SELECT DISTINCT chunk_id FROM chunks), p AS (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_part_total > 1)
SELECT chunk_id, 0 AS version FROM c WHERE chunk_id NOT IN (FROM p) UNION ALL SELECT chunk_id, 1 FROM p UNION ALL SELECT chunk_id || '-b', 1 FROM p""")
def upsert_chunks(spark, d):
    """New versions of the chunks that have several parts, and as many chunks that are new."""
    old = load(spark, d, "chunks").filter("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"])
    many = load(spark, d, "chunks").filter("chunk_part_total > 1").select("chunk_id").distinct()
    base = old.select("chunk_id", F.lit(0).alias("version"))
    new = many.select("chunk_id", F.lit(1).alias("version")).unionByName(many.select(F.concat("chunk_id", F.lit("-b")).alias("chunk_id"), F.lit(1).alias("version")))
    return R.upsert(base, new, R.KEYS["chunks"])


@query("""SELECT edge_id, CAST(CASE WHEN bool_or(edge_type = 'CALLS') THEN 1.0 ELSE max(confidence) END AS DOUBLE) AS confidence FROM edges GROUP BY edge_id""")
def upsert_edges(spark, d):
    one = load(spark, d, "edges").groupBy("edge_id").agg(F.max("confidence").alias("confidence"), F.bool_or(F.col("edge_type") == "CALLS").alias("calls"))
    return R.upsert(one.select("edge_id", "confidence"), one.filter("calls").select("edge_id", F.lit(1.0).alias("confidence")), R.KEYS["edges"])


@query("""WITH o AS (SELECT path, min(content_hash) AS h FROM files GROUP BY path) SELECT path, CASE WHEN path IN (SELECT path FROM source_texts) THEN 'audited' ELSE h END AS content_hash FROM o
UNION ALL SELECT DISTINCT path, 'audited' FROM source_texts WHERE path NOT IN (SELECT path FROM files)""")
def upsert_audited_files(spark, d):
    old = load(spark, d, "files").groupBy("path").agg(F.min("content_hash").alias("content_hash"))
    return R.upsert(old, load(spark, d, "source_texts").select("path", F.lit("audited").alias("content_hash")), R.KEYS["audit_files"])


def _audits(spark, d) -> DataFrame:
    """An audit row of every symbol without documentation."""
    s = one_per_id(load(spark, d, "symbols")).filter("coalesce(docstring, '') = ''")
    return s.select(F.col("id").alias("symbol_id"), F.array(F.lit("Missing docstring")).alias("warnings"), F.lit(None).cast("double").alias("semantic_score"), F.lit(None).cast("map<string,string>").alias("score_metadata"), "file_path")


_AUD = f"{_SYM}, aud AS (SELECT id AS symbol_id, file_path, 'Missing docstring' AS w, kind FROM sym WHERE coalesce(docstring, '') = '')"


@query(f"""WITH {_AUD} SELECT symbol_id, CASE WHEN kind = 'class' THEN 'checked' ELSE w END AS warnings, file_path FROM aud
UNION ALL SELECT id, 'checked', NULL FROM sym WHERE kind = 'class' AND coalesce(docstring, '') <> ''""")
def audit_merge(spark, d):
    """New audits of all classes, without a path; the old path is kept where there is one."""
    new = one_per_id(load(spark, d, "symbols")).filter("kind = 'class'").select(F.col("id").alias("symbol_id"), F.array(F.lit("checked")).alias("warnings"), F.lit(0.5).alias("semantic_score"), F.lit(None).cast("map<string,string>").alias("score_metadata"), F.lit(None).cast("string").alias("file_path"))
    return R.audit_merge(_audits(spark, d), new).select("symbol_id", F.array_join("warnings", ";").alias("warnings"), "file_path")


@query(f"WITH {_AUD}, p AS (SELECT min(file_path) AS p FROM aud) SELECT DISTINCT symbol_id FROM aud WHERE file_path = (SELECT p FROM p) OR symbol_id IN (SELECT id FROM symbols WHERE file_path = (SELECT p FROM p))")
def audits_for_file(spark, d):
    a = _audits(spark, d)
    first = a.agg(F.min("file_path").alias("p")).first().p
    return R.audits_for_file(a, load(spark, d, "symbols"), first or "").select("symbol_id")


@query(f"""WITH {_AUD}, was AS (SELECT path, content_hash FROM files), now AS (SELECT path, arg_max(content_hash, last_indexed) AS content_hash FROM files GROUP BY path)
SELECT symbol_id FROM aud WHERE file_path IN (SELECT path FROM (SELECT path, arg_min(content_hash, last_indexed) AS h FROM files GROUP BY path) w JOIN now USING (path) WHERE w.h = now.content_hash)""")
def reusable_audits(spark, d):
    f = load(spark, d, "files")
    was, now = (f.groupBy("path").agg(g("content_hash", "last_indexed").alias("content_hash")) for g in (F.min_by, F.max_by))
    return R.reusable_audits(_audits(spark, d), was, now).select("symbol_id")


def _log(spark, d) -> DataFrame:
    """A log of file states: every row of files was extracted, those that source_texts has were embedded a day later."""
    f = load(spark, d, "files").select("path", "content_hash", "last_indexed")
    a = f.select("path", F.lit("extract_complete").alias("state"), "content_hash", F.col("last_indexed").alias("updated_at"))
    b = f.join(load(spark, d, "source_texts").select("path").distinct(), "path", "left_semi").select("path", F.lit("embedded_complete").alias("state"), "content_hash", (F.col("last_indexed") + F.expr("INTERVAL 1 DAY")).alias("updated_at"))
    return a.unionByName(b)


_LOG = """log AS (SELECT path, 'extract_complete' AS state, content_hash, last_indexed AS updated_at FROM files UNION ALL SELECT path, 'embedded_complete', content_hash, last_indexed + INTERVAL 1 DAY FROM files WHERE path IN (SELECT path FROM source_texts)),
cp AS (SELECT path, max((updated_at, state, content_hash)) AS r FROM log GROUP BY path)"""


@query(f"WITH {_LOG} SELECT path, r[2] AS state, r[3] AS content_hash FROM cp WHERE r[2] IN ('embedded_complete')")
def checkpoint_states(spark, d):
    return R.checkpoint_log(_log(spark, d), ["embedded_complete"]).select("path", "state", "content_hash")


@query(f"WITH {_LOG} SELECT count(*) AS files, count(*) FILTER (r[2] = 'extract_complete') AS extracted, count(*) FILTER (r[2] = 'embedded_complete') AS embedded FROM cp")
def checkpoint_counts(spark, d):
    return M.checkpoint_stats(R.checkpoint_log(_log(spark, d)))


@query("""SELECT DISTINCT sha256(text) AS text_hash FROM edges WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT text_hash FROM embedding_ledger WHERE embedding_profile = 'mini-64' AND record_kind = 'edge')""")
def edge_ledger_todo(spark, d):
    return R.ledger_lookup(load(spark, d, "edges"), load(spark, d, "embedding_ledger"), "mini-64", "edge")[1].select("text_hash")


@query("""WITH seen AS (SELECT path FROM file_changes GROUP BY path HAVING arg_max(op, seq) <> 'deleted'), p AS (SELECT regexp_extract(min(file_path), '^(/[^/]+/[^/]+)/', 1) AS p FROM chunks)
SELECT chunk_id, file_path FROM chunks, p WHERE NOT coalesce(starts_with(file_path, p || '/'), false) OR file_path IN (FROM seen)""")
def scoped_prune(spark, d):
    """Only below one directory: what belongs to paths that are no longer there goes."""
    from tessera.streaming import watch as WT

    c = load(spark, d, "chunks")
    first = c.agg(F.min("file_path").alias("p")).first().p or "/x/y/"
    seen = WT.coalesce(load(spark, d, "file_changes")).filter("NOT deleted").select("path")
    return R.prune({"chunks": c}, seen, "/".join(first.split("/")[:3]))["chunks"].select("chunk_id", "file_path")


@query(f"""WITH {_SYM}, m AS (SELECT id, list_filter(list_concat(list_concat(coalesce(calls, []), coalesce(invariants, [])), coalesce(covered_by, [])), lambda x: x IS NOT NULL) AS l FROM sym)
SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS codes FROM m""")
def merged_codes(spark, d):
    """Ordered unions of the lists of a symbol."""
    s = one_per_id(load(spark, d, "symbols"))
    return s.select("id", F.array_join(R.merge_codes(F.col("calls"), F.col("invariants"), F.col("covered_by")), ",").alias("codes"))


@query("""WITH c AS (SELECT DISTINCT chunk_id AS k FROM chunks WHERE file_path NOT IN (SELECT path FROM file_changes GROUP BY path HAVING arg_max(op, seq) = 'modified')), v AS (SELECT DISTINCT chunk_id AS k FROM chunks WHERE embedding_vector IS NOT NULL)
SELECT count(*) FILTER (c.k IS NOT NULL AND v.k IS NOT NULL) AS "both", count(*) FILTER (v.k IS NULL) AS only_left, count(*) FILTER (c.k IS NULL) AS only_right FROM c FULL JOIN v ON c.k = v.k""")
def pending_reconcile(spark, d):
    """Chunks against vectors; chunks of files that are pending don't count."""
    c = load(spark, d, "chunks")
    return R.reconcile(c, c.filter("embedding_vector IS NOT NULL"), "chunk_id", _moved(spark, d))


# Paths


@query(rf"""WITH p AS (SELECT DISTINCT path, lower(path) AS l, regexp_extract(lower(path), '[^/]*$') AS b FROM files),
c AS (SELECT *, contains(l, '/docs/') OR contains(l, '/doc/') OR starts_with(l, 'docs/') OR regexp_matches(regexp_replace(b, '(.)\.[^.]*$', '\1'), 'readme|changelog|changes|history|news|release-notes') AS dx FROM p),
e AS (SELECT *, b IN ('mkdocs.yml', 'mkdocs.yaml', '.readthedocs.yaml') OR (dx AND b IN ('conf.py', 'make.bat', 'makefile')) AS build FROM c),
g AS (SELECT *, regexp_matches(l, '(^|/)docs/internals/') OR dx OR build AS auth, regexp_matches(l, '(^|/)\.github/workflows/') OR build OR b IN ('.readthedocs.yaml', 'mkdocs.yaml', 'mkdocs.yml', 'pytest.ini', 'pyproject.toml', 'setup.cfg', 'setup.py', 'tox.ini', 'noxfile.py', 'conftest.py') AS flow,
  {_SOURCE} AS s, {_TEST} AS t FROM e)
SELECT path, auth AS docs_authority, flow AS workflow, build AS docs_build, dx OR flow OR contains(l, '/examples/') OR contains(l, '/example/') AS auxiliary,
  CAST(CASE WHEN regexp_matches(l, '(^|/)(dist|vendor|node_modules)(/|$)') THEN 0 WHEN s THEN 1.0 WHEN t THEN 0.82 WHEN auth THEN 0.28 WHEN flow THEN 0.22 ELSE 0.66 END AS DOUBLE) AS quality,
  CAST(CASE WHEN flow THEN 1.0 WHEN auth THEN 0.97 WHEN s THEN 0.26 WHEN t THEN 0.18 ELSE 0.24 END AS DOUBLE) AS workflow_score, s OR t AS code_authority, auth OR flow AS docs_speaks,
  regexp_matches(l, '(^|/)src/') AS in_src, regexp_matches(l, '(^|/)tests?(/|$)|(^|/)test_[^/]*$|_test\.(py|go)$|\.spec\.(ts|tsx|js|jsx)$') AS ranking_test FROM g""")
def path_predicates(spark, d):
    p = load(spark, d, "files").select("path").distinct()
    return p.select(
        "path", P.is_docs_authority("path").alias("docs_authority"), P.is_workflow("path").alias("workflow"), P.is_docs_build("path").alias("docs_build"), P.is_auxiliary("path", "code").alias("auxiliary"), P.quality("path", "code").alias("quality"),
        P.domain_score("path", "workflow_config").alias("workflow_score"), P.is_authority("path", "code").alias("code_authority"), P.is_authority("path", "docs_policy").alias("docs_speaks"), P.in_src("path").alias("in_src"), P.is_ranking_test("path").alias("ranking_test"))


_EXCLUDED = ", ".join(f"'{x}'" for x in scan.EXCLUDED)


@query(rf"""WITH b AS (SELECT DISTINCT path FROM files), p AS (SELECT path FROM b UNION ALL SELECT replace(path, '/src/', '/node_modules/') FROM b UNION ALL SELECT path || '.min.js' FROM b UNION ALL SELECT regexp_replace(path, '\.[^.]*$', '.txt') FROM b)
SELECT path, regexp_matches(lower(path), '\.({'|'.join(scan.LANGUAGES)})$') AND NOT lower(path) LIKE '%.min.js' AS supported, len(list_intersect(string_split(path, '/'), [{_EXCLUDED}])) > 0 AS excluded,
  CASE regexp_extract(lower(path), '\.([^./]+)$', 1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in scan.LANGUAGES.items())} END AS language FROM p""")
def scan_filter(spark, d):
    """What a directory scan keeps, over the known paths and three variants of each."""
    b = load(spark, d, "files").select("path").distinct()
    p = b.unionByName(b.select(F.regexp_replace("path", "/src/", "/node_modules/").alias("path"))).unionByName(b.select(F.concat("path", F.lit(".min.js")).alias("path"))).unionByName(b.select(F.regexp_replace("path", r"\.[^.]*$", ".txt").alias("path")))
    return p.select("path", scan.supported().alias("supported"), scan.excluded().alias("excluded"), scan.language_of().alias("language"))


@query("""WITH f AS (SELECT DISTINCT path, regexp_extract(path, '^(/[^/]+/[^/]+)/', 1) AS repo, contains(path, '/index/') AS v FROM files), r AS (SELECT DISTINCT repo || '/env' AS root FROM f WHERE v)
SELECT path FROM f WHERE NOT v OR repo = ''""")
def virtualenvs_left_out(spark, d):
    """Files below index/ are moved into a virtualenv of their repo, which is known by its pyvenv.cfg; a scan leaves them out."""
    f = load(spark, d, "files").select("path").distinct().withColumn("repo", F.regexp_extract("path", "^(/[^/]+/[^/]+)/", 1)).withColumn("v", F.col("path").contains("/index/") & (F.col("repo") != ""))
    moved = f.select(F.when(F.col("v"), F.concat("repo", F.lit("/env"), F.expr("substring(path, length(repo) + 1)"))).otherwise(F.col("path")).alias("path"))
    listing = moved.unionByName(f.filter("v").select(F.concat("repo", F.lit("/env/pyvenv.cfg")).alias("path")).distinct())
    return scan.without_virtualenvs(moved, listing)


@query(r"""WITH f AS (SELECT DISTINCT path FROM files), t AS (SELECT path FROM f WHERE contains(path, '/tests/')), s AS (SELECT path FROM f WHERE contains(path, '/src/')),
x AS (SELECT s.path AS source, t.path AS test, regexp_replace(regexp_extract(lower(s.path), '[^/]*$'), '(.)\.[^.]*$', '\1') AS a, regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(t.path), '[^/]*$'), '(.)\.[^.]*$', '\1'), '^test_', ''), '_test$', '') AS b,
  list_distinct(list_filter(string_split(lower(s.path), '/'), lambda z: z NOT IN ('', '.', 'src', 'tests', 'test', 'python', 'lib'))) AS u, list_distinct(list_filter(string_split(lower(t.path), '/'), lambda z: z NOT IN ('', '.', 'src', 'tests', 'test', 'python', 'lib'))) AS v FROM s JOIN t ON regexp_extract(s.path, '^(/[^/]+/[^/]+)/', 1) = regexp_extract(t.path, '^(/[^/]+/[^/]+)/', 1))
SELECT source, test, CAST(len(list_intersect(u, v)) + CASE WHEN a = '' THEN 0 WHEN a = b THEN 3 WHEN contains(b, a) THEN 2 ELSE 0 END AS INTEGER) AS relevance FROM x""")
def related_tests(spark, d):
    """How near each test file is to each source file of its repo."""
    f = load(spark, d, "files").select("path").distinct().withColumn("repo", F.regexp_extract("path", "^(/[^/]+/[^/]+)/", 1))
    s, t = f.filter(F.col("path").contains("/src/")).withColumnRenamed("path", "source"), f.filter(F.col("path").contains("/tests/")).withColumnRenamed("path", "test")
    return s.join(t, "repo").select("source", "test", P.test_relevance("source", "test").alias("relevance"))


@query("WITH f AS (SELECT DISTINCT path FROM files) SELECT path, regexp_replace(path, '/[^/]*$', '') AS folded, path AS same, '.' AS empty FROM f")
def normal_paths(spark, d):
    p = load(spark, d, "files").select("path").distinct()
    return p.select("path", T.norm_path(F.concat("path", F.lit("/x/.././/.."))).alias("folded"), T.norm_path(F.concat(F.lit("//"), F.expr("replace(path, '/', '//./')"), F.lit("/"))).alias("same"), T.norm_path(F.lit("a/..")).alias("empty"))


@query(r"SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS dir, lower(regexp_extract(path, '[^/]*$')) AS base, regexp_replace(lower(regexp_extract(path, '[^/]*$')), '(.)\.[^.]*$', '\1') AS stem FROM files")
def path_parts(spark, d):
    return load(spark, d, "files").select("path").distinct().select("path", P.parent("path").alias("dir"), P.basename("path").alias("base"), P.stem("path").alias("stem"))


@query("SELECT DISTINCT id FROM symbols WHERE file_path = (SELECT min(path) FROM files) AND language = (SELECT arg_min(language, path) FROM files)")
def symbols_of_file(spark, d):
    """A file asked for relative to its root, with a step back in the path and backslashes."""
    f = load(spark, d, "files").agg(F.min("path").alias("p"), F.min_by("language", "path").alias("l")).first()
    if f.p is None:
        return load(spark, d, "symbols").select("id").limit(0)
    root, rest = "/".join(f.p.split("/")[:2]), "/".join(f.p.split("/")[2:])
    return R.filter_symbols(load(spark, d, "symbols"), file_path="./x/../" + rest.replace("/", "\\"), language=f.l, root=root).select("id")


# Texts


@query(f"""WITH {_SRC}, {_SYM} SELECT id, md5(array_to_string(string_split(content, chr(10))[start_line:end_line], chr(10)) || CASE WHEN end_line < len(string_split(content, chr(10))) THEN chr(10) ELSE '' END) AS body FROM sym JOIN src ON path = file_path
WHERE start_line >= 1 AND start_line <= end_line AND end_line <= len(string_split(content, chr(10)))""")
def byte_slices(spark, d):
    """The bytes of every symbol's lines, cut from the file by offsets."""
    src = sources(spark, d)
    want = one_per_id(load(spark, d, "symbols")).filter("start_line <= end_line").select("id", F.col("file_path").alias("path"), "start_line", "end_line")
    rows = T.span_for_lines(T.line_spans(src), want).join(src.select("path", F.col("content").cast("binary").alias("raw")), "path")
    return rows.filter("start_byte IS NOT NULL AND end_byte IS NOT NULL").select("id", F.md5(T.extract_bytes("raw", "start_byte", "end_byte")).alias("body"))


@query(f"WITH {_SRC}, {_SYM} SELECT id, md5(coalesce(array_to_string(string_split(content, chr(10))[greatest(1, start_line - 2):start_line + 2], chr(10)), '')) AS around FROM sym JOIN src ON path = file_path WHERE start_line <= len(string_split(content, chr(10)))")
def context_lines(spark, d):
    rows = one_per_id(load(spark, d, "symbols")).join(sources(spark, d).select(F.col("path").alias("file_path"), "content"), "file_path").filter(F.col("start_line") <= T.line_count("content"))
    return rows.select("id", F.md5(T.context(T.split_lines("content"), "start_line", 2)).alias("around"))


@query(r"""WITH o AS (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'), ' '), '^ | $', '', 'g') AS t FROM documents)
SELECT doc_id, md5(CASE WHEN length(t) > 160 THEN rtrim(left(t, 160), ' ') || ' ...' ELSE t END) AS snippet FROM o""")
def snippets(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(T.clip(T.one_line("text"), 160)).alias("snippet"))


@query("""SELECT DISTINCT sha256(concat_ws('|', coalesce(repo_id, ''), coalesce(file_path, ''), coalesce(language, ''), coalesce(kind, ''), coalesce(fqname, ''), coalesce(start_line::VARCHAR, ''), coalesce(end_line::VARCHAR, ''))) AS symbol_hash,
  sha256(concat_ws('|', id, '1', '2', coalesce(start_line::VARCHAR, ''), coalesce(end_line::VARCHAR, ''))) AS chunk_hash FROM symbols""")
def record_ids(spark, d):
    s = load(spark, d, "symbols")
    return s.select(T.symbol_id("repo_id", "file_path", "language", "kind", "fqname", "start_line", "end_line").alias("symbol_hash"), T.chunk_id("id", F.lit(1), F.lit(2), "start_line", "end_line").alias("chunk_hash")).distinct()


_DQ, _SQ = '"""', "''''''"


@query(rf"""WITH {_SRC}, a AS (SELECT path, language, content AS c FROM src), b AS (SELECT *, strpos(c, chr(10)) AS n FROM a),
p AS (SELECT path, language, c, n, left(c, n) AS head, CASE WHEN n > 0 THEN substr(c, n + 1) ELSE '' END AS t FROM b),
q AS (SELECT *, strpos(t, '{_DQ}') AS i FROM p), r AS (SELECT *, CASE WHEN i > 0 THEN strpos(substr(t, i + 3), '{_DQ}') ELSE 0 END AS j FROM q),
s AS (SELECT *, CASE WHEN j > 0 THEN left(t, i - 1) || substr(t, i + j + 5) ELSE t END AS t2 FROM r),
u AS (SELECT *, strpos(t2, '{_SQ}') AS i2 FROM s), v AS (SELECT *, CASE WHEN i2 > 0 THEN strpos(substr(t2, i2 + 3), '{_SQ}') ELSE 0 END AS j2 FROM u),
w AS (SELECT path, CASE WHEN language = 'python' AND n > 0 THEN head || CASE WHEN j2 > 0 THEN left(t2, i2 - 1) || substr(t2, i2 + j2 + 5) ELSE t2 END ELSE c END AS code FROM v)
SELECT path, md5(left(regexp_replace(code, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g'), 4000)) AS code FROM w""")
def prepared_code(spark, d):
    """The code of every file as the audit sees it: without the first docstring of either kind, at the usual length."""
    return sources(spark, d).select("path", F.md5(T.prepare_code("content", "language")).alias("code"))


_SIG = r"""sg AS (SELECT id, trim(coalesce(signature, ''), ' ') AS s FROM sym),
sh AS (SELECT id, s, CASE WHEN contains(s, '(') AND contains(s, ')') THEN coalesce(nullif(trim(split_part(substr(s, strpos(s, '(') + 1), ')', 1), ' '), ''), '<none>') ELSE '<unknown>' END AS pa,
  CASE WHEN contains(s, '->') THEN coalesce(nullif(trim(split_part(substr(s, strpos(s, '->') + 2), ':', 1), ' '), ''), '<unknown>') ELSE '<unknown>' END AS re,
  coalesce(nullif(array_to_string(list_filter(['public', 'private', 'protected', 'static', 'async', 'final', 'pub', 'export'], lambda m: contains(lower(s), m)), ', '), ''), '<none>') AS mo FROM sg),
sigs AS (SELECT id, CASE WHEN s = '' THEN 'SIGNATURE:' || chr(10) || 'RAW: <unknown>' ELSE 'SIGNATURE:' || chr(10) || 'RAW: ' || s || chr(10) || 'PARAMS: ' || pa || chr(10) || 'RETURNS: ' || re || chr(10) || 'MODIFIERS: ' || mo END AS block FROM sh)"""


@query(f"WITH {_SYM}, {_SIG} SELECT id, block FROM sigs")
def signature_blocks(spark, d):
    return one_per_id(load(spark, d, "symbols")).select("id", T.signature_block("signature").alias("block"))


_IMP = r"""im AS (SELECT path, list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')), lambda x: starts_with(x, 'import ') OR starts_with(x, 'from ') OR starts_with(x, 'use ') OR starts_with(x, 'package ') OR starts_with(x, '#include ') OR starts_with(x, 'require(')) AS l FROM src)"""


@query(rf"""WITH {_SRC}, {_SYM}, {_IMP}, b AS (SELECT id, l, lower(regexp_replace(array_to_string(string_split(content, chr(10))[greatest(1, start_line):end_line], chr(10)), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')) AS body FROM sym JOIN src ON src.path = file_path JOIN im ON im.path = file_path WHERE end_line >= start_line),
u AS (SELECT id, list_filter(l, lambda i: len(list_filter(regexp_split_to_array(lower(i), '[^a-z0-9_]+'), lambda t: length(t) > 2 AND contains(body, t))) > 0) AS used FROM b)
SELECT id, CASE WHEN len(used) > 0 THEN 'IMPORTS_IN_SCOPE:' || chr(10) || array_to_string(used[1:8], chr(10)) ELSE '' END AS scope FROM u""")
def imports_in_scope(spark, d):
    s = one_per_id(load(spark, d, "symbols")).filter("end_line >= start_line").join(sources(spark, d).select(F.col("path").alias("file_path"), "content"), "file_path")
    rows = F.slice(T.split_lines("content"), F.greatest(F.lit(1), F.col("start_line")), F.col("end_line") - F.greatest(F.lit(1), F.col("start_line")) + 1)
    s = s.withColumn("body", F.regexp_replace(F.array_join(rows, "\n"), r"^\s+|\s+$", ""))
    return s.select("id", T.imports_in_scope(T.import_lines("content"), "body").alias("scope"))


@query(r"""SELECT DISTINCT docstring, regexp_replace(trim(docstring, ' '), '^["''`]+|["''`]+$', '', 'g') AS bare, split_part(docstring, ' (', 1) AS kind_part FROM symbols WHERE docstring IS NOT NULL""")
def bare_docstrings(spark, d):
    s = load(spark, d, "symbols").select("docstring").filter("docstring IS NOT NULL").distinct()
    return s.select("docstring", T.strip_quotes("docstring").alias("bare"), T.warning_type("docstring").alias("kind_part"))


@query(r"""SELECT DISTINCT fqname, array_to_string(list_filter(string_split(replace(fqname, '.', '::'), '::'), lambda x: x <> ''), '/') AS parts, regexp_matches(lower(name), '^test(_|$)') AS test_name, regexp_extract(name, '[^.:#]*$') AS tail, name FROM symbols WHERE fqname IS NOT NULL""")
def name_parts(spark, d):
    from tessera.functions.hints import tails  # noqa: F401  # the same rule, on the driver

    s = load(spark, d, "symbols").select("fqname", "name").filter("fqname IS NOT NULL").distinct()
    return s.select("fqname", F.array_join(T.cpp_parts(F.expr("replace(fqname, '.', '::')")), "/").alias("parts"), P.is_test_name("name").alias("test_name"), F.regexp_extract("name", "[^.:#]*$", 0).alias("tail"), "name")


@query(f"WITH {_SRC} SELECT path, contains(left(content, 100), 'import') AS zero, false AS text FROM src")
def binary_test(spark, d):
    """A NUL byte is put before the texts that begin with an import; those count as binary."""
    s = sources(spark, d).withColumn("marked", F.left("content", F.lit(100)).contains("import"))
    with_nul = F.concat(F.when(F.col("marked"), F.lit("a\x00")).otherwise(F.lit("a")), "content").cast("binary")
    return s.select("path", T.looks_binary(with_nul).alias("zero"), T.looks_binary(F.col("content").cast("binary")).alias("text"))


@query("""SELECT sha256('{"workspace":"' || repo_id || '","schema":2,"profile":"mini-64"}') AS fingerprint, count(*) AS n FROM symbols WHERE repo_id IS NOT NULL GROUP BY repo_id""")
def fingerprints(spark, d):
    s = load(spark, d, "symbols").filter("repo_id IS NOT NULL").groupBy("repo_id").agg(F.count("*").alias("n"))
    return s.select(T.fingerprint(F.struct(F.col("repo_id").alias("workspace"), F.lit(2).alias("schema"), F.lit("mini-64").alias("profile"))).alias("fingerprint"), "n")


@query("""WITH n AS (SELECT DISTINCT lower(name) AS t FROM symbols WHERE regexp_full_match(name, '[A-Za-z0-9_]+')), c AS (SELECT t, i, sha256(encode(t) || from_hex(lpad(to_hex(i), 8, '0'))) AS h FROM n, range(32) r(i)),
v AS (SELECT t, i * 8 + k AS dim, ('0x' || substr(h, CAST(k * 8 + 1 AS BIGINT), 8))::BIGINT::DOUBLE / 4294967295 * 2 - 1 AS x FROM c, range(8) s(k)), z AS (SELECT t, sqrt(sum(x * x)) AS norm FROM v GROUP BY t)
SELECT t AS name, round(max(x / norm) FILTER (dim = 0), 9) AS first, round(max(x / norm) FILTER (dim = 255), 9) AS last, round(max(x / norm), 9) AS most FROM v JOIN z USING (t) GROUP BY t""")
def name_embeddings(spark, d):
    """The hash embedding of single tokens."""
    n = load(spark, d, "symbols").filter(F.col("name").rlike("^[A-Za-z0-9_]+$")).select(F.lower("name").alias("name")).distinct().withColumn("v", V.hash_embedding("name"))
    return n.select("name", F.round(F.col("v")[0], 9).alias("first"), F.round(F.col("v")[255], 9).alias("last"), F.round(F.array_max("v"), 9).alias("most"))


@query("SELECT event_id, CAST(greatest(0, least(1, value / 50)) AS DOUBLE) AS score FROM events")
def clamped(spark, d):
    return load(spark, d, "events").select("event_id", V.clamp(F.col("value") / 50).alias("score"))


# Metrics


@query(f"""WITH {_SYM}, e AS (SELECT file_path AS case_id, list(DISTINCT name) AS expected, max(language) AS l FROM sym WHERE file_path IS NOT NULL GROUP BY 1), a AS (SELECT file_path AS case_id, list(DISTINCT name) AS got FROM sym WHERE signature IS NOT NULL AND lower(trim(kind)) <> 'class' GROUP BY 1),
x AS (SELECT case_id, list_sort(list_filter(expected, lambda n: NOT list_contains(coalesce(got, []), n))) AS missing, list_sort(list_filter(['lookup', 'main'], lambda n: list_contains(coalesce(got, []), n))) AS bad, l = 'go' AS known FROM e LEFT JOIN a USING (case_id))
SELECT case_id, array_to_string(missing, ',') AS missing, array_to_string(bad, ',') AS forbidden_found, CASE WHEN len(missing) = 0 AND len(bad) = 0 THEN 'pass' WHEN known THEN 'gap' ELSE 'fail' END AS status FROM x""")
def capability_check(spark, d):
    """Per file: names that should have been found against those found without classes; Go is a known gap."""
    s = one_per_id(load(spark, d, "symbols")).filter("file_path IS NOT NULL")
    want = s.groupBy(F.col("file_path").alias("case_id")).agg(F.collect_set("name").alias("expected"), (F.max("language") == "go").alias("known_gap")).withColumn("forbidden", F.array(F.lit("lookup"), F.lit("main")))
    got = s.filter("signature IS NOT NULL AND lower(trim(kind)) <> 'class'").select(F.col("file_path").alias("case_id"), "name")
    return M.capability_check(want, got).select("case_id", F.array_join("missing", ",").alias("missing"), F.array_join("forbidden_found", ",").alias("forbidden_found"), "status")


@query("""WITH r AS (SELECT event_type AS metric, round(sum(value) FILTER (event_id % 2 = 0), 4) AS current, round(sum(value) FILTER (event_id % 2 = 1), 4) AS baseline FROM events GROUP BY 1)
SELECT metric, round(current - baseline, 4) AS delta, round((current - baseline) / baseline * 100, 4) AS delta_pct, CASE WHEN current = baseline THEN 'unchanged' WHEN current < baseline THEN 'improved' ELSE 'regressed' END AS verdict FROM r""")
def run_comparison(spark, d):
    e = load(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.sum(F.when(F.col("event_id") % 2 == 0, F.col("value"))), 4).alias("current"), F.round(F.sum(F.when(F.col("event_id") % 2 == 1, F.col("value"))), 4).alias("baseline"))
    return M.comparison(e, higher_is_better=False).select("metric", F.round("delta", 4).alias("delta"), F.round("delta_pct", 4).alias("delta_pct"), "verdict")


@query(f"""WITH {_AUD} SELECT file_path AS key, count(*) AS n FROM aud WHERE kind IN ('function', 'class', 'interface') AND file_path <> '' GROUP BY 1 ORDER BY n DESC, key LIMIT 10""")
def audit_top_files(spark, d):
    from tessera.operators import audit as A

    s = load(spark, d, "symbols")
    return M.top_files(M.warning_summary(A.audit(s), s.select(F.col("id").alias("symbol_id"), "file_path")), 10)


@query("""WITH c AS (SELECT DISTINCT edge_type AS context FROM edges), f AS (SELECT DISTINCT file_path AS path FROM edges WHERE file_path IS NOT NULL)
SELECT DISTINCT split_part(edge_type, '|', 1) AS test_id, file_path AS path, line FROM edges WHERE edge_type <> 'IMPORTS' AND contains(file_path, '/src/') AND line IS NOT NULL""")
def coverage_contexts(spark, d):
    """The three tables of a coverage database, made from edges: a context per type of edge, imports without one, only files of src known."""
    e = load(spark, d, "edges").filter("line IS NOT NULL")
    contexts = e.select(F.xxhash64("edge_type").alias("id"), F.when(F.col("edge_type") == "IMPORTS", "").otherwise(F.concat("edge_type", F.lit("|run"))).alias("context")).distinct()
    files = e.select(F.xxhash64("file_path").alias("id"), F.col("file_path").alias("path")).filter(F.col("path").contains("/src/")).distinct()
    lines = e.select(F.xxhash64("file_path").alias("file_id"), F.xxhash64("edge_type").alias("context_id"), "line").distinct()
    return W.import_contexts(contexts, files, lines)


_CONTEXT = f"""{_SYM}, near_ AS (SELECT a.id AS symbol_id, count(*) AS n FROM sym a JOIN sym b ON a.file_path = b.file_path AND a.id <> b.id WHERE greatest(0, b.start_line - a.end_line, a.start_line - b.end_line) <= 5 GROUP BY 1)"""


@query(f"""WITH {_CONTEXT} SELECT id AS symbol_id, coalesce(len(covered_by), 0) AS n_tests, CASE WHEN len(covered_by) > 0 THEN 'low' ELSE 'high' END AS risk, coalesce(near_.n, 0) AS impact_count FROM sym LEFT JOIN near_ ON symbol_id = id""")
def agent_context(spark, d):
    return U.agent_context(load(spark, d, "symbols")).select("symbol_id", F.size("context.constraining_tests").cast("long").alias("n_tests"), "context.risk", "context.impact_count")


# Retrieval


@query(f"""WITH {_QUALITY}, s AS (SELECT query_id, backend, CASE backend WHEN 'exact' THEN 0.50 + 0.30 * avg(ov) ELSE 0.42 + 0.35 * avg(ov) + 0.23 END AS support FROM o GROUP BY query_id, backend),
w AS (SELECT query_id, backend, support, de, 0.55 * quality + 0.20 * de + 0.15 * support + 0.10 AS raw, quality >= CASE backend WHEN 'exact' THEN 0.70 ELSE 0.68 END AS met FROM (SELECT query_id, backend, quality, least(1, n / 12) AS de FROM qu) JOIN s USING (query_id, backend))
SELECT query_id, backend, round(support, 6) AS support, round(greatest(0, least(1, raw * CASE WHEN met THEN 1.0 ELSE 0.65 END)), 6) AS weight FROM w""")
def hybrid_weights(spark, d):
    return X.weights(X.backend_quality(*_hits(spark, d))).select("query_id", "backend", F.round("support", 6).alias("support"), F.round("weight", 6).alias("weight"))


@query(rf"""WITH {_HITS}, l AS (SELECT * FROM hits WHERE backend = 'exact'), z AS (SELECT *, {_SOURCE} AS s, {_TEST} AS t, r - 1 AS idx FROM l),
b AS (SELECT query_id, min((-raw_score, CASE WHEN 'reference' = 'definition' THEN 0 ELSE 1 END, idx, path)) FILTER (s AND NOT t) AS best FROM z GROUP BY 1),
x AS (SELECT z.*, best, list_distinct(list_filter(string_split(lower(best[4]), '/'), lambda y: y NOT IN ('', '.', 'src', 'tests', 'test', 'python', 'lib'))) AS u, list_distinct(list_filter(string_split(lower(path), '/'), lambda y: y NOT IN ('', '.', 'src', 'tests', 'test', 'python', 'lib'))) AS v,
  regexp_replace(regexp_extract(lower(best[4]), '[^/]*$'), '(.)\.[^.]*$', '\1') AS sa, regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(path), '[^/]*$'), '(.)\.[^.]*$', '\1'), '^test_', ''), '_test$', '') AS sb FROM z LEFT JOIN b USING (query_id)),
y AS (SELECT *, CASE WHEN t AND best IS NOT NULL THEN len(list_intersect(u, v)) + CASE WHEN sa = '' THEN 0 WHEN sa = sb THEN 3 WHEN contains(sb, sa) THEN 2 ELSE 0 END END AS rel FROM x),
g AS (SELECT query_id, max((rel, raw_score, -idx)) FILTER (rel > 0) AS test FROM y GROUP BY 1)
SELECT query_id, path, start_line, snippet, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN test IS NULL THEN 2 WHEN idx = best[3] THEN 0 WHEN rel = test[1] AND raw_score = test[2] AND -idx = test[3] THEN 1 ELSE 2 END, idx) - 1 AS INTEGER) AS new_idx FROM y JOIN g USING (query_id)""")
def mixed_rebalance(spark, d):
    hits, q = _hits(spark, d)
    return X.rebalance(hits.filter("backend = 'exact'"), q).select("query_id", "path", "start_line", "snippet", "new_idx")


def _over(path: str, a: str, b: str, x: str) -> str:
    return f"{x}.path = {path} AND NOT ({x}.e < {a} OR {b} < {x}.s)"


_PACK = f"""o AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, path, start_line, r, backend) AS k, {{'path': path, 's': start_line, 'e': end_line, 'snippet': snippet, 'raw': raw_score, 'backend': backend, 'role': 'reference'}} AS h FROM hits),
f AS (SELECT query_id, 1::BIGINT AS k, [h] AS kept FROM o WHERE k = 1 UNION ALL
  SELECT f.query_id, f.k + 1, CASE WHEN p IS NULL THEN list_append(kept, h)
    WHEN h.e - h.s < kept[p].e - kept[p].s OR (h.e - h.s = kept[p].e - kept[p].s AND h.raw > kept[p].raw) THEN list_transform(kept, lambda x, i: CASE WHEN i = p THEN h ELSE x END) ELSE kept END
  FROM (SELECT f.query_id, f.k, f.kept, o.h, list_position(list_transform(f.kept, lambda x: {_over("o.h.path", "o.h.s", "o.h.e", "x")}), true) AS p FROM f JOIN o ON o.query_id = f.query_id AND o.k = f.k + 1) f),
last_ AS (SELECT query_id, arg_max(kept, k) AS kept FROM f GROUP BY 1), u AS (SELECT query_id, unnest(kept) AS h, generate_subscripts(kept, 1) - 1 AS idx FROM last_),
t AS (SELECT *, max(h.raw) OVER (PARTITION BY query_id, h.path) AS top FROM u),
fr AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY top DESC, h.path) AS fr, row_number() OVER (PARTITION BY query_id, h.path ORDER BY h.raw DESC, h.s, idx) AS turn FROM t),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, fr) AS rank FROM fr WHERE fr <= 8),
us AS (SELECT *, sum(length(h.path) + length(h.snippet)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM rk WHERE rank <= 12),
packed AS (SELECT query_id, rank, h.backend AS backend, h.path AS path, h.s AS start_line, h.e AS end_line, h.snippet AS snippet, h.raw AS raw_score, h.role AS match_role FROM us WHERE rank = 1 OR used <= 12000)"""


@query(f"WITH RECURSIVE {_HITS}, {_PACK} SELECT * FROM packed")
def pack_round_robin(spark, d):
    return X.pack(_hits(spark, d)[0]).drop("tags").withColumn("rank", F.col("rank").cast("long"))


_PREFIX = r"""pt AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS nt FROM packed WHERE rank <= 4),
pf AS (SELECT query_id, path AS p, count(*) AS n FROM pt WHERE nt >= 2 GROUP BY ALL), pd AS (SELECT query_id, regexp_replace(path, '/?[^/]*$', '') AS p, count(*) AS n FROM pt WHERE nt >= 2 GROUP BY ALL),
px AS (SELECT query_id, arg_min(p, (-n, p)) AS p FROM pf WHERE n >= 2 GROUP BY 1), py AS (SELECT query_id, arg_min(p, (-n, p)) AS p FROM pd WHERE n >= 2 AND p NOT IN ('', '.') GROUP BY 1),
prefixes AS (SELECT query_id, coalesce(px.p, py.p) AS prefix FROM px FULL JOIN py USING (query_id))"""


@query(f"WITH RECURSIVE {_HITS}, {_PACK}, {_PREFIX} SELECT query_id, prefix FROM prefixes")
def suggested_prefixes(spark, d):
    return X.suggested_prefix(X.pack(_hits(spark, d)[0]))


@query(rf"""WITH RECURSIVE {_QUALITY.replace("ex AS", "ex AS", 1)}, {_PACK.replace("o AS (SELECT query_id", "o_ AS (SELECT query_id").replace("FROM o WHERE", "FROM o_ WHERE").replace("JOIN o ON o.query_id = f.query_id AND o.k", "JOIN o_ o ON o.query_id = f.query_id AND o.k")}, {_PREFIX},
bq AS (SELECT query_id, backend, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, backend) AS i FROM qu WHERE quality >= CASE backend WHEN 'exact' THEN 0.70 ELSE 0.68 END),
rt AS (SELECT ex.name AS query_id, CASE WHEN bq.backend IS NOT NULL THEN bq.backend WHEN NOT EXISTS (SELECT 1 FROM qu WHERE query_id = ex.name) THEN 'suppressed' ELSE 'hybrid' END AS strategy FROM ex LEFT JOIN bq ON bq.query_id = ex.name AND bq.i = 1),
dh AS (SELECT query_id, count(*) AS n_hits, max((path, raw_score)) FILTER (rank = 1) AS a, max((path, raw_score)) FILTER (rank = 2) AS b FROM packed GROUP BY 1),
dd AS (SELECT rt.query_id, strategy, coalesce(n_hits, 0) AS n_hits, prefix, coalesce(strategy IN ('exact', 'symbol') AND n_hits > 0 AND CASE WHEN NOT {_SOURCE.replace("path", "a[1]")} OR {_TEST.replace("path", "a[1]")} THEN false WHEN n_hits = 1 THEN a[2] >= 0.93 ELSE a[1] = b[1] AND a[2] >= 0.92 AND round(a[2] - b[2], 9) >= 0.08 END, false) AS decisive
  FROM rt LEFT JOIN dh USING (query_id) LEFT JOIN prefixes USING (query_id))
SELECT query_id, strategy, n_hits, decisive, CASE WHEN decisive THEN 'open_hit_1' WHEN prefix IS NOT NULL THEN 'narrow_by_path' ELSE 'refine_query' END AS next_action, CASE WHEN NOT decisive THEN prefix END AS suggested_prefix,
  CASE WHEN strategy = 'suppressed' THEN 'suppressed' WHEN n_hits = 0 THEN 'no_match' WHEN decisive THEN 'decisive' ELSE 'ambiguous' END AS status FROM dd""")
def decisions(spark, d):
    hits, q = _hits(spark, d)
    quality = X.backend_quality(hits, q)
    return X.decide(X.pack(hits), X.route(quality, q), quality, q)


@query(f"""WITH {_SYM}, c AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY chunk_part_index, start_line, chunk_id) AS i FROM chunks WHERE symbol_id IS NOT NULL)
SELECT s.id, c.chunk_id FROM sym s JOIN c ON c.symbol_id = s.id AND c.i = 1 WHERE s.fqname = (SELECT min(fqname) FROM symbols WHERE fqname <> '') ORDER BY s.file_path, s.start_line, s.id LIMIT 10""")
def by_fqname(spark, d):
    s = load(spark, d, "symbols")
    name = s.filter("fqname <> ''").agg(F.min("fqname").alias("f")).first().f
    return S.structured(s, load(spark, d, "chunks"), F.col("fqname") == name, 10).select("id", "chunk_id")


@query(f"""WITH {_SYM}, w AS (SELECT c.chunk_id, c.symbol_id, c.end_line + 1 AS end_line, c.start_line FROM (SELECT DISTINCT ON (chunk_id, symbol_id) chunk_id, symbol_id, start_line, end_line FROM chunks WHERE symbol_id IS NOT NULL AND chunk_part_total > 0 ORDER BY chunk_id, symbol_id, start_line, end_line) c)
SELECT chunk_id, symbol_id, 'outside' AS problem FROM w JOIN sym s ON s.id = symbol_id WHERE w.start_line < s.start_line OR w.end_line > s.end_line""")
def chunk_spans_moved(spark, d):
    """Chunks that end a line later than they should: those that leave their symbols are reported."""
    c = load(spark, d, "chunks").filter("chunk_part_total > 0").withColumn("end_line", F.col("end_line") + 1)
    c = c.groupBy("chunk_id", "symbol_id").agg(F.min(F.struct("start_line", "end_line", "chunk_part_index")).alias("r")).select("chunk_id", "symbol_id", "r.*")
    return C.span_violations(load(spark, d, "symbols"), c).filter("problem = 'outside'")
