"""Queries over whole paths of the engine (chunks, edges, searches, contracts, change streams), with their SQL, and SQL of such queries defined elsewhere."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import grep_compat
from tessera.functions import hints as H
from tessera.functions import text as T
from tessera.operators import contracts as K
from tessera.operators import coverage as V
from tessera.operators import fusion as X
from tessera.operators import relations as R
from tessera.plans.index_queries import _COV, _LINES, _SRC, _SYM, _coverage, sources
from tessera.plans.relation_queries import _IMP, _OCC, _SIG
from tessera.plans.relation_queries import SQL as _RELATION_SQL
from tessera.plans.search_queries import _DEF, _HITS, _IMP as _IMPORT_LINE, _SOURCE, _TEST, _hits
from tessera.runtime import Scratch, load
from tessera.sources import parse as PA
from tessera.streaming import watch as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STRIP = r"'^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g'"
_WORDS = ", ".join(f"'{w}'" for w in T.REFERENCE_KEYWORDS)

# A symbol's text is its head, signature, imports in scope and body; one over 12,000 bytes is packed line by line, which the recursion folds.
SQL["chunks_build"] = rf"""WITH RECURSIVE {_SRC}, {_SYM}, {_SIG}, {_IMP},
b AS (SELECT sym.id, name, kind, fqname, file_path, start_line, end_line, block, l, string_split(content, chr(10))[greatest(1, start_line):end_line] AS ls FROM sym JOIN src ON src.path = file_path JOIN im ON im.path = file_path JOIN sigs ON sigs.id = sym.id WHERE start_line IS NOT NULL AND end_line IS NOT NULL),
c AS (SELECT *, regexp_replace(coalesce(array_to_string(ls, chr(10)), ''), {_STRIP}) AS body FROM b),
d AS (SELECT *, list_filter(l, lambda i: len(list_filter(regexp_split_to_array(lower(i), '[^a-z0-9_]+'), lambda t: length(t) > 2 AND contains(lower(body), t))) > 0) AS used FROM c),
e AS (SELECT *, trim('FQNAME: ' || coalesce(nullif(fqname, ''), name) || chr(10) || 'KIND: ' || kind || chr(10) || 'FILE: ' || file_path || chr(10) || 'LINES: ' || start_line || '-' || end_line || chr(10) || chr(10) || block
  || CASE WHEN len(used) > 0 THEN chr(10) || chr(10) || 'IMPORTS_IN_SCOPE:' || chr(10) || array_to_string(used[1:8], chr(10)) ELSE '' END, ' ') AS prefix FROM d),
f AS (SELECT *, regexp_replace(prefix || chr(10) || chr(10) || 'BODY:' || CASE WHEN body <> '' THEN chr(10) || chr(10) || body ELSE '' END, {_STRIP}) AS whole FROM e),
big AS (SELECT id, ls, octet_length(encode(prefix)) + 9 AS fixed FROM f WHERE octet_length(encode(whole)) > 12000 AND len(ls) > 0),
r AS (SELECT id, ls, fixed, 1::BIGINT AS j, 1::BIGINT AS i FROM big UNION ALL
  SELECT id, ls, fixed, j + 1, CASE WHEN octet_length(encode(regexp_replace(array_to_string(ls[i:j + 1], chr(10)), {_STRIP}))) + fixed > 12000 THEN j + 1 ELSE i END FROM r WHERE j < len(ls)),
cut AS (SELECT id, i, max(j) AS j, row_number() OVER (PARTITION BY id ORDER BY i) AS part, count(*) OVER (PARTITION BY id) AS total FROM r GROUP BY id, i),
p AS (SELECT f.id, file_path, prefix, coalesce(part, 1) AS part, coalesce(total, 1) AS total, start_line + coalesce(i, 1) - 1 AS first, CASE WHEN len(ls) = 0 OR ls IS NULL THEN start_line ELSE start_line + coalesce(j, len(ls)) - 1 END AS last,
  CASE WHEN part IS NULL THEN body ELSE regexp_replace(array_to_string(ls[i:j], chr(10)), {_STRIP}) END AS t FROM f LEFT JOIN cut ON cut.id = f.id),
sp AS (SELECT path, line, octet_length(encode(text)) + 1 AS n, octet_length(encode(content)) AS total FROM (SELECT path, content, generate_subscripts(l, 1) AS line, unnest(l) AS text FROM (SELECT path, content, string_split(content, chr(10)) AS l FROM src))),
by_ AS (SELECT path, line, CAST(sum(n) OVER w - n AS BIGINT) AS s, CAST(least(sum(n) OVER w, total) AS BIGINT) AS e FROM sp WINDOW w AS (PARTITION BY path ORDER BY line)),
x AS (SELECT *, regexp_replace(prefix || chr(10) || chr(10) || 'BODY:' || CASE WHEN t <> '' THEN chr(10) || chr(10) || t ELSE '' END, {_STRIP}) AS text FROM p)
SELECT sha256(concat_ws('|', id, part::VARCHAR, total::VARCHAR, first::VARCHAR, last::VARCHAR)) AS chunk_id, id AS symbol_id, CAST(part AS INTEGER) AS chunk_part_index, CAST(total AS INTEGER) AS chunk_part_total, CAST(first AS INTEGER) AS start_line, CAST(last AS INTEGER) AS end_line,
  a.s AS start_byte, z.e AS end_byte, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS tokens_estimate, md5(text) AS text_md5
FROM x LEFT JOIN by_ a ON a.path = file_path AND a.line = first LEFT JOIN by_ z ON z.path = file_path AND z.line = last"""



def _edges_sql() -> str:
    from tessera.plans.index_queries import SQL as S

    imports = S["import_targets"]
    own = imports[imports.index(", l AS (") + 2 :]
    head, select = own[: own.index("\nSELECT")], own[own.index("\nSELECT") :]
    return rf"""WITH {_SRC}, {_SYM}, {_LINES}, {head}, imp AS ({select}),
fr AS (SELECT file_path AS path, min(repo_id) AS repo_id, min(commit_hash) AS commit_hash FROM sym GROUP BY 1),
tok AS (SELECT s.*, unnest(list_sort(list_distinct(list_filter(regexp_extract_all(array_to_string(string_split(content, chr(10))[greatest(1, start_line):end_line], chr(10)), '[A-Za-z_][A-Za-z0-9_]*'), lambda x: length(x) >= 3 AND lower(x) NOT IN ({_WORDS}) AND x IS DISTINCT FROM s.name)))[1:25]) AS t FROM sym s JOIN src ON path = file_path),
rf AS (
  SELECT 2 AS ord, 'CALLS' AS edge_type, id AS own_id, kind AS own_kind, file_path, start_line AS line, repo_id, commit_hash, c AS target, NULL AS reference, container_fqname AS cf FROM (SELECT *, unnest(calls) AS c FROM sym) WHERE c IS NOT NULL
  UNION ALL SELECT 3, 'REFERENCES', id, kind, file_path, start_line, repo_id, commit_hash, t, NULL, container_fqname FROM tok
  UNION ALL SELECT 4, 'TESTS', id, kind, file_path, start_line, repo_id, commit_hash, string_split(string_split(trim(r), ':')[-1], '.')[-1], r, NULL FROM (SELECT DISTINCT id, kind, file_path, start_line, repo_id, commit_hash, unnest(covered_by) AS r FROM sym) WHERE r IS NOT NULL
  UNION ALL SELECT 5, 'IMPORTS', 'file:' || sha256(repo_id || '|' || path), 'file', path, line, repo_id, commit_hash, target, NULL, NULL FROM imp JOIN fr USING (path)),
fq AS (SELECT fqname AS key, max((file_path, start_line, end_line, id, kind)) AS r FROM sym WHERE fqname <> '' GROUP BY 1),
here AS (SELECT name, file_path, min((file_path, start_line, id, kind)) AS r FROM sym GROUP BY ALL),
nm AS (SELECT name, count(*) AS n, min((file_path, start_line, id, kind)) AS r FROM sym GROUP BY ALL),
rs AS (SELECT rf.*, CASE WHEN t = '' THEN 'unresolved:<empty>' WHEN a.key IS NOT NULL THEN a.r[4] WHEN b.key IS NOT NULL THEN b.r[4] WHEN nm.n = 1 THEN nm.r[3] WHEN here.name IS NOT NULL THEN here.r[3] WHEN nm.name IS NOT NULL THEN nm.r[3] ELSE 'unresolved:' || t END AS to_id,
  CASE WHEN t = '' THEN 'unresolved' WHEN a.key IS NOT NULL THEN a.r[5] WHEN b.key IS NOT NULL THEN b.r[5] WHEN nm.n = 1 THEN nm.r[4] WHEN here.name IS NOT NULL THEN here.r[4] WHEN nm.name IS NOT NULL THEN nm.r[4] ELSE 'unresolved' END AS to_kind,
  CASE WHEN t = '' THEN 0.15 WHEN a.key IS NOT NULL THEN 0.95 WHEN b.key IS NOT NULL THEN 0.9 WHEN nm.n = 1 THEN CASE WHEN nm.r[1] = rf.file_path THEN 0.85 ELSE 0.75 END WHEN here.name IS NOT NULL THEN 0.65 WHEN nm.name IS NOT NULL THEN 0.45 ELSE 0.15 END AS conf
  FROM (SELECT *, trim(target, ' ' || chr(9) || chr(10)) AS t FROM rf) rf LEFT JOIN fq a ON a.key = t LEFT JOIN fq b ON b.key = cf || '.' || t AND cf <> '' LEFT JOIN here ON here.name = string_split(t, '.')[-1] AND here.file_path = rf.file_path LEFT JOIN nm ON nm.name = string_split(t, '.')[-1]),
ts AS (SELECT rs.*, i.id AS i_id, i.kind AS i_kind, f.r AS f_r, trim(reference) AS tr FROM rs LEFT JOIN sym i ON i.id = trim(reference) LEFT JOIN fq f ON f.key = trim(reference) WHERE edge_type = 'TESTS'),
al AS (
  SELECT 0 AS ord, 'DEFINES' AS edge_type, 'file:' || sha256(repo_id || '|' || file_path) AS from_id, id AS to_id, kind AS to_kind, file_path, start_line AS line, 1.0 AS confidence, repo_id FROM sym
  UNION ALL SELECT 1, 'CONTAINS', container_id, id, kind, file_path, start_line, 1.0, repo_id FROM sym WHERE container_id <> ''
  UNION ALL SELECT ord, edge_type, own_id, to_id, to_kind, file_path, line, CASE edge_type WHEN 'REFERENCES' THEN least(conf, 0.45) WHEN 'IMPORTS' THEN greatest(conf, 0.2) ELSE conf END, repo_id FROM rs WHERE edge_type <> 'TESTS' AND (edge_type <> 'REFERENCES' OR to_id <> own_id)
  UNION ALL SELECT ord, edge_type, CASE WHEN tr = '' THEN 'unresolved:<empty>' WHEN i_id IS NOT NULL THEN i_id WHEN f_r IS NOT NULL THEN f_r[4] WHEN to_kind = 'unresolved' THEN 'unresolved:' || tr ELSE to_id END, own_id, own_kind, file_path, line,
    CASE WHEN tr = '' THEN 0.2 WHEN i_id IS NOT NULL THEN 0.95 WHEN f_r IS NOT NULL THEN 0.9 WHEN to_kind = 'unresolved' THEN 0.25 ELSE greatest(conf, 0.6) END, repo_id FROM ts),
g AS (SELECT edge_type, from_id, to_id, file_path, CAST(line AS INTEGER) AS line, arg_min((CAST(confidence AS DOUBLE), repo_id), (ord, -confidence, to_kind)) AS z FROM al GROUP BY ALL)
SELECT sha256(concat_ws('|', z[2], edge_type, from_id, to_id, file_path, line::VARCHAR)) AS edge_id, edge_type, from_id, to_id, file_path, line, z[1] AS confidence,
  printf('EDGE_TYPE: %s' || chr(10) || 'FROM: %s' || chr(10) || 'TO: %s' || chr(10) || 'FILE: %s' || chr(10) || 'LINE: %d' || chr(10) || 'CONFIDENCE: %.3f', edge_type, from_id, to_id, file_path, line, z[1]) AS text FROM g"""


SQL["edges_extract"] = _edges_sql()

_CLIP = "CASE WHEN length(trim(text, ' ')) > 320 THEN rtrim(left(trim(text, ' '), 320), ' ') || ' ...' ELSE trim(text, ' ') END AS snippet"
_DOCS = r"(contains(lower(path), '/docs/') OR contains(lower(path), '/doc/') OR starts_with(lower(path), 'docs/') OR regexp_matches(regexp_replace(regexp_extract(lower(path), '[^/]*$'), '(.)\.[^.]*$', '\1'), 'readme|changelog|changes|history|news|release-notes'))"


def _exact(patterns: list[str], rest: str, out: str) -> str:
    """SQL of exact hits: which patterns a line has, its role, and per file how many patterns and whether there is a definition."""
    has = ", ".join(f"regexp_matches(text, '{p}')::INT AS p{i}" for i, p in enumerate(patterns))
    total = " + ".join(f"p{i}" for i in range(len(patterns)))
    infile = " + ".join(f"max(p{i}) OVER w" for i in range(len(patterns)))
    named = "|".join(rest.split())
    return rf"""WITH {_SRC}, {_LINES}, h AS (SELECT path, line, text, {has} FROM lines_),
m AS (SELECT *, {total} AS on_line, {_SOURCE} AS s, {_TEST} AS t, {_DOCS} AS dx, CASE WHEN regexp_matches(text, {_DEF}) THEN 0.10 ELSE 0 END AS kw, regexp_replace(path, '/[^/]*$', '') AS dir,
  CASE WHEN {_DOCS} THEN 'auxiliary' WHEN regexp_matches(text, {_IMPORT_LINE}) THEN 'import' WHEN regexp_matches(text, {_DEF}) AND regexp_matches(text, '(^|[^A-Za-z0-9_])({named})($|[^A-Za-z0-9_])') THEN 'definition' ELSE 'reference' END AS r0 FROM h WHERE {total} > 0),
f AS (SELECT *, {infile} AS in_file, CASE WHEN bool_or(r0 = 'definition') OVER w AND r0 = 'reference' THEN 'same_file_context' ELSE r0 END AS role FROM m WINDOW w AS (PARTITION BY path)),
{out}"""


SQL["exact_search_topk"] = _exact(
    ["registry", "order", "tuple"], "registry order tuple",
    f"""g AS (SELECT *, greatest(0, least(1, 0.9 + kw + CASE WHEN s THEN 0.14 ELSE 0 END - CASE WHEN dx THEN 0.08 ELSE 0 END - CASE WHEN t THEN 0.01 ELSE 0 END)) AS raw FROM f),
best AS (SELECT max((in_file, raw, dir))[3] AS dir FROM g), near_ AS (SELECT dir FROM g GROUP BY dir HAVING count(*) >= 2 AND dir = (SELECT dir FROM best)),
z AS (SELECT *, round(greatest(0, least(1, raw + least(0.16, 0.05 * (in_file - 1)) + least(0.08, 0.03 * (on_line - 1)) + CASE WHEN role = 'import' THEN -0.12 WHEN role = 'definition' AND NOT t THEN -0.02 ELSE 0 END
  + CASE WHEN role IN ('reference', 'same_file_context') AND s AND NOT t THEN 0.03 ELSE 0 END + CASE WHEN t THEN 0.04 ELSE 0 END + CASE WHEN s OR t THEN 0.01 ELSE 0 END + CASE WHEN dir IN (FROM near_) THEN 0.02 ELSE 0 END)), 6) AS score FROM g)
SELECT path, CAST(line AS INTEGER) AS start_line, CAST(line AS INTEGER) AS end_line, {_CLIP}, CAST(score AS DOUBLE) AS raw_score, role AS match_role FROM z ORDER BY score DESC, path, line LIMIT 24""")  # fmt: skip
SQL["exact_search_declaration"] = _exact(
    ["Registry"], "Registry registry",
    f"""z AS (SELECT *, round(greatest(0, least(1, 0.9 + kw + CASE WHEN s THEN 0.08 ELSE 0 END - CASE WHEN dx THEN 0.08 ELSE 0 END - CASE WHEN t THEN 0.05 ELSE 0 END)), 6) AS score,
  list_position(['definition', 'same_file_context', 'reference', 'import', 'auxiliary'], role) AS pr FROM f), k AS (SELECT * FROM z ORDER BY pr, score DESC, path, line LIMIT 24)
SELECT path, CAST(line AS INTEGER) AS start_line, CAST(line AS INTEGER) AS end_line, {_CLIP}, CAST(score AS DOUBLE) AS raw_score, role AS match_role FROM k WHERE role = 'definition' OR NOT EXISTS (SELECT 1 FROM k WHERE role = 'definition')""")  # fmt: skip
SQL["symbol_search_topk"] = rf"""WITH {_SRC}, {_LINES}, {_OCC},
m AS (SELECT *, lower(symbol) AS n, CASE WHEN {_SOURCE} THEN 1.0 WHEN {_TEST} THEN 0.82 ELSE 0.66 END AS ds FROM occ),
b AS (SELECT *, CASE WHEN n = 'registry' THEN 1.0 WHEN contains(n, 'registry') OR contains('registry', n) THEN 0.74 ELSE 0 END AS base FROM m),
z AS (SELECT *, round(greatest(0, least(1, greatest(0, least(1, base + greatest(0, ds - 0.5) * 0.08)) + least(0.06, 0.02 * (count(*) OVER (PARTITION BY path) - 1)))), 6) AS score FROM b WHERE base > 0),
top_ AS (SELECT * FROM z ORDER BY CASE WHEN kind = 'def' THEN 0 ELSE 1 END, score DESC, path, start_line, end_line, symbol LIMIT 16)
SELECT path, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, symbol, kind, CAST(score AS DOUBLE) AS raw_score FROM top_ WHERE kind = 'def' OR NOT EXISTS (SELECT 1 FROM top_ WHERE kind = 'def')"""


# Query analysis: what is expected of each query is written out by hand.
_HINTS = [
    ("def mount", "declaration", "code", "mount", "mount", "", "", False),
    ("async def parse_file", "declaration", "code", "parse_file", "parse_file", "", "", False),
    ("Session.mount", "identifier", "code", "Session.mount", "session,mount", "", "", False),
    ("parse_file", "identifier", "code", "parse_file", "parse_file", "", "", False),
    ("where is the order of tuple kept", "mixed", "code", "where,order,tuple,kept", "where,the,order,tuple,kept", "", "", False),
    ('find "HTTP error" now', "mixed", "code", "find,HTTP,now", "find,http,error,now", "HTTP error", "", False),
    ("src/app/main.py:42", "mixed", "code", "src,app,main.py:42", "src,app,main", "", "src/app/main.py", False),
    ("?? !!", "natural_language", "code", "", "", "", "", False),
    ("readme of the parser", "mixed", "docs_policy", "readme,parser", "readme,the,parser", "", "", False),
    ("backport label for stable branch", "mixed", "workflow_config", "backport,label,stable,branch", "backport,label,for,stable,branch", "", "", False),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{k}', '{d}', '{t}', '{lit}')" for q, k, d, _, t, lit, _, _ in _HINTS if "42" not in q) + ") v(query, kind, domain, tokens, literals)")
def query_hints(spark, d):
    rows = [(q, h.kind, h.domain, ",".join(h.tokens), ",".join(h.literals)) for q, h in ((x[0], H.analyze(x[0])) for x in _HINTS if "42" not in x[0])]
    return spark.createDataFrame(rows, "query string, kind string, domain string, tokens string, literals string")


@query(r"""SELECT * FROM (VALUES ('src/app/main.py:42', 'src/app/main.py:42', 'src/app/main.py', true, 'src/app/main.py 42', false, false), ('Session.mount', NULL, 'Session.mount', false, '', false, false), ('foo->bar()', NULL, '', true, '', false, false),
  ('who calls mount', NULL, '', false, '', true, false), ('tests for mount', NULL, '', false, '', false, true), ('a\b', 'a\b', '', true, '', false, false), ('mount', NULL, '', false, '', false, false)) v(query, verbatim, paths, literal_first, stack, usage, tests)""")
def query_shapes(spark, d):
    """Literals, paths, stack lines and intents of queries."""
    asked = ["src/app/main.py:42", "Session.mount", "foo->bar()", "who calls mount", "tests for mount", "a\\b", "mount"]
    rows = [(q, h.verbatim, ",".join(h.paths), h.literal_first, ",".join(f"{p} {n}" for p, n in h.stack), H.usage_intent(q), H.test_intent(q)) for q, h in ((x, H.analyze(x)) for x in asked)]
    return spark.createDataFrame(rows, "query string, verbatim string, paths string, literal_first boolean, stack string, usage boolean, tests boolean")


@query("""SELECT * FROM (VALUES ('mount src/app', 'mount', 'src/app'), ('who calls mount ./lib/', 'who calls mount', './lib'), ('src/app', 'src/app', ''), ('a b', 'a b', ''), ('mount src/app tests/x.py', 'mount', 'src/app,tests/x.py')) v(query, rest, paths)""")
def query_operands(spark, d):
    """Paths at the end of a query become its scope."""
    rows = [(q, *(lambda r: (r[0], ",".join(r[1])))(H.split_operands(q.split()))) for q in ("mount src/app", "who calls mount ./lib/", "src/app", "a b", "mount src/app tests/x.py")]
    return spark.createDataFrame(rows, "query string, rest string, paths string")


@query(r"""SELECT * FROM (VALUES ('rg -i -w foo src/', 'rg', 'foo', 'src', '', '', 'ignore', true, false, ''), ('grep -F "a b" x.py', 'grep', 'a b', 'x.py', '', '', 'sensitive', false, true, ''), ('rg -S -g "*.py" -g "!test*" Foo', 'rg', 'Foo', '', '*.py', 'test*', 'smart', false, false, ''),
  ('fgrep -n x', 'fgrep', 'x', '', '', '', 'sensitive', false, true, ''), ('rg -A 3 -e pat dir', 'rg', 'pat', 'dir', '', '', 'sensitive', false, false, ''), ('rg --strange x', 'rg', 'x', '', '', '', 'sensitive', false, false, '--strange'), ('find things', NULL, NULL, '', '', '', 'sensitive', false, false, '')) v(query, command, pattern, paths, include, exclude, cases, word, fixed, unknown)""")
def grep_commands(spark, d):
    asked = ["rg -i -w foo src/", 'grep -F "a b" x.py', 'rg -S -g "*.py" -g "!test*" Foo', "fgrep -n x", "rg -A 3 -e pat dir", "rg --strange x", "find things"]
    rows = [(q, g.command, g.pattern, ",".join(g.paths), ",".join(g.include), ",".join(g.exclude), g.case, g.word, g.fixed, ",".join(g.unknown)) for q, g in ((x, grep_compat.parse(x)) for x in asked)]
    return spark.createDataFrame(rows, "query string, command string, pattern string, paths string, include string, exclude string, cases string, word boolean, fixed boolean, unknown string")


@query(f"WITH {_SRC}, {_LINES} SELECT path, count(*) FILTER (regexp_matches(text, '(?i)registry')) AS smart_lower, count(*) FILTER (contains(text, 'Registry')) AS smart_upper, count(*) FILTER (contains(text, 'self.')) AS literal FROM lines_ GROUP BY path")
def case_modes(spark, d):
    """Smart case folds only patterns in lower case; fixed strings are no expressions."""
    has = lambda p, **k: F.count_if(F.col("text").rlike(grep_compat.java_pattern(p, **k)))
    return T.lines(sources(spark, d)).groupBy("path").agg(has("registry", case="smart").alias("smart_lower"), has("Registry", case="smart").alias("smart_upper"), has("self.", fixed=True).alias("literal"))


@query(f"WITH {_SRC} SELECT DISTINCT file_path, name, start_line, lower(trim(kind)) = 'class' AS is_class FROM symbols JOIN src ON path = file_path")
def parsed_located(spark, d):
    """The symbols that parsing finds again, by file, name, first line and whether they are classes."""
    found = PA.symbols(sources(spark, d), "repo").select("file_path", "name", "start_line", (F.col("kind") == "class").alias("is_class")).distinct()
    kind = F.lower(F.trim("kind"))
    mine = load(spark, d, "symbols").select("file_path", "name", "start_line", (kind == "class").alias("is_class")).distinct()
    return mine.join(found, ["file_path", "name", "start_line", "is_class"])


@query(f"WITH {_COV} SELECT test_id, path, line FROM cov")
def coverage_json_rows(spark, d):
    """Every row of a coverage after it was written as JSON and read again."""
    back = V.parse_context_json(V.context_json(_coverage(spark, d)).select(F.to_json(F.create_map("test_id", F.from_json("value", "map<string,array<int>>"))).alias("value")))
    return back.select("test_id", "path", "line")


@query("""WITH seen AS (SELECT path FROM file_changes GROUP BY path HAVING arg_max(op, seq) <> 'deleted')
SELECT 'symbols' AS relation, id AS key FROM symbols WHERE file_path IN (FROM seen) UNION ALL SELECT 'edges', edge_id FROM edges WHERE file_path IN (FROM seen) UNION ALL SELECT 'files', path FROM files WHERE path IN (FROM seen)""")
def stale_prune_rows(spark, d):
    seen = W.coalesce(load(spark, d, "file_changes")).filter("NOT deleted").select("path")
    kept = R.prune({t: load(spark, d, t) for t in ("symbols", "edges", "files")}, seen)
    a, b, c = (kept[t].select(F.lit(t).alias("relation"), F.col(k).alias("key")) for t, k in (("symbols", "id"), ("edges", "edge_id"), ("files", "path")))
    return a.unionByName(b).unionByName(c)


_WATCHED = r"""w AS (SELECT path, arg_max(op, seq) AS op FROM file_changes WHERE path IS NOT NULL AND regexp_matches(lower(path), '\.(py|js|jsx|ts|tsx|rs|go|java|c|h|cc|cpp|hpp)$') AND NOT lower(path) LIKE '%.min.js' GROUP BY path)"""


@query(f"""WITH {_WATCHED} SELECT path, content_hash FROM files WHERE path NOT IN (SELECT path FROM w) UNION ALL SELECT path, 'built' FROM w WHERE op <> 'deleted'""")
def watched_files(spark, d):
    """The files relation after a change stream ran over it: a store is published, the stream is read to its end, the relation is read from the last build."""
    scratch = Scratch(spark, "watched")
    store = R.Store(spark, f"{scratch.root}/store", buckets=8)
    store.publish(store.stage({"files": R.conform(load(spark, d, "files"), "files")}, "start"))
    changes = spark.readStream.schema(load(spark, d, "file_changes").schema).parquet(f"{d}/file_changes.parque[t]")  # a pattern, so that one file will do
    build = lambda paths: {"files": R.conform(paths.withColumn("content_hash", F.lit("built")), "files")}
    W.watch(changes.select("seq", "op", "path"), store, build, f"{scratch.root}/checkpoint", ["files"], seconds=None).awaitTermination()
    return store.read("files").select("path", "content_hash")


@query(f"""WITH {_WATCHED} SELECT path, CAST(seq AS BIGINT) AS seq, deleted FROM (SELECT path, max(seq) AS seq, arg_max(op, seq) = 'deleted' AS deleted FROM file_changes WHERE path IN (SELECT path FROM w) GROUP BY path)""")
def watch_state(spark, d):
    """What a watch remembers of each path after the stream, from two batches in which the later changes come first."""
    c = load(spark, d, "file_changes")
    middle = c.agg(F.floor((F.min("seq") + F.max("seq")) / 2).alias("m")).first().m or 0
    late, early = W.in_scope(c.filter(F.col("seq") > middle)), W.in_scope(c.filter(F.col("seq") <= middle))
    state = W.fold(None, late)
    return W.fold(state, W.newer(state, W.coalesce(early)).select("path", "seq", F.when(F.col("deleted"), "deleted").otherwise("modified").alias("op")))


_DECIDED = _RELATION_SQL["decisions"]


@query(_DECIDED[: _DECIDED.rindex("SELECT query_id, strategy")] + """,
fin AS (SELECT dd.*, CASE WHEN decisive THEN 'open_hit_1' WHEN prefix IS NOT NULL THEN 'narrow_by_path' ELSE 'refine_query' END AS action, dh.a, (SELECT list(path) FROM packed p WHERE p.query_id = dd.query_id) AS paths FROM dd LEFT JOIN dh USING (query_id)),
go_ AS (SELECT *, CASE WHEN NOT decisive THEN prefix END AS pre FROM fin), wh AS (SELECT *, coalesce(pre, a[1]) AS target, CASE WHEN pre IS NOT NULL AND NOT list_contains(coalesce(paths, []), pre) THEN '--path-prefix' ELSE '--file' END AS flag FROM go_)
SELECT query_id, 'find_v1' AS contract, CAST(CASE WHEN decisive THEN least(1, n_hits) ELSE n_hits END AS INTEGER) AS hits, CASE WHEN action <> 'open_hit_1' AND target IS NOT NULL THEN concat_ws(' ', 'tessera find', query_id, flag, target) END AS command,
  CASE WHEN action = 'open_hit_1' AND n_hits > 0 THEN 'hit' WHEN pre IS NOT NULL THEN CASE WHEN list_contains(coalesce(paths, []), pre) THEN 'file' ELSE 'path_prefix' END WHEN action = 'narrow_by_path' AND n_hits > 0 THEN 'file' END AS target_kind,
  CASE WHEN action = 'open_hit_1' THEN a[1] WHEN pre IS NOT NULL THEN pre WHEN action = 'narrow_by_path' THEN a[1] END AS target_path FROM wh""")
def find_contracts(spark, d):
    hits, q = _hits(spark, d)
    quality, packed = X.backend_quality(hits, q), X.pack(hits)
    rows = K.find_contract(packed, X.decide(packed, X.route(quality, q), quality, q), q.withColumn("query", F.col("query_id")))
    at = lambda p: F.get_json_object("value", p)
    return rows.select("query_id", at("$.contract_version").alias("contract"), F.size(F.from_json(at("$.hits"), "array<struct<rank:int>>")).alias("hits"), at("$.decision.suggested_next_command").alias("command"), at("$.decision.target.kind").alias("target_kind"), at("$.decision.target.path").alias("target_path"))


_PACKED = _RELATION_SQL["pack_round_robin"]


@query(_PACKED.replace("SELECT * FROM packed", "SELECT query_id, CAST(rank AS INTEGER) AS rank, path AS file, CAST(start_line AS INTEGER) AS line, CAST(end_line AS INTEGER) AS line_end, snippet AS context, CAST(round(raw_score, 6) AS DOUBLE) AS ranking_score FROM packed"))
def legacy_results(spark, d):
    """The results view of the packs of all queries."""
    hits, q = _hits(spark, d)
    quality, packed = X.backend_quality(hits, q), X.pack(hits)
    packs = K.pack_contract(packed, X.decide(packed, X.route(quality, q), quality, q), q.withColumn("query", F.col("query_id")))
    return K.legacy_results(packs).select("query_id", "rank", "file", "line", "line_end", "context", "ranking_score")


@query(r"""WITH RECURSIVE """ + _PACKED[len("WITH RECURSIVE ") : _PACKED.rindex(" SELECT * FROM packed")] + rf""", ax AS (SELECT query_id, bool_and({_DOCS} OR contains(lower(path), '/examples/') OR regexp_matches(lower(path), '(^|/)(pytest\.ini|pyproject\.toml|setup\.(cfg|py)|tox\.ini|noxfile\.py|conftest\.py)$')) AS aux, count(DISTINCT path) > 1 AS many, count(*) AS n FROM packed GROUP BY 1)
SELECT ex.name AS query_id, coalesce(n, 0) AS n_hits, coalesce(aux, false) AS auxiliary_only, coalesce(many, false) AS many_paths, false AS authority_scoped FROM ex LEFT JOIN ax ON ax.query_id = ex.name""")
def hit_flags(spark, d):
    """What decides whether vectors are asked, for all queries at once."""
    hits, q = _hits(spark, d)
    return X.flags(X.pack(hits), q).withColumn("n_hits", F.col("n_hits").cast("long"))




@query(rf"""WITH {_HITS}, v AS (SELECT DISTINCT query_id, path, start_line, round(0.6 + (start_line % 40) / 100, 2) AS raw FROM hits WHERE backend = 'exact' AND NOT {_DOCS}),
sm AS (SELECT *, row_number() OVER w AS i, lead(raw) OVER w AS nx FROM v WINDOW w AS (PARTITION BY query_id ORDER BY raw DESC, path, start_line))
SELECT query_id, path, start_line, CAST(raw AS DOUBLE) AS raw_score FROM sm WHERE i = 1 AND raw >= 0.74 AND (nx IS NULL OR round(raw - nx, 9) >= 0.05)""")
def rescued_hits(spark, d):
    """The one sure hit of each query, for hits whose scores follow from their lines."""
    hits, q = _hits(spark, d)
    raw = F.round(0.6 + (F.col("start_line") % 40) / 100, 2)
    h = hits.filter("backend = 'exact'").withColumn("raw_score", raw).dropDuplicates(["query_id", "path", "start_line"])
    h = h.withColumn("idx", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "path", "start_line")) - 1)
    return X.rescue(h, q).select("query_id", "path", "start_line", "raw_score")


@query("""WITH s AS (SELECT repo_id, count(*) AS n FROM symbols WHERE repo_id IS NOT NULL GROUP BY 1), x AS (SELECT repo_id, n, n % 5 AS m FROM s)
SELECT repo_id, m <> 0 AND m <> 3 AS needs_reindex, CASE m WHEN 1 THEN 'missing index metadata' WHEN 2 THEN 'embedding profile changed' WHEN 4 THEN 'cache schema rebuilt (older)' END AS reindex_reason, m = 0 AS semantic_allowed,
  array_to_string(list_concat(CASE WHEN m IN (1, 2, 4) THEN ['reindex_required'] ELSE [] END, CASE WHEN m = 3 THEN ['vector_integrity_failed'] ELSE [] END), ',') AS warning_codes FROM x""")
def index_states(spark, d):
    """The state of one index per repo, from metadata of five kinds."""
    s = load(spark, d, "symbols").filter("repo_id IS NOT NULL").groupBy("repo_id").agg((F.count("*") % 5).alias("m"))
    value = {"last_success_at": F.when(F.col("m") != 1, "2025"), "index_profile": F.when(F.col("m") == 2, "other").otherwise("mini-64|edges"), "reset_reason": F.when(F.col("m") == 4, "older"), "vector_cache": F.when(F.col("m") == 3, "failed").otherwise("passed"), "chunk_span": F.lit("passed")}
    rows = s.select("repo_id", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in value.items()))).alias("r")).select("repo_id", "r.*")
    return K.snapshot(rows, "mini-64", by=["repo_id"]).withColumn("warning_codes", F.array_join("warning_codes", ","))
