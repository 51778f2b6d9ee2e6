"""Queries over the building and upkeep of the index, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import text as T
from tessera.operators import audit as A
from tessera.operators import chunking as C
from tessera.operators import coverage as V
from tessera.operators import graph as G
from tessera.operators import guidance as U
from tessera.operators import metrics as M
from tessera.operators import occurrences as O
from tessera.operators import relations as R
from tessera.operators import semantic as S
from tessera.runtime import load, one_per_id
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


def sources(spark: SparkSession, d: str) -> DataFrame:
    """One row per path: language, content."""
    s = load(spark, d, "source_texts").filter("path IS NOT NULL AND content IS NOT NULL")
    return s.groupBy("path").agg(F.min(F.struct("language", "content")).alias("r")).select("path", "r.language", "r.content")


_SRC = "src AS (SELECT path, min(language) AS language, min(content) AS content FROM source_texts WHERE path IS NOT NULL AND content IS NOT NULL GROUP BY path)"
_SYM = "sym AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY commit_hash) AS rn_ FROM symbols) WHERE rn_ = 1)"
_LINES = "lines_ AS (SELECT path, language, generate_subscripts(l, 1) AS line, unnest(l) AS text FROM (SELECT path, language, string_split(content, chr(10)) AS l FROM src))"


@query(f"WITH {_SRC} SELECT path, language, sha256(content) AS content_hash, len(string_split(content, chr(10))) AS n_lines FROM src")
def content_hash(spark, d):
    return sources(spark, d).select("path", "language", T.content_hash("content").alias("content_hash"), T.line_count("content").cast("long").alias("n_lines"))


@query(f"WITH {_SRC}, {_LINES} SELECT path, line, md5(text) AS h FROM lines_")
def line_explode(spark, d):
    return T.lines(sources(spark, d)).select("path", F.col("line").cast("long").alias("line"), F.md5("text").alias("h"))


@query(f"""WITH {_SRC}, {_LINES}, s AS (SELECT path, line, octet_length(encode(text)) + 1 AS n, octet_length(encode(content)) AS total FROM lines_ JOIN src USING (path))
SELECT path, line, CAST(sum(n) OVER w - n AS BIGINT) AS start_byte, CAST(least(sum(n) OVER w, total) AS BIGINT) AS end_byte FROM s WINDOW w AS (PARTITION BY path ORDER BY line)""")
def line_byte_spans(spark, d):
    return T.line_spans(sources(spark, d)).select("path", F.col("line").cast("long").alias("line"), "start_byte", "end_byte")


@query(r"SELECT DISTINCT chunk_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS tokens FROM chunks")
def token_estimate(spark, d):
    return load(spark, d, "chunks").select("chunk_id", T.token_estimate("text").cast("long").alias("tokens")).distinct()


_KEYWORDS = ", ".join(f"'{k}'" for k in T.REFERENCE_KEYWORDS)


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: length(x) >= 3 AND lower(x) NOT IN ({_KEYWORDS}))))[1:25], ' ') AS tokens FROM documents""")
def reference_tokens_top25(spark, d):
    return load(spark, d, "documents").select("doc_id", F.array_join(T.reference_tokens("text", F.lit("")), " ").alias("tokens"))


@query(r"""SELECT sha256(concat_ws('|', repo_id, edge_type, from_id, to_id, file_path, line)) AS edge_hash,
  printf('EDGE_TYPE: %s' || chr(10) || 'FROM: %s' || chr(10) || 'TO: %s' || chr(10) || 'FILE: %s' || chr(10) || 'LINE: %d' || chr(10) || 'CONFIDENCE: %.3f', edge_type, from_id, to_id, file_path, line, confidence) AS fact,
  'file:' || sha256(repo_id || '|' || file_path) AS file_node FROM edges""")
def edge_ids_and_text(spark, d):
    e = load(spark, d, "edges")
    return e.select(T.edge_id("repo_id", "edge_type", "from_id", "to_id", "file_path", "line").alias("edge_hash"), T.edge_text("edge_type", "from_id", "to_id", "file_path", "line", "confidence").alias("fact"), T.file_node_id("repo_id", "file_path").alias("file_node"))


@query(r"""WITH p AS (SELECT DISTINCT path, lower(path) AS l, regexp_extract(lower(path), '[^/]*$') AS b FROM files),
c AS (SELECT *, regexp_matches(l, '\.(c|cc|cpp|cs|go|h|hpp|java|js|jsx|kt|m|php|py|rb|rs|swift|ts|tsx)$|(^|/)src(/|$)') AS s,
  regexp_matches(l, '(^|/)tests?(/|$)|(^|/)test_[^/]*$|_test\.(py|go)$') OR contains(b, '.spec.') AS t,
  contains(l, '/docs/') OR contains(l, '/doc/') OR starts_with(l, 'docs/') OR regexp_matches(regexp_replace(b, '(.)\.[^.]*$', '\1'), 'readme|changelog|changes|history|news|release-notes') AS k FROM p)
SELECT path, s AS is_source, t AS is_test, k AS is_docs, CAST(CASE WHEN s THEN 1.0 WHEN t THEN 0.82 WHEN k THEN 0.28 ELSE 0.66 END AS DOUBLE) AS code_score,
  CAST(CASE WHEN k THEN 1.0 WHEN s THEN 0.30 WHEN t THEN 0.22 ELSE 0.28 END AS DOUBLE) AS docs_score,
  CASE WHEN regexp_matches(l, '(^|/)src(/|$)') THEN 'src' WHEN regexp_matches(l, '(^|/)tests(/|$)') THEN 'tests' WHEN regexp_matches(l, '(^|/)scripts(/|$)') THEN 'scripts' ELSE 'other' END AS path_class,
  regexp_extract(b, '[^.](\.[^.]+)$', 1) AS extension FROM c""")
def path_classes(spark, d):
    p = load(spark, d, "files").select("path").distinct()
    return p.select("path", P.is_source("path").alias("is_source"), P.is_test("path").alias("is_test"), P.is_docs("path").alias("is_docs"), P.domain_score("path", "code").alias("code_score"), P.domain_score("path", "docs_policy").alias("docs_score"), P.path_class("path").alias("path_class"), P.extension_label("path").alias("extension"))


@query(r"SELECT DISTINCT path FROM files WHERE (path = '/work' OR starts_with(path, '/work/')) AND (path LIKE '%/src/%' OR path LIKE '%.py') AND NOT path LIKE '%test%'")
def path_filters(spark, d):
    return load(spark, d, "files").filter(P.allowed("path", ["/work/"], ["*/src/*", "*.py"], ["*test*"])).select("path").distinct()


@query("SELECT DISTINCT replace(replace(name, '_', '\\_'), '%', '\\%') AS escaped, name FROM symbols WHERE name LIKE '%\\_%' ESCAPE '\\'")
def like_escape(spark, d):
    return load(spark, d, "symbols").filter(F.col("name").contains("_")).select(P.escape_like("name").alias("escaped"), "name").distinct()


@query(r"""SELECT DISTINCT id, name FROM symbols WHERE kind IN ('class', 'interface') AND language = 'python' AND starts_with(file_path, '/work/')""")
def filter_symbols(spark, d):
    return R.filter_symbols(load(spark, d, "symbols"), ["class", "interface"], "/work", "python").select("id", "name")


@query("""SELECT path, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN was = now THEN 'unchanged' ELSE 'changed' END AS change FROM
(SELECT path, arg_min(content_hash, last_indexed) AS was FROM files GROUP BY path) FULL JOIN (SELECT path, min(sha256(content)) AS now FROM source_texts GROUP BY path) USING (path)""")
def change_plan(spark, d):
    old = load(spark, d, "files").groupBy("path").agg(F.min_by("content_hash", "last_indexed").alias("content_hash"))
    new = load(spark, d, "source_texts").groupBy("path").agg(F.min(F.sha2("content", 256)).alias("content_hash"))
    return R.change_plan(old, new)


@query("""WITH o AS (SELECT DISTINCT id, file_path AS p0, body_hash AS h0 FROM symbols s JOIN commits c USING (commit_hash) WHERE committed_at < TIMESTAMPTZ '2025-07-01 00:00:00+00'),
n AS (SELECT DISTINCT id, file_path AS p1, body_hash AS h1 FROM symbols WHERE file_path NOT IN (SELECT path FROM file_changes GROUP BY path HAVING arg_max(op, seq) = 'deleted'))
SELECT coalesce(p1, p0) AS file_path, count(*) FILTER (h0 IS NULL) AS added, count(*) FILTER (h0 <> h1) AS updated, count(*) FILTER (h1 IS NULL) AS removed FROM o FULL JOIN n USING (id) GROUP BY ALL""")
def symbol_changes(spark, d):
    from tessera.operators.orphans import removed_files

    s = load(spark, d, "symbols").select("id", "file_path", "body_hash", "commit_hash")
    early = load(spark, d, "commits").filter(F.col("committed_at") < F.lit("2025-07-01T00:00:00Z").cast("timestamp")).select("commit_hash").distinct()
    return R.symbol_changes(s.join(early, "commit_hash", "left_semi"), s.join(removed_files(load(spark, d, "file_changes")), "file_path", "left_anti"))


@query("""WITH seen AS (SELECT path FROM file_changes GROUP BY path HAVING arg_max(op, seq) <> 'deleted')
SELECT 'symbols' AS relation, count(*) AS n FROM symbols WHERE file_path IN (FROM seen) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE file_path IN (FROM seen)
UNION ALL SELECT 'edges', count(*) FROM edges WHERE file_path IN (FROM seen) UNION ALL SELECT 'files', count(*) FROM files WHERE path IN (FROM seen)""")
def stale_prune(spark, d):
    seen = W.coalesce(load(spark, d, "file_changes")).filter("NOT deleted").select("path")
    kept = R.prune({t: load(spark, d, t) for t in ("symbols", "chunks", "edges", "files")}, seen)
    out = None
    for t, df in kept.items():
        part = df.agg(F.lit(t).alias("relation"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH a AS (SELECT DISTINCT symbol_id AS k FROM chunks WHERE symbol_id IS NOT NULL), b AS (SELECT DISTINCT id AS k FROM symbols)
SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS "both", count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right FROM a FULL JOIN b ON a.k = b.k""")
def id_reconcile(spark, d):
    return R.reconcile(load(spark, d, "chunks"), load(spark, d, "symbols").withColumnRenamed("id", "symbol_id"), "symbol_id")


@query("""SELECT embedding_profile, record_kind, text_hash, arg_max(dimension, updated_at) AS dimension, min(created_at) AS created_at, max(updated_at) AS updated_at FROM embedding_ledger GROUP BY ALL""")
def ledger_merge(spark, d):
    """The rows of the later half of the time are merged into the earlier ones."""
    led = load(spark, d, "embedding_ledger")
    late = F.coalesce(F.col("updated_at") >= F.lit("2025-10-01T00:00:00Z").cast("timestamp"), F.lit(True))
    return R.ledger_merge(led.filter(~late), led.filter(late)).drop("vector")


@query("""SELECT DISTINCT sha256(text) AS text_hash FROM chunks WHERE sha256(text) NOT IN (SELECT text_hash FROM embedding_ledger WHERE embedding_profile = 'mini-64' AND record_kind = 'chunk')""")
def ledger_todo(spark, d):
    return R.ledger_lookup(load(spark, d, "chunks"), load(spark, d, "embedding_ledger"), "mini-64", "chunk")[1].select("text_hash")


@query("""SELECT coalesce(file_path, '') AS file_path, id, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY commit_hash DESC) AS i FROM symbols) WHERE i = 1""")
def upsert_symbols(spark, d):
    s = load(spark, d, "symbols")
    last = R.first_per(s, ["id"], [F.desc("commit_hash")])
    return R.upsert(s.dropDuplicates(["id"]), last, ["id"]).select(F.coalesce("file_path", F.lit("")).alias("file_path"), "id", "name")


@query(f"""WITH {_SYM}, x AS (SELECT DISTINCT id AS sid, trim(c, ' ' || chr(9) || chr(10)) AS t, file_path AS f, container_fqname AS cf, c AS target FROM (SELECT id, file_path, container_fqname, unnest(calls) AS c FROM sym) WHERE c IS NOT NULL),
fq AS (SELECT fqname AS key, max((file_path, start_line, end_line, id, kind)) AS r FROM sym WHERE fqname <> '' GROUP BY 1),
here AS (SELECT name, file_path, min((file_path, start_line, id, kind)) AS r FROM sym GROUP BY ALL),
nm AS (SELECT name, count(*) AS n, min((file_path, start_line, id, kind)) AS r FROM sym GROUP BY ALL)
SELECT DISTINCT sid AS id, target, CASE WHEN t = '' THEN 'unresolved:<empty>' WHEN a.key IS NOT NULL THEN a.r[4] WHEN b.key IS NOT NULL THEN b.r[4] WHEN nm.n = 1 THEN nm.r[3] WHEN here.name IS NOT NULL THEN here.r[3] WHEN nm.name IS NOT NULL THEN nm.r[3] ELSE 'unresolved:' || t END AS to_id,
  CAST(CASE WHEN t = '' THEN 0.15 WHEN a.key IS NOT NULL THEN 0.95 WHEN b.key IS NOT NULL THEN 0.9 WHEN nm.n = 1 THEN CASE WHEN nm.r[1] = f THEN 0.85 ELSE 0.75 END WHEN here.name IS NOT NULL THEN 0.65 WHEN nm.name IS NOT NULL THEN 0.45 ELSE 0.15 END AS DOUBLE) AS confidence
FROM x LEFT JOIN fq a ON a.key = t LEFT JOIN fq b ON b.key = cf || '.' || t AND cf <> '' LEFT JOIN here ON here.name = string_split(t, '.')[-1] AND here.file_path = f LEFT JOIN nm ON nm.name = string_split(t, '.')[-1]""")
def edge_resolve_tiers(spark, d):
    s = one_per_id(load(spark, d, "symbols"))
    refs = s.select("id", F.explode("calls").alias("target"), F.col("file_path").alias("file"), "container_fqname").filter("target IS NOT NULL")
    return G.resolve(refs.distinct(), G.catalog(s)).select("id", "target", "to_id", "confidence").distinct()


@query(f"""WITH {_SRC}, {_LINES}, l AS (SELECT path, line, CASE WHEN language IN ('typescript', 'tsx') THEN 'javascript' ELSE language END AS g, trim(text) AS s FROM lines_)
SELECT path, line, target FROM (
  SELECT path, line, unnest(list_transform(string_split(regexp_extract(s, '^import\\s+(.+)$', 1), ','), lambda x: trim(split_part(trim(x), ' as ', 1)))) AS target FROM l WHERE g = 'python' AND regexp_matches(s, '^import\\s+(.+)$')
  UNION ALL SELECT path, line, regexp_extract(s, '^import\\s+[''"]([^''"]+)[''"]', 1) FROM l WHERE g = 'javascript'
  UNION ALL SELECT path, line, trim(regexp_extract(s, '^use\\s+([^;]+);', 1)) FROM l WHERE g = 'rust'
  UNION ALL SELECT path, line, regexp_extract(s, '^import\\s+([A-Za-z0-9_.*]+)\\s*;', 1) FROM l WHERE g = 'java'
  UNION ALL SELECT path, line, regexp_extract(s, '^import\\s+"([^"]+)"', 1) FROM l WHERE g = 'go') WHERE target <> ''""")
def import_targets(spark, d):
    return G.import_targets(sources(spark, d)).select("path", F.col("line").cast("long").alias("line"), "target")


@query()
def edges_extract(spark, d):
    s = load(spark, d, "symbols")
    return G.extract(sources(spark, d), s).select("edge_id", "edge_type", "from_id", "to_id", "file_path", "line", "confidence", "text")


@query()
def chunks_build(spark, d):
    return C.build(sources(spark, d), load(spark, d, "symbols")).select("chunk_id", "symbol_id", "chunk_part_index", "chunk_part_total", "start_line", "end_line", "start_byte", "end_byte", "tokens_estimate", F.md5("text").alias("text_md5"))


@query(f"""WITH {_SYM}, c AS (SELECT DISTINCT ON (chunk_id, symbol_id) chunk_id, symbol_id, start_line, end_line, chunk_part_index FROM chunks WHERE symbol_id IS NOT NULL),
w AS (SELECT *, lag(end_line) OVER (PARTITION BY symbol_id ORDER BY start_line, end_line, chunk_part_index, chunk_id) AS before FROM c)
SELECT chunk_id, symbol_id, CASE WHEN w.start_line < s.start_line OR w.end_line > s.end_line THEN 'outside' ELSE 'overlap' END AS problem
FROM w JOIN sym s ON s.id = symbol_id WHERE w.start_line < s.start_line OR w.end_line > s.end_line OR w.start_line <= before""")
def chunk_span_violations(spark, d):
    return C.span_violations(load(spark, d, "symbols"), load(spark, d, "chunks"))


_MERGE = """x AS (SELECT path, s, e, count(*) AS n FROM spans WHERE e >= s GROUP BY ALL), y AS (SELECT *, greatest(0, e - greatest(s - 1, coalesce(max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s - 1))) AS gain FROM x),
m AS (SELECT path, sum(gain)::BIGINT AS merged_lines, sum((e - s + 1) * n)::BIGINT AS lines FROM y GROUP BY path)"""


@query(f"WITH spans AS (SELECT file_path AS path, start_line AS s, end_line AS e FROM chunks), {_MERGE} SELECT * FROM m")
def merged_line_coverage(spark, d):
    return M.merged_line_count(load(spark, d, "chunks").withColumnRenamed("file_path", "path"))


@query(f"""WITH spans AS (SELECT file_path AS path, start_line AS s, end_line AS e FROM chunks WHERE len(embedding_vector) > 0 UNION ALL SELECT file_path, line, line FROM edges WHERE len(embedding_vector) > 0), {_MERGE},
t AS (SELECT sum(lines)::BIGINT AS total_lines, sum(merged_lines)::BIGINT AS unique_lines FROM m)
SELECT total_lines, unique_lines, total_lines - unique_lines AS duplicate_lines, round((total_lines - unique_lines) / total_lines, 6) AS duplicate_ratio, round(total_lines / unique_lines, 6) AS inflation FROM t""")
def embedding_line_metrics(spark, d):
    return M.embedding_line_metrics(load(spark, d, "chunks"), load(spark, d, "edges"))


_COV = "cov AS (SELECT DISTINCT from_id AS test_id, file_path AS path, line FROM edges WHERE edge_type IN ('CALLS', 'REFERENCES'))"


def _coverage(spark, d):
    return load(spark, d, "edges").filter("edge_type IN ('CALLS', 'REFERENCES')").select(F.col("from_id").alias("test_id"), F.col("file_path").alias("path"), "line").distinct()


@query(f"WITH {_SYM}, {_COV} SELECT DISTINCT id, test_id FROM sym JOIN cov ON path = file_path AND line BETWEEN start_line AND end_line")
def coverage_range_join(spark, d):
    return V.covering_tests(_coverage(spark, d), load(spark, d, "symbols"))


@query(f"""WITH {_SYM}, {_COV}, n AS (SELECT id, list(DISTINCT test_id) AS new FROM sym JOIN cov ON path = file_path AND line BETWEEN start_line AND end_line GROUP BY id)
SELECT s.id, array_to_string(list_sort(CASE WHEN n.id IS NOT NULL THEN list_distinct(list_concat(coalesce(s.covered_by, []), n.new)) WHEN s.file_path IN (SELECT path FROM cov) THEN [] ELSE coalesce(s.covered_by, []) END), ',') AS covered_by FROM sym s LEFT JOIN n ON n.id = s.id""")
def covered_by_union_reset(spark, d):
    return V.apply_coverage(load(spark, d, "symbols"), _coverage(spark, d)).select("id", F.array_join("covered_by", ",").alias("covered_by"))


@query(f"WITH {_COV} SELECT test_id, count(*) AS n_lines, count(DISTINCT path) AS n_files FROM cov GROUP BY test_id")
def coverage_json_roundtrip(spark, d):
    back = V.parse_context_json(V.context_json(_coverage(spark, d)).select(F.to_json(F.create_map("test_id", F.from_json("value", "map<string,array<int>>"))).alias("value")))
    return back.groupBy("test_id").agg(F.count("*").alias("n_lines"), F.count_distinct("path").alias("n_files"))


@query(f"WITH {_SYM} SELECT id AS symbol_id, file_path, 'Missing docstring' AS warnings FROM sym WHERE kind IN ('function', 'class', 'interface') AND coalesce(docstring, '') = ''")
def audit_missing(spark, d):
    return A.audit(load(spark, d, "symbols")).select("symbol_id", "file_path", F.array_join("warnings", ";").alias("warnings"))


@query()
def audit_similarity(spark, d):
    s = load(spark, d, "symbols")
    return A.audit(s, A.scores(s, A.whole_code(load(spark, d, "chunks")), max_code=None)).select("symbol_id", F.array_join("warnings", ";").alias("warnings"), F.round("semantic_score", 6).alias("semantic_score"), "skip_reason")


@query(f"""WITH {_SYM}, a AS (SELECT id, file_path, CASE WHEN regexp_matches(file_path, '/src/') THEN 'src' WHEN regexp_matches(file_path, '/tests/') THEN 'tests' WHEN regexp_matches(file_path, '/scripts/') THEN 'scripts' ELSE 'other' END AS c
  FROM sym WHERE kind IN ('function', 'class', 'interface') AND coalesce(docstring, '') = '')
SELECT 'type' AS "grouping", 'Missing docstring' AS key, count(*) AS n FROM a HAVING count(*) > 0 UNION ALL SELECT 'file', file_path, count(*) FROM a GROUP BY file_path
UNION ALL SELECT 'path_class', k, count(a.id) FROM (SELECT unnest(['src', 'tests', 'scripts', 'other']) AS k) LEFT JOIN a ON c = k GROUP BY k""")
def audit_summary(spark, d):
    s = load(spark, d, "symbols")
    return M.warning_summary(A.audit(s), s.select(F.col("id").alias("symbol_id"), "file_path"))


@query(f"""WITH {_SYM}, r AS (SELECT id, name, unnest(covered_by) AS t FROM sym)
SELECT r.id AS symbol_id, r.t AS test_id, CASE WHEN list_contains(s.calls, r.name) THEN 'strong' ELSE 'moderate' END AS strength FROM r LEFT JOIN sym s ON s.id = r.t""")
def constraining_tests(spark, d):
    return U.constraining_tests(load(spark, d, "symbols"))


@query(f"""WITH {_SYM} SELECT id AS symbol_id, CASE WHEN len(covered_by) > 0 THEN 'low' ELSE 'high' END AS risk, CAST(CASE WHEN len(covered_by) > 0 THEN 0 WHEN len(invariants) > 0 THEN 2 ELSE 1 END AS BIGINT) AS n_warnings FROM sym""")
def untested_behaviors(spark, d):
    return U.untested(load(spark, d, "symbols")).select("symbol_id", "risk", F.size("warnings").cast("long").alias("n_warnings"))


_NEAR = f"""{_SYM}, near_ AS (SELECT a.id AS symbol_id, b.id AS neighbor_id, greatest(0, b.start_line - a.end_line, a.start_line - b.end_line) AS gap FROM sym a JOIN sym b ON a.file_path = b.file_path AND a.id <> b.id
  WHERE greatest(0, b.start_line - a.end_line, a.start_line - b.end_line) <= 5)"""


@query(f"WITH {_NEAR} SELECT * FROM near_")
def structural_neighbors(spark, d):
    return S.structural_neighbors(load(spark, d, "symbols"), 5)


@query(f"WITH {_NEAR} SELECT symbol_id, count(*) AS impact_count, array_to_string(list(neighbor_id ORDER BY gap, neighbor_id)[1:10], ',') AS nearest FROM near_ GROUP BY symbol_id")
def impact_radius(spark, d):
    return U.impact(load(spark, d, "symbols")).select("symbol_id", "impact_count", F.array_join("nearest", ",").alias("nearest"))


@query("""SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM chunks WHERE len(embedding_vector) > 0) AS embedded_chunks,
(SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE len(embedding_vector) > 0) AS embedded_edges""")
def index_stats(spark, d):
    return M.index_stats(*(load(spark, d, t) for t in ("files", "symbols", "chunks", "edges")))


@query(r"""WITH p AS (SELECT DISTINCT path, regexp_extract(lower(path), '[^/.](\.[^./]+)$', 1) AS e FROM files), r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY path) AS i FROM p)
SELECT e AS extension, count(*) AS n, array_to_string(list(path ORDER BY path) FILTER (i <= 5), ',') AS samples FROM r GROUP BY e""")
def extension_counts(spark, d):
    return M.extension_counts(load(spark, d, "files").select("path").distinct()).select("extension", "n", F.array_join("samples", ",").alias("samples"))


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events) SELECT event_type AS reason, count(*) AS n, array_to_string(list(event_id ORDER BY i) FILTER (i <= 5), ',') AS samples FROM r GROUP BY ALL""")
def failure_counts(spark, d):
    return M.failure_counts(load(spark, d, "events"), "event_type", "event_id").select("reason", "n", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id DESC LIMIT 10")
def slowest_top10(spark, d):
    return M.slowest(load(spark, d, "events"), 10, "value", "event_id").select("event_id", "user_id", "value")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def json_props(spark, d):
    e = load(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT user_id AS path, arg_max(event_type, event_id) AS state, max(event_id) AS updated_at FROM events GROUP BY user_id""")
def checkpoint_latest(spark, d):
    log = load(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("state"), F.col("event_id").alias("updated_at"))
    return R.checkpoint_log(log).select("path", "state", "updated_at")


@query("""SELECT path, max(seq) AS seq, arg_max(op, seq) = 'deleted' AS deleted FROM file_changes GROUP BY path""")
def stream_change_fold(spark, d):
    return W.fold(None, load(spark, d, "file_changes"))


@query("""SELECT path, max(seq) AS seq, bool_or(op = 'deleted') AS deleted FROM file_changes GROUP BY path""")
def stream_change_fold_sticky(spark, d):
    return W.fold(None, load(spark, d, "file_changes"), sticky=True)


@query("""SELECT DISTINCT repo_id, commit_hash FROM symbols UNION SELECT DISTINCT repo_id, commit_hash FROM chunks""")
def union_distinct(spark, d):
    return R.union_distinct(load(spark, d, "symbols").select("repo_id", "commit_hash"), load(spark, d, "chunks").select("repo_id", "commit_hash"))


@query(f"""WITH {_SRC}, {_LINES}, k AS (SELECT DISTINCT file_path, start_line, name FROM symbols),
t AS (SELECT DISTINCT path, line, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS s FROM lines_),
r AS (SELECT s, 'ref' AS kind, path FROM t WHERE length(s) >= 3 AND lower(s) NOT IN ({_KEYWORDS}) AND NOT EXISTS (SELECT 1 FROM k WHERE file_path = path AND start_line = line AND name = s)),
o AS (SELECT DISTINCT name AS s, 'def' AS kind, file_path AS path, start_line, end_line, symbols.language, container_fqname, signature FROM symbols JOIN src ON path = file_path WHERE start_line >= 1 AND end_line <= len(string_split(content, chr(10)))),
a AS (SELECT s, kind, path FROM r UNION ALL SELECT s, kind, path FROM o)
SELECT s AS symbol, count(*) FILTER (kind = 'def') AS defs, count(*) FILTER (kind = 'ref') AS refs, count(DISTINCT path) AS files FROM a GROUP BY s""")
def occurrence_stats(spark, d):
    return O.token_stats(O.build(sources(spark, d), load(spark, d, "symbols")))


@query()
def parse_symbols(spark, d):
    return PA.symbols(sources(spark, d), "repo").select("file_path", "name", "kind", "fqname", "start_line", "end_line", "signature", F.size("calls").alias("n_calls"))
