"""Queries over search, ranking, the graph and fusion, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.hints import analyze
from tessera.operators import fusion as X
from tessera.operators import graph as G
from tessera.operators import lexical as L
from tessera.operators import occurrences as O
from tessera.operators import relations as R
from tessera.operators import router as RT
from tessera.operators import semantic as S
from tessera.plans.index_queries import _LINES, _SRC, _SYM, sources
from tessera.runtime import load, one_per_id

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: The query texts that stand for a user's; they are parameters of the search, not of the data.
LITERAL, NAME, GREP = "registry order tuple", "class Registry", "rg -i -w 'registry'"
_SOURCE = r"regexp_matches(lower(path), '\.(c|cc|cpp|cs|go|h|hpp|java|js|jsx|kt|m|php|py|rb|rs|swift|ts|tsx)$|(^|/)src(/|$)')"
_TEST = r"(regexp_matches(lower(path), '(^|/)tests?(/|$)|(^|/)test_[^/]*$|_test\.(py|go)$') OR contains(lower(path), '.spec.'))"
_DEF, _IMP = r"'^\s*(?:async\s+def|def|class|function|func|interface|struct|trait|enum)\b'", r"'^\s*(?:from\s+\S+\s+import\b|import\b|use\b|#include\b|require(?:\(|\s))'"


@query(rf"""WITH {_SRC}, {_LINES}, h AS (SELECT path, line, text, regexp_matches(text, 'registry') AS a, regexp_matches(text, 'order') AS b, regexp_matches(text, 'tuple') AS c FROM lines_)
SELECT path, line, CAST(a::INT + 2 * b::INT + 4 * c::INT AS BIGINT) AS mask, CAST(round(greatest(0, least(1, 0.9 + CASE WHEN regexp_matches(text, {_DEF}) THEN 0.10 ELSE 0 END + CASE WHEN {_SOURCE} THEN 0.14 ELSE 0 END - CASE WHEN {_TEST} THEN 0.01 ELSE 0 END)), 6) AS DOUBLE) AS raw_score,
  CASE WHEN regexp_matches(text, {_IMP}) THEN 'import' WHEN regexp_matches(text, {_DEF}) AND regexp_matches(text, '(^|[^A-Za-z0-9_])(registry|order|tuple)($|[^A-Za-z0-9_])') THEN 'definition' ELSE 'reference' END AS match_role
FROM h WHERE a OR b OR c""")
def exact_matches(spark, d):
    h = analyze(LITERAL)
    return L.matches(T.lines(sources(spark, d)), L.patterns(h)[1], h).select("path", F.col("line").cast("long").alias("line"), "mask", F.round("raw_score", 6).alias("raw_score"), "match_role")


@query()
def exact_search_topk(spark, d):
    return L.search(T.lines(sources(spark, d)), analyze(LITERAL), 24)


@query()
def exact_search_declaration(spark, d):
    return L.search(T.lines(sources(spark, d)), analyze(NAME), 24)


@query(rf"""WITH {_SRC}, {_LINES} SELECT path, line, text FROM lines_ WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(registry)($|[^A-Za-z0-9_])') ORDER BY path, line LIMIT 24""")
def grep_word_ignore_case(spark, d):
    from tessera.functions.grep_compat import parse

    g = parse(GREP)
    return L.scan(T.lines(sources(spark, d)), [g.pattern], 24, g.case, g.word, g.fixed).select("path", F.col("line").cast("long").alias("line"), "text")


@query(rf"""WITH {_SRC}, {_LINES} SELECT path, count(*) AS n FROM lines_ WHERE contains(text, 'return ') GROUP BY path""")
def grep_count_by_file(spark, d):
    return L.count_by_file(T.lines(sources(spark, d)), r"return\ ")


@query()
def symbol_search_topk(spark, d):
    return O.search(O.build(sources(spark, d), load(spark, d, "symbols")), analyze(NAME), 16)


@query(r"""WITH s AS (SELECT DISTINCT name, regexp_matches(lower(file_path), '\.(py|js|ts|go|rs|java)$|(^|/)src(/|$)') AS src FROM symbols), m AS (SELECT name, src, lower(name) AS n FROM s)
SELECT name, CAST(round(max(CASE WHEN n = 'registry' THEN 1.0 WHEN contains(n, 'registry') OR contains('registry', n) THEN 0.74 ELSE 0 END), 6) AS DOUBLE) AS score FROM m GROUP BY name HAVING score > 0""")
def symbol_match_scores(spark, d):
    s = load(spark, d, "symbols").select("name").distinct()
    return s.withColumn("score", F.round(O.match_score(F.col("name"), analyze("Registry")), 6)).filter("score > 0")


def _probe(spark, d) -> list[float]:
    """The query vector: that of the smallest id."""
    return load(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]


@query("""WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1), x AS (SELECT vec_id AS id, list_sum(list_transform(list_zip(embedding, q.v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS dist FROM embeddings, q)
SELECT id, round(dist, 9) AS distance, round(greatest(0, least(1, 1 - dist / 2)), 9) AS similarity FROM x ORDER BY dist, id LIMIT 10""")
def knn_l2_topk(spark, d):
    from tessera.functions.vectors import score

    hit = S.knn(load(spark, d, "embeddings"), _probe(spark, d), 10, "vec_id", "embedding")
    return hit.select("id", F.round("distance", 9).alias("distance"), F.round(score("distance"), 9).alias("similarity"))


@query("""WITH x AS (SELECT q.vec_id AS qid, e.vec_id AS id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS dist FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, CAST(id AS VARCHAR)) AS rank FROM x) SELECT CAST(qid AS VARCHAR) AS query_id, CAST(id AS VARCHAR) AS id, round(dist, 9) AS distance, rank FROM r WHERE rank <= 5""")
def knn_batched(spark, d):
    e = load(spark, d, "embeddings")
    asks = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return S.knn_batch(e, asks, 5, "vec_id", "embedding").select("query_id", "id", F.round("distance", 9).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT a.label, b.label AS other, count(*) AS n, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS mean_cosine FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1 GROUP BY ALL""")
def cosine_similarity(spark, d):
    from tessera.functions.vectors import cosine

    e = load(spark, d, "embeddings")
    b = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("v2"), F.col("label").alias("other"))
    return e.join(b, "vec_id").groupBy("label", "other").agg(F.count("*").alias("n"), F.round(F.avg(cosine("embedding", "v2")), 6).alias("mean_cosine"))


@query(f"""WITH {_SYM}, c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE embedding_vector IS NOT NULL ORDER BY chunk_id), q AS (SELECT embedding_vector AS v FROM c ORDER BY chunk_id LIMIT 1),
x AS (SELECT chunk_id, symbol_id, start_line, list_sum(list_transform(list_zip(embedding_vector, q.v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS dist FROM c, q WHERE len(embedding_vector) = len(q.v)),
h AS (SELECT * FROM x ORDER BY dist, chunk_id LIMIT 80),
j AS (SELECT h.*, s.name, s.file_path, round(greatest(0, least(1, 1 - dist / 2)), 9) AS sim FROM h JOIN sym s ON s.id = h.symbol_id),
k AS (SELECT *, round(greatest(0, least(1, sim + CASE WHEN regexp_matches(lower(file_path), '(^|/)src(/|$)') THEN 0.06 ELSE 0 END + CASE WHEN name = 'lookup' THEN 0.22 ELSE 0 END
  - CASE WHEN regexp_matches(lower(file_path), '(^|/)tests?(/|$)|(^|/)test_[^/]*$|_test\\.(py|go)$|\\.spec\\.(ts|tsx|js|jsx)$') THEN 0.20 ELSE 0 END - CASE WHEN regexp_matches(lower(name), '^test(_|$)') THEN 0.08 ELSE 0 END)), 9) AS score FROM j),
f AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY score DESC, sim DESC, file_path, start_line, chunk_id) AS i FROM k)
SELECT symbol_id, chunk_id, name, sim AS similarity, score AS ranking_score FROM f WHERE i = 1 ORDER BY score DESC, sim DESC, file_path, start_line, chunk_id LIMIT 10""")
def semantic_search(spark, d):
    c = load(spark, d, "chunks").dropDuplicates(["chunk_id"])
    v = c.filter("embedding_vector IS NOT NULL").select("chunk_id", "embedding_vector")
    probe = v.orderBy("chunk_id").first().embedding_vector
    r = S.ranking("index.lookup")
    hits = S.knn(v, probe, S.fetch_size(10, r), "chunk_id", "embedding_vector")
    return S.search(hits, c, load(spark, d, "symbols"), r, 10).select("symbol_id", "chunk_id", "name", "similarity", "ranking_score")


@query(f"""WITH {_SYM}, c AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY chunk_part_index, start_line, chunk_id) AS i FROM chunks)
SELECT s.id, s.name, c.chunk_id FROM sym s JOIN c ON c.symbol_id = s.id AND c.i = 1 WHERE regexp_matches(s.name, '(?i)registry') ORDER BY s.file_path, s.start_line, s.id LIMIT 50""")
def first_chunk_per_symbol(spark, d):
    return S.structured(load(spark, d, "symbols"), load(spark, d, "chunks"), F.col("name").rlike("(?i)registry"), 50).select("id", "name", "chunk_id")


_RANKED = f"""{_SYM}, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY commit_hash) AS rn_ FROM edges) WHERE rn_ = 1),
i AS (SELECT s.id AS symbol_id, s.file_path AS anchor, e.* FROM sym s JOIN e ON e.from_id = s.id UNION ALL SELECT s.id, s.file_path, e.* FROM sym s JOIN e ON e.to_id = s.id WHERE e.from_id IS DISTINCT FROM e.to_id),
l AS (SELECT *, (from_id = symbol_id)::INT + (to_id = symbol_id)::INT AS em, CASE WHEN commit_hash = max(commit_hash) OVER (PARTITION BY symbol_id) THEN 0 ELSE 1 END AS cp,
  list_filter(string_split(regexp_replace(anchor, '/?[^/]*$', ''), '/'), lambda x: x <> '') AS pa, list_filter(string_split(regexp_replace(file_path, '/?[^/]*$', ''), '/'), lambda x: x <> '') AS pb FROM i),
m AS (SELECT *, len(pa) + len(pb) - 2 * len(list_filter(range(1, least(len(pa), len(pb)) + 1), lambda k: pa[1:k] = pb[1:k])) AS md FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY em DESC, confidence DESC, md, cp, file_path, line, edge_id) AS rank FROM m)"""


@query(f"WITH {_RANKED} SELECT symbol_id, rank, edge_id, em AS endpoint_match, md AS module_distance FROM r WHERE rank <= 5")
def neighbors_ranked(spark, d):
    e = load(spark, d, "edges").groupBy("edge_id").agg(F.min_by(F.struct("edge_type", "from_id", "to_id", "file_path", "line", "confidence", "commit_hash"), "commit_hash").alias("r"), F.min(F.struct("edge_type", "from_id", "to_id", "file_path", "line", "confidence", "commit_hash")).alias("z"))
    e = e.select("edge_id", F.coalesce("r", "z").alias("r")).select("edge_id", "r.*")
    anchors = load(spark, d, "symbols").groupBy(F.col("id").alias("symbol_id")).agg(F.min("file_path").alias("anchor_path"))
    return G.neighbors(e, anchors, 5).select("symbol_id", F.col("rank").cast("long").alias("rank"), "edge_id", "endpoint_match", F.col("module_distance").cast("long").alias("module_distance"))


@query("""SELECT DISTINCT edge_id, confidence, file_path, line FROM edges WHERE to_id = 'unresolved:emit_trace' AND edge_type = 'CALLS' ORDER BY confidence DESC, file_path, line, edge_id LIMIT 50""")
def incoming_edges(spark, d):
    return R.edges_of(load(spark, d, "edges"), "unresolved:emit_trace", "incoming", "CALLS", 50).select("edge_id", "confidence", "file_path", "line")


@query("SELECT max(commit_hash) AS latest_commit FROM edges WHERE commit_hash NOT IN ('', 'unknown')")
def latest_commit(spark, d):
    return G.latest_commit(load(spark, d, "edges"))


@query("""WITH l AS (SELECT text_hash, arg_max(vector, (updated_at, vector)) AS v FROM embedding_ledger WHERE embedding_profile = 'mini-64' AND record_kind = 'edge' GROUP BY 1),
q AS (SELECT v FROM l WHERE len(v) = 64 ORDER BY text_hash LIMIT 1), e AS (SELECT DISTINCT ON (edge_id) * FROM edges WHERE text IS NOT NULL ORDER BY edge_id, text),
x AS (SELECT edge_id, confidence, file_path, line, round(greatest(0, least(1, 1 - list_sum(list_transform(list_zip(l.v, q.v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) / 2)), 9) AS s FROM e JOIN l ON l.text_hash = sha256(e.text), q WHERE len(l.v) = 64 AND NOT list_bool_or(list_transform(l.v, lambda y: isnan(y))))
SELECT edge_id, confidence, s AS similarity FROM x ORDER BY s DESC, confidence DESC, file_path, line, edge_id LIMIT 10""")
def graph_semantic_search(spark, d):
    led = load(spark, d, "embedding_ledger").filter("embedding_profile = 'mini-64' AND record_kind = 'edge'")
    led = led.groupBy("text_hash").agg(F.max(F.struct("updated_at", "vector")).alias("r")).select("text_hash", F.col("r.vector").alias("embedding_vector"))
    led = led.filter("size(embedding_vector) = 64 AND NOT exists(embedding_vector, x -> isnan(x))")
    probe = led.orderBy("text_hash").first()
    e = load(spark, d, "edges").filter("text IS NOT NULL").drop("embedding_vector")
    e = R.first_per(e, ["edge_id"], ["text"]).withColumn("text_hash", F.sha2("text", 256)).join(led, "text_hash")
    return G.search_edges(e, list(probe.embedding_vector) if probe else [0.0] * 64, 10).select("edge_id", "confidence", "similarity")


def _hits(spark, d) -> tuple[DataFrame, DataFrame]:
    """Hits of a batch of queries, one per external name: edges that call it (exact) and symbols whose calls name it (symbol)."""
    ext = load(spark, d, "externals").select("name").filter("name IS NOT NULL").distinct()
    q = ext.select(F.col("name").alias("query_id"), F.lit("mixed").alias("kind"), F.lit("code").alias("domain"), F.array(F.lower("name")).alias("tokens"), F.lit(12).alias("max_snippets"), F.lit(False).alias("literal_first"))
    e = load(spark, d, "edges").dropDuplicates(["edge_id"]).filter("file_path IS NOT NULL AND line IS NOT NULL")
    e = e.withColumn("name", F.regexp_extract("to_id", "^unresolved:(.*)$", 1)).join(ext, "name")
    none = F.array().cast("array<string>")
    top = lambda df, k: df.withColumn("idx", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "path", "start_line", "snippet")) - 1).filter(F.col("idx") < k)
    a = e.select(F.col("name").alias("query_id"), F.lit("exact").alias("backend"), F.col("file_path").alias("path"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.concat_ws(" ", "edge_type", "name").alias("snippet"), F.col("confidence").alias("raw_score"), none.alias("tags"), F.lit("reference").alias("match_role")).distinct()
    s = one_per_id(load(spark, d, "symbols")).select("name", "file_path", "start_line", "end_line", F.explode(F.array_distinct("calls")).alias("call"))
    s = s.join(ext.withColumnRenamed("name", "call"), "call")
    b = s.select(F.col("call").alias("query_id"), F.lit("symbol").alias("backend"), F.col("file_path").alias("path"), "start_line", "end_line", F.col("name").alias("snippet"), F.lit(0.74).alias("raw_score"), F.array(F.lit("symbol_ref")).alias("tags"), F.lit("reference").alias("match_role")).distinct()
    return top(a, RT.TOP_K["exact"]).unionByName(top(b, RT.TOP_K["symbol"])), q


_HITS = """ex AS (SELECT DISTINCT name FROM externals WHERE name IS NOT NULL),
ha AS (SELECT DISTINCT ex.name AS query_id, 'exact' AS backend, file_path AS path, line AS start_line, line AS end_line, edge_type || ' ' || ex.name AS snippet, confidence AS raw_score FROM edges JOIN ex ON to_id = 'unresolved:' || ex.name WHERE file_path IS NOT NULL AND line IS NOT NULL),
hb AS (SELECT DISTINCT call AS query_id, 'symbol' AS backend, file_path AS path, start_line, end_line, name AS snippet, 0.74 AS raw_score FROM (SELECT name, file_path, start_line, end_line, unnest(calls) AS call FROM symbols) WHERE call IN (SELECT name FROM ex)),
hu AS (SELECT *, row_number() OVER (PARTITION BY query_id, backend ORDER BY raw_score DESC, path, start_line, snippet) AS r FROM (SELECT * FROM ha UNION ALL SELECT * FROM hb)),
hits AS (SELECT * FROM hu WHERE r <= CASE backend WHEN 'exact' THEN 24 ELSE 16 END)"""


@query(f"""WITH {_HITS}, v AS (SELECT query_id, path, start_line, end_line, round(sum(1.0::DOUBLE / (60 + r)), 9) AS vote FROM hits GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vote DESC, path, start_line, end_line) AS rank FROM v) SELECT * FROM k WHERE rank <= 12""")
def rrf_fusion(spark, d):
    return X.rrf(_hits(spark, d)[0]).withColumn("rank", F.col("rank").cast("long"))


_QUALITY = rf"""{_HITS}, o AS (SELECT *, CASE WHEN {_SOURCE} THEN 1.0 WHEN {_TEST} THEN 0.82 ELSE 0.66 END AS pq, ({_SOURCE} OR {_TEST})::INT AS au,
  list_contains(list_transform(regexp_extract_all(path || chr(10) || snippet, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x)), lower(query_id))::INT AS ov FROM hits),
g AS (SELECT query_id, backend, count(*) AS n, max(raw_score) AS t, avg(pq) AS pq, avg(ov) AS ov, avg(au) AS au, least(1, count(*) / 12) AS de FROM o GROUP BY ALL),
qu AS (SELECT query_id, backend, n, round(greatest(0, least(1, CASE backend WHEN 'exact' THEN 0.40 * t + 0.20 * de + 0.20 * pq + 0.10 * ov + 0.10 * au ELSE 0.40 * t + 0.25 * de + 0.20 * pq + 0.15 * ov END)), 6) AS quality FROM g)"""


@query(f"WITH {_QUALITY} SELECT query_id, backend, n AS n_hits, quality FROM qu")
def backend_quality(spark, d):
    return X.backend_quality(*_hits(spark, d)).select("query_id", "backend", "n_hits", F.round("quality", 6).alias("quality"))


@query(f"""WITH {_QUALITY}, b AS (SELECT query_id, backend, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, backend) AS i FROM qu WHERE quality >= CASE backend WHEN 'exact' THEN 0.70 ELSE 0.68 END)
SELECT ex.name AS query_id, CASE WHEN b.backend IS NOT NULL THEN b.backend WHEN NOT EXISTS (SELECT 1 FROM qu WHERE query_id = ex.name) THEN 'suppressed' ELSE 'hybrid' END AS strategy FROM ex LEFT JOIN b ON b.query_id = ex.name AND b.i = 1""")
def route_argmax(spark, d):
    hits, q = _hits(spark, d)
    return X.route(X.backend_quality(hits, q), q).select("query_id", "strategy")


@query()
def fusion_allocation(spark, d):
    hits, q = _hits(spark, d)
    return X.fuse(hits, X.weights(X.backend_quality(hits, q)))


@query(f"""WITH {_HITS}, l AS (SELECT * FROM hits WHERE backend = 'exact'), s AS (SELECT * FROM hits WHERE backend = 'symbol'),
o AS (SELECT l.query_id, l.r, max(s.raw_score + CASE WHEN NOT (l.end_line < s.start_line OR s.end_line < l.start_line) THEN 0.05 WHEN abs(l.start_line - s.start_line) <= 4 THEN 0.02 ELSE 0 END) AS g FROM l JOIN s ON l.query_id = s.query_id AND l.path = s.path GROUP BY ALL),
x AS (SELECT l.query_id, l.path, l.start_line, l.snippet, l.raw_score, l.r, round(least(1, coalesce(g, 0)), 9) AS overlap FROM l LEFT JOIN o ON o.query_id = l.query_id AND o.r = l.r)
SELECT query_id, path, start_line, snippet, overlap, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, raw_score DESC, r) - 1 AS new_idx FROM x""")
def rerank_overlap(spark, d):
    hits = _hits(spark, d)[0]
    out = X.rerank(hits.filter("backend = 'exact'"), hits.filter("backend = 'symbol'"))
    return out.select("query_id", "path", "start_line", "snippet", "overlap", F.col("new_idx").cast("long").alias("new_idx"))


@query(f"""WITH {_HITS}, t AS (SELECT query_id, raw_score, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC) AS i FROM hits)
SELECT query_id, round(least(1, 0.7 * max(raw_score) + 0.3 * avg(raw_score)), 9) AS confidence FROM t WHERE i <= 3 GROUP BY query_id""")
def confidence_top3(spark, d):
    return X.retrieval_confidence(_hits(spark, d)[0])


@query(f"""WITH {_HITS} SELECT query_id, count(*) AS n_items, count(*) FILTER (raw_score >= 0.6) AS n_confident, count(*) FILTER (raw_score >= 0.6) >= 1 AS grounded FROM hits GROUP BY query_id""")
def evidence_grounding(spark, d):
    return X.evidence(_hits(spark, d)[0]).drop("reason")


@query()
def routed_search(spark, d):
    """The whole path from query text to packed hits, over all sources."""
    src = sources(spark, d)
    index = RT.Index(T.lines(src), O.build(src, load(spark, d, "symbols")))
    return RT.search(index, LITERAL)[0].drop("tags")
