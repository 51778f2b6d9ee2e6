"""Queries over hierarchies (p1) and references (p4), with SQL for the ones that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import hierarchy as H
from tessera.operators import orphans as O
from tessera.runtime import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.hierarchy(load(spark, sf_dir, "symbols"), paths=False).filter("parent IS NOT NULL").select("id", "root_id", "depth")


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.hierarchy(load(spark, sf_dir, "symbols")).select("id", "root_id", "depth", "path", "n_above")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.descendants(H.hierarchy(load(spark, sf_dir, "symbols"), paths=False))


def p1_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.circles(H.hierarchy(load(spark, sf_dir, "symbols"), paths=False))


def _orphan_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [load(spark, sf_dir, t) for t in ("chunks", "symbols", "commits", "externals", "file_changes")]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.orphan_report(*_orphan_tables(spark, sf_dir))


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.orphan_summary(O.orphan_report(*_orphan_tables(spark, sf_dir)))


def p4_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.orphan_keys(O.key_counts(*_orphan_tables(spark, sf_dir))).select("kind", "scope", "ref", "refs", "live", "removed")


def p4_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found from counts that are kept over batches; the last one takes back what files lost that were removed in the later half of the changes."""
    tables = _orphan_tables(spark, sf_dir)
    middle = tables[-1].agg(F.floor((F.min("seq") + F.max("seq")) / 2).cast("long").alias("m")).first().m
    return O.report_in_batches(*tables, upto_seq=middle or 0)


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_circles, p4_found, p4_summary, p4_keys, p4_batches)}

_NODES = r"""
RECURSIVE n AS (
  SELECT id, min(CASE WHEN regexp_matches(container_id, '\S') THEN container_id END) AS parent, min(name) AS name
  FROM symbols WHERE id IS NOT NULL GROUP BY id),
l AS (SELECT n.id, p.id AS parent, n.name FROM n LEFT JOIN n p ON n.parent = p.id),
w AS (
  SELECT id, parent AS cur, 1 AS steps, [id, parent] AS seen, false AS loop FROM l WHERE parent IS NOT NULL
  UNION ALL
  SELECT w.id, l.parent, w.steps + 1, list_append(w.seen, l.parent), list_contains(w.seen, l.parent)
  FROM w JOIN l ON l.id = w.cur WHERE l.parent IS NOT NULL AND NOT w.loop),
d AS (
  SELECT id, cur, steps, seen, loop, row_number() OVER (PARTITION BY id ORDER BY steps DESC) AS rn FROM w),
f AS (
  SELECT id, CASE WHEN NOT loop AND NOT (id = cur) THEN cur ELSE list_min(list_slice(seen, list_position(seen, cur), len(seen))) END AS root_id,
    CASE WHEN NOT loop AND NOT (id = cur) THEN steps WHEN list_position(seen, cur) = 1 THEN -1 ELSE -2 END AS depth
  FROM d WHERE rn = 1)
"""

_ABOVE = """,
ring AS (SELECT w.id, min(w.steps) AS s FROM w JOIN f g ON g.id = w.cur AND g.depth = -1 GROUP BY w.id),
up AS (SELECT w.cur AS ancestor_id, w.id AS descendant_id, CAST(w.steps AS INTEGER) AS distance FROM w JOIN f ON f.id = w.id LEFT JOIN ring e ON e.id = w.id WHERE f.depth >= 0 OR (f.depth = -2 AND w.steps <= e.s))
"""

_ORPHANS = r"""
gone AS (SELECT path FROM file_changes GROUP BY path HAVING arg_max(op, seq) = 'deleted'),
rec AS (
  SELECT 'chunks' AS table_name, 'id' AS kind, k.chunk_id AS record_id, k.symbol_id AS ref, '' AS scope, min(c.committed_at) AS tm
  FROM chunks k LEFT JOIN commits c USING (commit_hash) WHERE regexp_matches(k.symbol_id, '\S') GROUP BY ALL
  UNION ALL
  SELECT 'symbols', 'id', s.id, s.container_id, '', t.tm FROM (SELECT DISTINCT id, container_id FROM symbols) s
  JOIN (SELECT id, min(committed_at) AS tm FROM symbols LEFT JOIN commits USING (commit_hash) GROUP BY id) t ON s.id = t.id
  WHERE regexp_matches(s.container_id, '\S')
  UNION ALL
  SELECT DISTINCT 'calls', 'call', s.id, s.ref, s.repo_id, t.tm FROM (SELECT id, repo_id, unnest(calls) AS ref FROM symbols) s
  JOIN (SELECT id, min(committed_at) AS tm FROM symbols LEFT JOIN commits USING (commit_hash) GROUP BY id) t ON s.id = t.id
  WHERE regexp_matches(s.ref, '\S') AND s.ref NOT IN (SELECT name FROM externals)),
rows_ AS (
  SELECT s.id, s.name, s.fqname, s.repo_id, c.committed_at AS tm, s.file_path IN (SELECT path FROM gone) AS gone
  FROM symbols s LEFT JOIN commits c USING (commit_hash)),
keys_ AS (
  SELECT 'id' AS kind, '' AS scope, id AS ref, gone, tm FROM rows_
  UNION ALL SELECT 'call', repo_id, name, gone, tm FROM rows_
  UNION ALL SELECT 'call', repo_id, fqname, gone, tm FROM rows_ WHERE fqname IS DISTINCT FROM name),
have AS (
  SELECT kind, scope, ref, count(*) FILTER (NOT gone) AS live, count(*) FILTER (gone) AS removed, min(tm) FILTER (NOT gone) AS born
  FROM keys_ WHERE ref IS NOT NULL GROUP BY ALL),
report AS (
  SELECT DISTINCT r.table_name, strftime(r.tm AT TIME ZONE 'UTC', '%Y-%m') AS period, r.record_id, r.ref,
    CASE WHEN h.ref IS NULL THEN 'absent' WHEN h.live = 0 THEN 'deleted' WHEN h.born > r.tm THEN 'late' END AS state
  FROM rec r LEFT JOIN have h ON r.kind = h.kind AND r.scope = h.scope AND r.ref = h.ref)
"""

SQL = {
    "p1_found": f"WITH {_NODES} SELECT id, root_id, CAST(depth AS INTEGER) AS depth FROM f",
    "p1_paths": f"""WITH {_NODES} {_ABOVE}, p AS (SELECT descendant_id AS id, string_agg(coalesce(l.name, '?'), '.' ORDER BY distance DESC) AS names, count(*) AS k FROM up JOIN l ON l.id = ancestor_id GROUP BY 1)
      SELECT l.id, coalesce(f.root_id, l.id) AS root_id, CAST(coalesce(f.depth, 0) AS INTEGER) AS depth, coalesce(p.names || '.', '') || coalesce(l.name, '?') AS path, CAST(coalesce(p.k, 0) AS INTEGER) AS n_above
      FROM l LEFT JOIN f ON f.id = l.id LEFT JOIN p ON p.id = l.id""",
    "p1_descendants": f"WITH {_NODES} {_ABOVE} SELECT * FROM up",
    "p1_circles": f"WITH {_NODES} SELECT root_id, count(*) FILTER (depth = -1) AS on_circle, count(*) FILTER (depth = -2) AS leading_in FROM f WHERE depth < 0 GROUP BY root_id",
    "p4_found": f"WITH {_ORPHANS} SELECT * FROM report WHERE state IS NOT NULL",
    "p4_batches": f"WITH {_ORPHANS} SELECT * FROM report WHERE state IS NOT NULL",
    "p4_summary": f"WITH {_ORPHANS} SELECT table_name, period, state, count(*) AS n FROM report WHERE state IS NOT NULL GROUP BY ALL",
    "p4_keys": f"""WITH {_ORPHANS} SELECT r.kind, r.scope, r.ref, r.refs, coalesce(h.live, 0) AS live, coalesce(h.removed, 0) AS removed
      FROM (SELECT kind, scope, ref, count(*) AS refs FROM rec GROUP BY ALL) r LEFT JOIN have h ON r.kind = h.kind AND r.scope = h.scope AND r.ref = h.ref
      WHERE coalesce(h.live, 0) = 0""",
}
