"""A search from query text to packed hits and a decision. The driver reads the query and picks the plans; data stays distributed."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import grep_compat
from tessera.functions import paths as P
from tessera.functions.hints import Hints, analyze
from tessera.operators import fusion, lexical, occurrences

TOP_K = {"exact": 24, "symbol": 16, "semantic": 24}
MODES = {"auto": ["exact", "symbol", "semantic"], "exact": ["exact"], "symbol": ["symbol"], "semantic": ["semantic"], "hybrid": ["exact", "symbol", "semantic"], "lexical": ["exact", "symbol"]}


@dataclass
class Index:
    """What a search reads. semantic: a function from (hints, filter, k) to hits path, start_line, end_line, snippet, raw_score, or None.

    health: one row as `health.snapshot` makes it; where it doesn't allow vectors a search goes without them.
    """

    lines: DataFrame
    occurrences: DataFrame
    semantic: object = None
    health: DataFrame | None = None


@dataclass
class Intent:
    prefixes: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    max_files: int = fusion.MAX_FILES
    max_snippets: int = fusion.MAX_SNIPPETS
    mode: str = "auto"
    #: What the hits should be about: vectors then rescue or reorder the lexical hits of the query, they don't compete with them.
    about: str | None = None


# Fixed value: words that ask for documentation or examples themselves.
AUXILIARY_INTENT = r"(?i)\b(doc|docs|readme|changelog|history|news|release(?:-notes)?|guide|tutorial|example|examples)\b"


def _where(i: Intent, g: grep_compat.Grep) -> Column | None:
    prefixes, include, exclude = [*i.prefixes, *g.paths], [*i.include, *g.include], [*i.exclude, *g.exclude]
    return P.allowed("path", prefixes, include, exclude) if prefixes or include or exclude else None


def _shape(df: DataFrame, backend: str, tags: Column, order: list) -> DataFrame:
    from pyspark.sql import Window

    rows = df.withColumn("idx", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1).cast("int"))  # of a backend's top k
    return rows.select(F.lit("q").alias("query_id"), F.lit(backend).alias("backend"), "idx", "path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "snippet", F.col("raw_score").cast("double").alias("raw_score"), tags.alias("tags"), "match_role")


def exact_hits(index: Index, h: Hints, g: grep_compat.Grep, where: Column | None) -> DataFrame:
    df = lexical.search(index.lines, h, TOP_K["exact"], where, case=g.case, word=g.word, fixed=g.fixed)
    named = h.domain == "code" and h.kind in ("identifier", "declaration")
    order = ([lexical.role_priority("match_role")] if named else []) + [F.desc("raw_score"), "path", "start_line"]
    return _shape(df, "exact", F.array(F.lit("literal_match" if h.literals or h.verbatim else "symbol_match")), order)


def symbol_hits(index: Index, h: Hints, g: grep_compat.Grep, where: Column | None) -> DataFrame:
    df = occurrences.search(index.occurrences, h, TOP_K["symbol"], where, case_sensitive=g.command is not None and g.case == "sensitive", exact_only=g.word or g.fixed)
    first = F.when(F.col("kind") == "def", "definition").otherwise("reference")
    df = df.withColumns({"snippet": F.col("symbol"), "match_role": first})
    return _shape(df, "symbol", F.array(F.concat(F.lit("symbol_"), "kind")), [F.when(F.col("kind") == "def", 0).otherwise(1), F.desc("raw_score"), "path", "start_line"])


def semantic_hits(index: Index, h: Hints, where: Column | None) -> DataFrame:
    df = index.semantic(h, where, TOP_K["semantic"])
    tags = F.when(F.col("raw_score") >= 0.8, F.array(F.lit("semantic_high_conf"))).otherwise(F.array().cast("array<string>"))
    return _shape(df.withColumn("match_role", F.lit(None).cast("string")), "semantic", tags, [F.desc("raw_score"), "path", "start_line"])


def _fixed(df: DataFrame) -> DataFrame:
    """The rows of a bounded result (the top k of a query) as a local table, so that what reads them next doesn't search again.

    It has one partition, which meets what any window, aggregate or join asks for, so the steps on it need no shuffle.
    """
    return df.sparkSession.createDataFrame(df.collect(), df.schema).coalesce(1)


def auxiliary_asked(query: str, i: Intent) -> bool:
    paths = [x.replace("\\", "/").lower() for x in [*i.prefixes, *i.include]]
    return bool(re.search(AUXILIARY_INTENT, query)) or any("/docs" in x or "/examples" in x or "readme" in x for x in paths)


def _keeps_order(strategy: str, h: Hints) -> bool:
    named = h.domain == "code" and h.kind in ("identifier", "declaration")
    return strategy == "hybrid" or h.domain == "code" and h.kind == "mixed" or strategy in ("exact", "symbol") and named


def _choose(hits: DataFrame, quality: DataFrame, strategy: str, queries: DataFrame, h: Hints, slots: int) -> DataFrame:
    """The hits of the strategy in their order."""
    if strategy == "suppressed":
        return hits.limit(0)
    chosen = fusion.fuse(hits, fusion.weights(quality), slots).drop("vote") if strategy == "hybrid" else hits.filter(F.col("backend") == strategy)
    if h.domain == "code" and h.kind == "mixed":
        chosen = fusion.rebalance(chosen, queries).drop("idx").withColumnRenamed("new_idx", "idx")
    return chosen


def _route_to(queries: DataFrame, strategy: str, reason: str) -> DataFrame:
    return queries.select("query_id", F.lit(strategy).alias("strategy"), F.lit(reason).alias("reason"))


def search(index: Index, query: str, intent: Intent | None = None) -> tuple[DataFrame, DataFrame]:
    """(packed hits, decision). Lexical backends run first; vectors only if they are needed to answer. Both results are bounded and local.

    decision: one row: query_id, strategy, n_hits, decisive, next_action, suggested_prefix, status, reason, assist (none, rerank, semantic_rescue).
    """
    i = intent or Intent()
    g = grep_compat.parse(query)
    h = analyze(g.pattern if g.pattern else query)
    spark, where = index.lines.sparkSession, _where(i, g)
    queries = spark.createDataFrame([("q", h.kind, h.domain, h.tokens, i.max_snippets, h.literal_first)], "query_id string, kind string, domain string, tokens array<string>, max_snippets int, literal_first boolean").coalesce(1)
    wanted = MODES[i.mode]
    vectors = "semantic" in wanted and index.semantic is not None and (index.health is None or index.health.first().semantic_allowed)
    hits = None
    for f, b in ((exact_hits, "exact"), (symbol_hits, "symbol")):
        if b in wanted:
            found = _fixed(f(index, h, g, where))
            hits = found if hits is None else hits.unionByName(found)
    if hits is None and not vectors:
        raise ValueError("no backend can answer this mode")
    if i.about is not None and hits is not None:
        return _about(index, i, h, hits, queries, where, vectors, auxiliary_asked(query, i))
    if vectors and (hits is None or i.mode == "hybrid" or _needs_vectors(hits, queries, h, i)):
        more = _fixed(semantic_hits(index, analyze(i.about) if i.about else h, where))
        hits = more if hits is None else hits.unionByName(more)
    quality = _fixed(fusion.backend_quality(hits, queries, h.domain))  # read by the route, the weights and the decision
    routes = _route_to(queries, "hybrid", "forced_mode") if i.mode == "hybrid" else _fixed(fusion.route(quality, queries))
    strategy = routes.first().strategy
    packed = _fixed(fusion.pack(_choose(hits, quality, strategy, queries, h, i.max_snippets), _keeps_order(strategy, h), i.max_files, i.max_snippets))
    return packed, _decision(h, packed, routes, quality, queries)


def _decision(h: Hints, packed: DataFrame, routes: DataFrame, quality: DataFrame, queries: DataFrame, rescued: DataFrame | None = None, assist: str = "none") -> DataFrame:
    return _fixed(fusion.decide(packed, routes, quality, queries, rescued, h.domain).join(routes.select("query_id", "reason"), "query_id").withColumn("assist", F.lit(assist)))


def _about(index: Index, i: Intent, h: Hints, hits: DataFrame, queries: DataFrame, where: Column | None, vectors: bool, auxiliary_wanted: bool) -> tuple[DataFrame, DataFrame]:
    """Lexical hits decide; if they don't, or only documentation and examples came up, vectors rescue the search with one sure hit or reorder the hits."""
    quality = _fixed(fusion.backend_quality(hits, queries, h.domain))  # read by the route, the weights and the decision
    routes = _route_to(queries, "hybrid", "forced_mode") if i.mode == "hybrid" else _fixed(fusion.route(quality, queries, lexical_only=True))
    strategy, reason = routes.first().strategy, routes.first().reason
    chosen, keep = _choose(hits, quality, strategy, queries, h, i.max_snippets), _keeps_order(strategy, h)
    pack = lambda df, preserve: _fixed(fusion.pack(df, preserve, i.max_files, i.max_snippets))
    packed = pack(chosen, keep)
    decision = _decision(h, packed, routes, quality, queries)
    flags, d = fusion.flags(packed, queries, h.domain).first(), decision.first()
    auxiliary_only = bool(flags.auxiliary_only) and not auxiliary_wanted
    if not vectors or not auxiliary_only and (flags.authority_scoped or d.decisive and not flags.many_paths):
        return packed, decision
    near = _fixed(semantic_hits(index, analyze(i.about), where))
    if not flags.n_hits or auxiliary_only:
        sure = _fixed(fusion.rescue(near, queries))
        if sure.count():
            packed = pack(sure, True)
            return packed, _decision(h, packed, _route_to(queries, "semantic", "semantic_rescue"), quality, queries, sure, "semantic_rescue")
        if auxiliary_only:
            packed = packed.limit(0)
            return packed, _decision(h, packed, _route_to(queries, "suppressed", "semantic_rescue_not_confident"), quality, queries)
        return packed, decision
    order = _fixed(fusion.rerank(chosen, near))
    if order.filter("overlap > 0 AND new_idx <> idx").isEmpty():
        return packed, decision
    packed = pack(order.drop("idx", "overlap").withColumnRenamed("new_idx", "idx"), True)
    return packed, _decision(h, packed, _route_to(queries, strategy, "semantic_rerank"), quality, queries, assist="rerank")


def _needs_vectors(hits: DataFrame, queries: DataFrame, h: Hints, i: Intent) -> bool:
    if h.kind in ("identifier", "declaration") or h.literal_first:
        return hits.isEmpty()
    quality = fusion.backend_quality(hits, queries, h.domain)
    strategy = fusion.route(quality, queries).first().strategy
    if strategy not in ("hybrid", "suppressed"):
        return False
    first = fusion.pack(_choose(hits, quality, strategy, queries, h, i.max_snippets), strategy == "hybrid", i.max_files, i.max_snippets)
    return not fusion.flags(first, queries, h.domain).first().authority_scoped


def search_with_retry(find: Callable[[int], DataFrame], k: int, threshold: float, attempts: int) -> tuple[DataFrame, dict]:
    """Asks for more hits until their confidence reaches the threshold: (hits, how it went). find: hits (query_id, raw_score, ...) of the top k."""
    hits = _fixed(find(k))
    sure = lambda df: (fusion.retrieval_confidence(df).first() or [None, 0.0])[1]
    first = last = sure(hits)
    used, n = k, 0
    while n < attempts and last < threshold and (more := fusion.next_top_k(used)) != used:
        hits, used, n = _fixed(find(more)), more, n + 1
        last = sure(hits)
    return hits, {"initial_confidence": first, "final_confidence": last, "initial_top_k": k, "final_top_k": used, "retry_attempts": n, "retry_performed": n > 0, "low_confidence": last < threshold}


def as_json(packed: DataFrame) -> DataFrame:
    """One JSON line per hit, in order."""
    return packed.orderBy("query_id", "rank").select(F.to_json(F.struct(*packed.columns)).alias("value"))
