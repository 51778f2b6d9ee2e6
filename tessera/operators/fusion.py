"""Backend quality, routing, fusion, packing and decisions, for many queries at once.

hits: query_id, backend (exact, symbol, semantic), idx (place in its backend, from 0), path, start_line, end_line, snippet, raw_score, tags, match_role.
queries: query_id, kind, domain, tokens (of the query), max_snippets. A backend returns a bounded top k, so the hits of one query are few; folds that depend
on order run per query over them, everything else is grouped or windowed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions.text import clip, identifiers
from tessera.functions.vectors import clamp
from tessera.operators.lexical import DEFINITION

# Thresholds and limits of the router.
THRESHOLDS = {"exact": 0.70, "symbol": 0.68, "semantic": 0.66}
PRIORITY = {"exact": 0, "symbol": 1, "semantic": 2}
MAX_FILES, MAX_SNIPPETS, MAX_CHARS, SNIPPET_CHARS = 8, 12, 12_000, 320
RRF = 60
HITS = "query_id string, backend string, idx int, path string, start_line int, end_line int, snippet string, raw_score double, tags array<string>, match_role string"


def by_domain(domain: str, make, only: str | None = None) -> Column:
    """A column expression that depends on each row's domain of query; where all queries are of one domain, that of this domain alone."""
    if only is not None:
        return make(only)
    return F.when(F.col(domain) == "docs_policy", make("docs_policy")).when(F.col(domain) == "workflow_config", make("workflow_config")).otherwise(make("code"))


def token_overlap(text: Column, tokens: Column) -> Column:
    own = F.transform(identifiers(text), F.lower)
    n = F.size(F.array_distinct(tokens))
    return F.when(n > 0, F.least(F.lit(1.0), F.size(F.array_intersect(own, tokens)) / n)).otherwise(0.0)


def backend_quality(hits: DataFrame, queries: DataFrame, only: str | None = None) -> DataFrame:
    """query_id, backend, n_hits, quality, support, top_score, threshold_met: one group per query and backend, one more for the modal directory."""
    q = queries.select("query_id", "domain", "tokens", "max_snippets")
    h = hits.join(q, "query_id")
    over = token_overlap(F.concat_ws("\n", "path", "snippet"), F.col("tokens"))
    h = h.withColumns({"pq": by_domain("domain", lambda d: P.quality("path", d), only), "ov": over, "auth": by_domain("domain", lambda d: P.is_authority("path", d), only).cast("int"), "dir": P.parent("path")})
    h = h.withColumn("i", F.row_number().over(Window.partitionBy("query_id", "backend").orderBy(F.desc("raw_score"), "idx")))
    tag = lambda *t: F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, t)))
    tagged = F.when(F.col("backend") == "exact", tag("literal_match", "symbol_match")).when(F.col("backend") == "symbol", tag("symbol_def", "symbol_ref")).otherwise(tag("semantic_high_conf"))
    dirs = h.groupBy("query_id", "backend", "dir").agg(F.count("*").alias("n")).groupBy("query_id", "backend").agg(F.max("n").alias("modal"))
    g = h.groupBy("query_id", "backend").agg(
        F.count("*").alias("n_hits"), F.max("raw_score").alias("top1"), F.max(F.when(F.col("i") == 2, F.col("raw_score"))).alias("top2"), F.avg("pq").alias("pq"), F.avg("ov").alias("ov"),
        F.avg("auth").alias("auth"), F.avg(F.coalesce(tagged, F.lit(False)).cast("int")).alias("tagged"), F.max("max_snippets").alias("cap"))
    g = g.join(dirs, ["query_id", "backend"]).withColumn("density", F.least(F.lit(1.0), F.col("n_hits") / F.greatest(F.lit(1), "cap")))
    exact = 0.40 * F.col("top1") + 0.20 * F.col("density") + 0.20 * F.col("pq") + 0.10 * F.col("ov") + 0.10 * F.col("auth")
    symbol = 0.40 * F.col("top1") + 0.25 * F.col("density") + 0.20 * F.col("pq") + 0.15 * F.col("ov")
    semantic = 0.36 * F.col("top1") + 0.20 * clamp(F.col("top1") - F.coalesce("top2", F.lit(0.0))) + 0.18 * F.col("modal") / F.col("n_hits") + 0.14 * F.col("pq") + 0.12 * F.col("ov")
    pick = lambda a, b, c: F.when(F.col("backend") == "exact", a).when(F.col("backend") == "symbol", b).otherwise(c)
    support = pick(0.50 + 0.30 * F.col("ov") + 0.20 * F.col("tagged"), 0.42 + 0.35 * F.col("ov") + 0.23 * F.col("tagged"), 0.25 + 0.55 * F.col("ov") + 0.20 * F.col("tagged"))
    out = g.select("query_id", "backend", "n_hits", F.round(clamp(pick(exact, symbol, semantic)), 9).alias("quality"), F.round(clamp(support), 9).alias("support"), "density", F.col("top1").alias("top_score"))
    return out.withColumn("threshold_met", F.col("quality") >= pick(*(F.lit(THRESHOLDS[b]) for b in PRIORITY)))


def weights(quality: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """Adds weight, from quality, density, support and, if timings (query_id, backend, timing_ms) are given, the share of latency."""
    q = quality
    if timings is None:
        late = F.lit(0.0)
    else:
        q = q.join(timings, ["query_id", "backend"], "left").withColumn("most", F.max("timing_ms").over(Window.partitionBy("query_id")))
        late = clamp(F.coalesce(F.col("timing_ms") / F.greatest(F.lit(1), "most"), F.lit(0.0)))
    raw = 0.55 * F.col("quality") + 0.20 * F.col("density") + 0.15 * F.col("support") + 0.10 * (1 - late)
    out = q.withColumn("weight", F.round(clamp(raw * F.when(F.col("threshold_met"), 1.0).otherwise(0.65)), 9))
    return out if timings is None else out.drop("most", "timing_ms")


def priority() -> Column:
    return F.when(F.col("backend") == "exact", 0).when(F.col("backend") == "symbol", 1).otherwise(2)


def route(quality: DataFrame, queries: DataFrame, lexical_only: bool = False) -> DataFrame:
    """query_id, strategy, reason: the best qualified backend, else hybrid; suppressed without lexical hits."""
    q = quality.filter("backend <> 'semantic'") if lexical_only else quality
    best = q.filter("threshold_met").groupBy("query_id").agg(F.min_by("backend", F.struct(-F.col("quality"), priority())).alias("best"))
    lex = q.groupBy("query_id").agg(F.max((F.col("backend") != "semantic").cast("int")).alias("lexical"))
    rows = queries.select("query_id").distinct().join(best, "query_id", "left").join(lex, "query_id", "left")
    none = F.coalesce("lexical", F.lit(0)) == 0
    return rows.select("query_id", F.when(F.col("best").isNotNull(), F.col("best")).when(none, "suppressed").otherwise("hybrid").alias("strategy"),
                       F.when(F.col("best").isNotNull(), "quality_threshold_met").when(none, "no_lexical_hits" if lexical_only else "semantic_only_below_threshold").otherwise("no_backend_met_threshold").alias("reason"))


def rrf(hits: DataFrame, k: int = MAX_SNIPPETS) -> DataFrame:
    """query_id, path, start_line, end_line, vote, rank: reciprocal ranks summed over equal spans."""
    r = F.row_number().over(Window.partitionBy("query_id", "backend").orderBy("idx"))
    v = hits.withColumn("r", r).groupBy("query_id", "path", "start_line", "end_line").agg(F.round(F.sum(F.lit(1.0) / (RRF + F.col("r"))), 9).alias("vote"))
    return v.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("vote"), "path", "start_line", "end_line"))).filter(F.col("rank") <= k)


def allocate(available: dict[str, int], weight: dict[str, float], slots: int) -> dict[str, int]:
    """Slots by backend: one each in order of priority, then shares rounded down, then the largest fractions, until slots or hits run out."""
    names = sorted((b for b in available if available[b] > 0), key=lambda b: (PRIORITY.get(b, 99), b))
    out = dict.fromkeys(names, 0)
    for b in names[: max(0, slots)]:
        out[b] = 1
    while (left := slots - sum(out.values())) > 0:
        room = [b for b in names if out[b] < available[b]]
        if not room:
            break
        total = sum(weight[b] for b in room)
        share = {b: left * weight[b] / total if total > 0 else left / len(room) for b in room}
        gain = {b: min(int(share[b]), available[b] - out[b]) for b in room}
        if not any(gain.values()):
            gain[min(room, key=lambda b: (-(share[b] - int(share[b])), -weight[b], PRIORITY.get(b, 99), b))] = 1
        for b in room:
            out[b] += gain[b]
    return out


def _overlap(a, b) -> bool:
    return a.path == b.path and not (a.end_line < b.start_line or b.end_line < a.start_line)


def fuse(hits: DataFrame, weighted: DataFrame, slots: int = MAX_SNIPPETS) -> DataFrame:
    """Hits of a hybrid result: allocated per backend, voted by reciprocal rank into the first overlapping representative, tags united.

    Per query the fold sees the bounded top k of each backend.
    """
    w = weighted.select("query_id", "backend", "weight")
    rows = hits.join(w, ["query_id", "backend"]).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "backend").orderBy("idx"))).filter(F.col("r") <= slots)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n, weight = pdf.groupby("backend").size().to_dict(), pdf.groupby("backend").weight.first().to_dict()
        give = allocate(n, weight, slots)
        reps: list[dict] = []
        for b in sorted(give, key=lambda b: (PRIORITY.get(b, 99), b)):
            for h in pdf[pdf.backend == b].sort_values("r").head(give[b]).itertuples():
                rep = next((x for x in reps if _overlap(x["hit"], h)), None)
                if rep is None:
                    rep = {"hit": h, "vote": 0.0, "tags": []}
                    reps.append(rep)
                elif h.raw_score > rep["hit"].raw_score:
                    rep["hit"] = h
                rep["vote"] += 1 / (RRF + h.r)
                rep["tags"] = list(dict.fromkeys([*rep["tags"], *(h.tags if h.tags is not None else [])]))
        order = sorted(range(len(reps)), key=lambda i: (-round(reps[i]["vote"], 12), i))[:slots]
        out = [{**{c: getattr(reps[i]["hit"], c) for c in ("query_id", "backend", "path", "start_line", "end_line", "snippet", "raw_score", "match_role")}, "idx": k, "tags": reps[i]["tags"], "vote": round(reps[i]["vote"], 9)} for k, i in enumerate(order)]
        return pd.DataFrame(out, columns=["query_id", "backend", "idx", "path", "start_line", "end_line", "snippet", "raw_score", "tags", "match_role", "vote"])

    return rows.groupBy("query_id").applyInPandas(one, HITS + ", vote double")


def rerank(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Lexical hits by their best semantic neighbour in the same file (+.05 overlapping, +.02 within four lines), then score, then place."""
    s = semantic.select("query_id", "path", F.col("start_line").alias("ss"), F.col("end_line").alias("se"), F.col("raw_score").alias("sr"))
    touch = ~((F.col("end_line") < F.col("ss")) | (F.col("se") < F.col("start_line")))
    got = F.col("sr") + F.when(touch, 0.05).when(F.abs(F.col("start_line") - F.col("ss")) <= 4, 0.02).otherwise(0.0)
    best = lexical.join(s, ["query_id", "path"]).groupBy("query_id", "idx").agg(F.max(got).alias("g"))
    rows = lexical.join(best, ["query_id", "idx"], "left").withColumn("overlap", F.round(F.least(F.lit(1.0), F.coalesce("g", F.lit(0.0))), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.desc("raw_score"), "idx")
    return rows.withColumn("new_idx", F.row_number().over(w) - 1).drop("g")


def rescue(semantic: DataFrame, queries: DataFrame, threshold: float = THRESHOLDS["semantic"]) -> DataFrame:
    """The one semantic hit that may stand alone: not auxiliary, over max(threshold + .08, .74), .05 ahead of the next."""
    rows = semantic.join(queries.select("query_id", "domain"), "query_id").filter(~by_domain("domain", lambda d: P.is_auxiliary("path", d)))
    w = Window.partitionBy("query_id").orderBy("idx")
    rows = rows.withColumn("i", F.row_number().over(w)).withColumn("next", F.lead("raw_score").over(w))
    return rows.filter((F.col("i") == 1) & (F.col("raw_score") >= max(threshold + 0.08, 0.74)) & (F.col("next").isNull() | (F.round(F.col("raw_score") - F.col("next"), 9) >= 0.05))).drop("i", "next", "domain")


def rebalance(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """In mixed code queries the best implementation and its most related test take the first two places."""
    q = queries.filter("domain = 'code' AND kind = 'mixed'").select("query_id")
    rows = hits.join(q.withColumn("mixed", F.lit(True)), "query_id", "left")
    w = Window.partitionBy("query_id")
    impl = F.col("mixed") & P.is_source("path") & ~P.is_test("path") & ~F.coalesce(F.col("match_role") == "import", F.lit(False))
    key = F.when(impl, F.struct(-F.col("raw_score"), F.when(F.col("match_role") == "definition", 0).otherwise(1), F.col("idx"), F.col("path")))
    rows = rows.withColumn("best", F.min(key).over(w))
    rel = F.when(F.col("mixed") & F.col("best").isNotNull() & P.is_test("path"), P.test_relevance(F.col("best.path"), F.col("path")))
    rows = rows.withColumn("rel", rel)
    rows = rows.withColumn("test", F.max(F.when(F.col("rel") > 0, F.struct("rel", "raw_score", -F.col("idx")))).over(w))
    first = F.col("test").isNotNull() & (F.col("idx") == F.col("best.idx"))
    second = F.col("test").isNotNull() & (F.col("rel") == F.col("test.rel")) & (-F.col("idx") == F.col("test")["col3"]) & (F.col("raw_score") == F.col("test.raw_score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(first, 0).when(second, 1).otherwise(2), "idx")) - 1
    return rows.withColumn("new_idx", place).drop("mixed", "best", "rel", "test")


def pack(hits: DataFrame, preserve: bool = False, max_files: int = MAX_FILES, max_snippets: int = MAX_SNIPPETS, max_chars: int = MAX_CHARS, snippet_chars: int = SNIPPET_CHARS) -> DataFrame:
    """The final hits of every query: overlaps removed, files interleaved (or the order kept), cut at the budget of characters.

    Removing overlaps depends on order and is a fold over a query's few hits; the rest are windows.
    """
    def dedupe(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values("idx") if preserve else pdf.sort_values(["raw_score", "path", "start_line", "idx"], ascending=[False, True, True, True])
        kept: list = []
        for h in order.itertuples(index=False):
            i = next((i for i, x in enumerate(kept) if _overlap(x, h)), None)
            if i is None:
                kept.append(h)
            elif not preserve:
                a, b = h.end_line - h.start_line, kept[i].end_line - kept[i].start_line
                if a < b or a == b and h.raw_score > kept[i].raw_score:
                    kept[i] = h
        out = pd.DataFrame(kept, columns=pdf.columns)
        out["idx"] = range(len(out))
        return out

    cols = [c.split()[0] for c in HITS.split(", ")]
    rows = hits.select(*cols).groupBy("query_id").applyInPandas(dedupe, HITS)
    q = Window.partitionBy("query_id")
    order = [F.desc("raw_score"), "path", "start_line", "idx"]
    if preserve:
        rows = rows.withColumn("first", F.min("idx").over(Window.partitionBy("query_id", "path")))
        rows = rows.withColumn("file_rank", F.dense_rank().over(q.orderBy("first"))).withColumn("place", F.col("idx"))
    else:
        rows = rows.withColumn("top", F.max("raw_score").over(Window.partitionBy("query_id", "path")))
        rows = rows.withColumn("file_rank", F.dense_rank().over(q.orderBy(F.desc("top"), "path"))).withColumn("turn", F.row_number().over(Window.partitionBy("query_id", "path").orderBy(*order)))
        rows = rows.withColumn("place", F.row_number().over(q.orderBy("turn", "file_rank")))
    rows = rows.filter(F.col("file_rank") <= max_files).withColumn("i", F.row_number().over(q.orderBy("place"))).filter(F.col("i") <= max_snippets).withColumn("snippet", clip("snippet", snippet_chars))
    used = F.sum(F.length("path") + F.length("snippet")).over(q.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("used", used).filter((F.col("i") == 1) | (F.col("used") <= max_chars))
    return rows.select("query_id", F.col("i").alias("rank"), "backend", "path", "start_line", "end_line", "snippet", "raw_score", "tags", "match_role")


def suggested_prefix(packed: DataFrame) -> DataFrame:
    """query_id, prefix: the file that two of the first four hits share, else their directory."""
    top = packed.filter(F.col("rank") <= 4).withColumn("n_top", F.count("*").over(Window.partitionBy("query_id"))).filter("n_top >= 2")
    most = lambda df, c: df.groupBy("query_id", F.col(c).alias("p")).agg(F.count("*").alias("n")).groupBy("query_id").agg(F.max(F.struct("n")).alias("m"), F.min_by("p", F.struct(-F.col("n"), F.col("p"))).alias("p")).filter("m.n >= 2")
    files = most(top, "path").select("query_id", F.col("p").alias("file"))
    dirs = most(top.withColumn("dir", P.parent("path")).filter("dir NOT IN ('', '.')"), "dir").select("query_id", F.col("p").alias("dir"))
    return files.join(dirs, "query_id", "full_outer").select("query_id", F.coalesce("file", "dir").alias("prefix"))


def flags(packed: DataFrame, queries: DataFrame, only: str | None = None) -> DataFrame:
    """query_id, n_hits, auxiliary_only, many_paths, authority_scoped of every query.

    auxiliary_only: code was asked for and all hits are documentation, workflows or examples. authority_scoped: outside code, the first three hits speak with
    authority and lie in at most two files, or the file or directory that the first hits share is documentation or a workflow.
    """
    h = packed.join(queries.select("query_id", "domain"), "query_id")
    top = F.col("rank") <= 3
    g = h.groupBy("query_id").agg(
        F.count("*").alias("n"), F.bool_and((F.col("domain") == "code") & by_domain("domain", lambda d: P.is_auxiliary("path", d), only)).alias("aux"), F.count_distinct("path").alias("paths"),
        F.bool_and(F.when(top, (F.col("domain") != "code") & by_domain("domain", lambda d: P.is_authority("path", d), only))).alias("auth"), F.count_distinct(F.when(top, F.col("path"))).alias("top_paths"))
    r = queries.select("query_id").distinct().join(g, "query_id", "left").join(suggested_prefix(packed), "query_id", "left")
    speaks = F.coalesce(P.is_docs("prefix") | P.is_workflow("prefix"), F.lit(False))
    no = F.lit(False)
    return r.select("query_id", F.coalesce("n", F.lit(0)).alias("n_hits"), F.coalesce("aux", no).alias("auxiliary_only"), F.coalesce(F.col("paths") > 1, no).alias("many_paths"), F.coalesce(F.col("auth") & ((F.col("top_paths") <= 2) | speaks), no).alias("authority_scoped"))


def decide(packed: DataFrame, routes: DataFrame, quality: DataFrame, queries: DataFrame, rescued: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """query_id, strategy, n_hits, decisive, next_action, suggested_prefix, status of every query."""
    h = packed.groupBy("query_id").agg(F.count("*").alias("n_hits"), *(F.max(F.when(F.col("rank") == i, F.struct("path", "raw_score", "match_role", "tags", "snippet"))).alias(f"h{i}") for i in (1, 2)))
    met = quality.filter("threshold_met").select("query_id", F.col("backend").alias("strategy"), F.lit(True).alias("met"))
    r = queries.select("query_id", "kind", "domain", "literal_first").join(routes, "query_id").join(h, "query_id", "left").join(met, ["query_id", "strategy"], "left").join(suggested_prefix(packed), "query_id", "left")
    s1, s2 = F.col("h1.raw_score"), F.col("h2.raw_score")
    same, one, gap = F.col("h1.path") == F.col("h2.path"), F.col("n_hits") == 1, F.round(F.col("h1.raw_score") - F.col("h2.raw_score"), 9)
    code, mixed, named = F.col("domain") == "code", F.col("kind") == "mixed", F.col("kind").isin("identifier", "declaration")
    defines = (F.col("h1.match_role") == "definition") | F.array_contains("h1.tags", "symbol_def") | F.col("h1.snippet").rlike(DEFINITION)
    auth = by_domain("domain", lambda d: P.is_authority(F.col("h1.path"), d), only)
    ok = (
        F.when(code & named & ~F.coalesce(defines, F.lit(False)), False)
        .when(code & mixed & ~F.coalesce("literal_first", F.lit(False)), F.when(~P.is_source(F.col("h1.path")) | P.is_test(F.col("h1.path")), False).when(one, s1 >= 0.93).otherwise(same & (s1 >= 0.92) & (gap >= 0.08)))
        .when(~code & auth & one, s1 >= 0.82).when(~code & auth & same, s1 >= 0.84).when(one, s1 >= 0.80).when(same & (F.abs(gap) < 0.05), False)
        .when(named, (s1 >= 0.85) & ((gap >= 0.05) | ~same)).otherwise((s1 >= 0.90) & (gap >= 0.10))
    )
    decisive = F.coalesce(F.col("strategy").isin("exact", "symbol") & F.col("met") & (F.col("n_hits") > 0) & ok, F.lit(False))
    if rescued is not None:
        r = r.join(rescued.select("query_id", F.lit(True).alias("rescued")).distinct(), "query_id", "left")
        decisive = decisive | F.coalesce("rescued", F.lit(False))
    r = r.withColumn("decisive", decisive).withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    action = F.when(F.col("decisive"), "open_hit_1").when(F.col("prefix").isNotNull(), "narrow_by_path").otherwise("refine_query")
    status = F.when(F.col("strategy") == "suppressed", "suppressed").when(F.col("n_hits") == 0, "no_match").when(F.col("decisive"), "decisive").otherwise("ambiguous")
    return r.select("query_id", "strategy", "n_hits", "decisive", action.alias("next_action"), F.when(~F.col("decisive"), F.col("prefix")).alias("suggested_prefix"), status.alias("status"))


def retrieval_confidence(packed: DataFrame) -> DataFrame:
    """query_id, confidence: .7 of the best score and .3 of the mean of the best three."""
    top = packed.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw_score")))).filter("i <= 3")
    return top.groupBy("query_id").agg(F.round(clamp(0.7 * F.max("raw_score") + 0.3 * F.avg("raw_score")), 9).alias("confidence"))


def evidence(packed: DataFrame, least: float = 0.6, items: int = 1) -> DataFrame:
    """query_id, n_items, n_confident, grounded, reason: whether enough hits are confident."""
    g = packed.groupBy("query_id").agg(F.count("*").alias("n_items"), F.count_if(clamp(F.col("raw_score")) >= least).alias("n_confident"))
    ok = F.col("n_confident") >= items
    return g.select("*", ok.alias("grounded"), F.when(ok, "grounding_ok").when(F.col("n_items") == 0, "no_evidence").otherwise("confidence_below_threshold").alias("reason"))


def next_top_k(k: int, most: int = 64) -> int:
    return min(most, max(k + 1, 2 * k))
