"""What a search hands to its caller: JSON contracts of hits and decisions for many queries at once, and the state of the index that was searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clip

COMMAND = "tessera find"
SNIPPET = 160


def _hit_list(packed: DataFrame, *fields: Column) -> DataFrame:
    """query_id, hits: the bounded hits of each query in order."""
    return packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("hits"))


def shell_word(c: Column) -> Column:
    """A word as a shell takes it: in single quotes where it holds more than letters, digits and harmless signs."""
    return F.when(c.rlike(r"^[\w@%+=:,./-]+$"), c).otherwise(F.concat(F.lit("'"), F.regexp_replace(c, "'", "'\"'\"'"), F.lit("'")))


def target(hits: Column) -> Column:
    """What the next action is about: the first hit, the file or directory that the first hits share, or the first hit's file."""
    first, prefix, action = F.get(hits, F.lit(0)), F.col("suggested_prefix"), F.col("next_action")
    none, whole = F.lit(None).cast("int"), F.lit("file")
    make = lambda kind, path, rank=none, start=none, end=none: F.struct(kind.alias("kind"), rank.alias("rank"), path.alias("path"), start.alias("start_line"), end.alias("end_line"))
    known = F.exists(hits, lambda x: x.path == prefix)
    return (
        F.when((action == "open_hit_1") & (F.size(hits) > 0), make(F.lit("hit"), first.path, first["rank"].cast("int"), first.start_line, first.end_line))
        .when(prefix.isNotNull() & (prefix != ""), make(F.when(known, "file").otherwise("path_prefix"), prefix))
        .when((action == "narrow_by_path") & (F.size(hits) > 0), make(whole, first.path))
    )


def next_command(hits: Column, query: Column, about: Column) -> Column:
    """One command that narrows an ambiguous search; null if the first hit is the answer or nothing was found."""
    prefix = F.nullif("suggested_prefix", F.lit(""))
    known = F.exists(hits, lambda x: x.path == prefix)
    where = F.coalesce(prefix, F.get(hits, F.lit(0)).path)
    flag = F.when(prefix.isNotNull() & ~known, "--path-prefix").otherwise("--file")
    command = F.concat_ws(" ", F.lit(COMMAND), shell_word(query), flag, shell_word(where), F.when(about.isNotNull(), F.concat(F.lit("--about "), shell_word(about))))
    return F.when((F.col("next_action") != "open_hit_1") & where.isNotNull(), command)


def find_contract(packed: DataFrame, decisions: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, value: the slim contract of a search as JSON; a decisive one has one hit.

    decisions: rows of `decide` (reason and assist are optional); queries: query_id, kind, query and, optionally, about.
    """
    d = decisions
    for c, v in (("reason", F.lit(None).cast("string")), ("assist", F.lit("none"))):
        d = d if c in d.columns else d.withColumn(c, v)
    q = queries.select("query_id", "kind", "query", (F.col("about") if "about" in queries.columns else F.lit(None).cast("string")).alias("about"))
    hits = _hit_list(packed, F.col("path"), F.col("start_line"), F.col("end_line"), F.col("backend"), F.round("raw_score", 6).alias("score"), clip("snippet", SNIPPET).alias("snippet"))
    kind = dict(hits.dtypes)["hits"]
    r = q.join(d, "query_id").join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(kind)))
    r = r.withColumn("hits", F.when(F.col("status") == "decisive", F.slice("hits", 1, 1)).otherwise(F.col("hits")))
    decision = F.struct("status", "strategy", "reason", F.col("kind").alias("query_kind"), "next_action", "assist", F.col("suggested_prefix").alias("suggested_path_prefix"),
                        next_command(F.col("hits"), F.col("query"), F.col("about")).alias("suggested_next_command"), target(F.col("hits")).alias("target"))
    return r.select("query_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("find_v1").alias("contract_version"), "query", "about", decision.alias("decision"), "hits")).alias("value"))


def pack_contract(packed: DataFrame, decisions: DataFrame, queries: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """query_id, value: the full pack of a search as JSON (schema 2), with the state of the index in its summary."""
    span = F.struct("start_line", "end_line").alias("span")
    hits = _hit_list(packed, F.col("path"), span, F.round("raw_score", 6).alias("score"), F.col("snippet"), F.col("tags"), F.col("backend"), F.col("match_role"))
    kind = dict(hits.dtypes)["hits"]
    r = queries.select("query_id", "kind", "query").join(decisions, "query_id").join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(kind)))
    state = []
    if health is not None:
        r = r.join(F.broadcast(health.limit(1)), F.lit(True))  # one row
        state = [F.col("needs_reindex"), F.col("reindex_reason"), F.col("semantic_allowed").alias("semantic_search_allowed"), F.col("warning_codes")]
    summary = F.struct("strategy", "status", F.col("kind").alias("query_kind"), "decisive", "next_action", "suggested_prefix", F.size("hits").alias("hits"), *state)
    return r.select("query_id", F.to_json(F.struct(F.lit(2).alias("schema_version"), "query", summary.alias("summary"), "hits")).alias("value"))


HIT_V2 = "array<struct<rank:int,path:string,span:struct<start_line:int,end_line:int>,score:double,snippet:string,tags:array<string>>>"


def legacy_results(packs: DataFrame) -> DataFrame:
    """query_id, rank, file, line, line_end, context, similarity_score, ranking_score, tags: the results view of packs of schema 2."""
    h = packs.filter(F.get_json_object("value", "$.schema_version") == "2").select("query_id", F.explode(F.from_json(F.get_json_object("value", "$.hits"), HIT_V2)).alias("h"))
    return h.select("query_id", F.col("h.rank").alias("rank"), F.col("h.path").alias("file"), F.col("h.span.start_line").alias("line"), F.col("h.span.end_line").alias("line_end"), F.col("h.snippet").alias("context"), F.col("h.score").alias("similarity_score"), F.col("h.score").alias("ranking_score"), F.col("h.tags").alias("tags"))


# Keys of the metadata relation that the state of an index is read from.
KEYS = ["last_success_at", "index_profile", "build_state", "reset_reason", "tool_version", "vector_cache", "chunk_span"]


def snapshot(metadata: DataFrame, profile: str, tool_version: str | None = None, by: list[str] = ()) -> DataFrame:
    """One row (or one per `by`): needs_reindex, reindex_reason, semantic_allowed, warning_codes of an index, from its metadata (key, value).

    An index has to be built anew if it never was, was interrupted, was reset, or was embedded with another profile. Vectors are
    searched only if that isn't so and both integrity checks have passed.
    """
    m = metadata.groupBy(*by).agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in KEYS))
    profile_of = F.regexp_replace("index_profile", r"\|.*$", "")  # an edge suffix doesn't matter
    reason = (
        F.when(F.col("reset_reason").isNotNull(), F.when(F.col("reset_reason").contains("corrupt"), F.concat(F.lit("cache corruption recovered ("), "reset_reason", F.lit(")"))).otherwise(F.concat(F.lit("cache schema rebuilt ("), "reset_reason", F.lit(")"))))
        .when(F.col("last_success_at").isNull(), F.when(F.col("build_state") == "interrupted", "index interrupted").otherwise("missing index metadata"))
        .when(F.col("index_profile").isNull(), "missing cached index profile").when(profile_of != profile, "embedding profile changed")
    )
    m = m.withColumn("reindex_reason", reason).withColumn("needs_reindex", F.col("reindex_reason").isNotNull())
    passed = lambda k: F.coalesce(F.col(k) == "passed", F.lit(False))
    integrity = [F.when(F.col(k) == "failed", f"{n}_integrity_failed").when(~passed(k), f"{n}_integrity_missing") for k, n in (("vector_cache", "vector"), ("chunk_span", "chunk_span"))]
    drift = F.when(F.lit(tool_version is not None) & F.col("tool_version").isNotNull() & (F.col("tool_version") != (tool_version or "")), "tool_version_changed")
    state = F.when(F.col("build_state") == "stale", "stale_build_state").when(F.col("build_state") == "building", "build_in_progress").when(F.col("build_state") == "interrupted", "index_interrupted")
    codes = F.array_compact(F.array(F.when(F.col("needs_reindex"), "reindex_required"), drift, state, *integrity))
    return m.select(*by, "needs_reindex", "reindex_reason", (~F.col("needs_reindex") & passed("vector_cache") & passed("chunk_span")).alias("semantic_allowed"), codes.alias("warning_codes"))


def provenance_warnings(manifest: dict, required: bool = False) -> list[str]:
    """Warning codes of a manifest's provenance; a missing one fails only where it is required, one of a wrong kind always."""
    given = manifest.get("provenance")
    if given is None:
        if required:
            raise ValueError("artifact_manifest_provenance_missing")
        return ["artifact_manifest_provenance_missing"]
    if not isinstance(given, dict):
        raise ValueError("artifact_manifest_invalid")
    return []
