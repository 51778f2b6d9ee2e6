"""Docstring audit: missing documentation and documentation that is unlike its code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import prepare_code
from tessera.functions.vectors import cosine, hash_embedding
from tessera.runtime import one_per_id

# Audited kinds, thresholds and length limits.
KINDS = ["function", "class", "interface"]
THRESHOLD, KIND_THRESHOLDS, MIN_CODE, MAX_CODE = 0.10, {"class": 0.05, "interface": 0.05}, 30, 4000


def threshold(kind: str = "kind", base: float = THRESHOLD, by_kind: dict[str, float] = KIND_THRESHOLDS) -> Column:
    out = F.lit(base)
    for k, v in by_kind.items():
        out = F.when(F.col(kind) == k, F.lit(v)).otherwise(out)
    return out


def whole_code(chunks: DataFrame) -> DataFrame:
    """id, code: all parts of a symbol by chunk_part_index; of the later ones the lines below BODY:. Parts of equal text count once."""
    one = chunks.filter("symbol_id IS NOT NULL AND text IS NOT NULL").groupBy("symbol_id", "chunk_id").agg(F.min(F.struct(F.coalesce("chunk_part_index", F.lit(0)).alias("i"), "text")).alias("r"))
    parts = one.groupBy("symbol_id").agg(F.array_sort(F.collect_list(F.struct("r.i", "chunk_id", "r.text"))).alias("parts"))
    texts = F.array_distinct(F.transform("parts", lambda p: p.text))
    body = lambda t: F.when(t.contains("\nBODY:\n"), F.regexp_replace(t, r"(?s)^.*?\nBODY:\n", "")).otherwise(t)
    return parts.select(F.col("symbol_id").alias("id"), F.array_join(F.transform(texts, lambda t, i: F.when(i == 0, t).otherwise(body(t))), "\n").alias("code"))


def scores(symbols: DataFrame, code: DataFrame, min_chars: int = 0, min_code: int = MIN_CODE, max_code: int | None = MAX_CODE) -> DataFrame:
    """id, semantic_score, skip_reason of the symbols with documentation and code (code: id, code; max_code None: the whole code)."""
    has = F.coalesce("docstring", F.lit("")) != ""
    rows = one_per_id(symbols).filter(has).select("id", "docstring", "language").join(code.select("id", "code").dropDuplicates(["id"]), "id", "left").withColumn("cleaned", prepare_code("code", "language", max_code))
    n_doc, n_code = F.length(F.trim("docstring")), F.length(F.trim("cleaned"))
    usable = F.coalesce("cleaned", F.lit("")) != ""
    reason = (
        F.when(F.lit(min_chars > 0) & (n_doc < min_chars), F.format_string("docstring_too_short (len=%d < min=%d)", n_doc, F.lit(min_chars)))
        .when(usable & F.lit(min_chars > 0) & (n_code < min_chars), F.format_string("code_body_too_short (len=%d < min=%d)", n_code, F.lit(min_chars)))
        .when(usable & F.lit(min_code > 0) & (n_code < min_code), F.format_string("code_body_too_short (len=%d < min_code=%d)", n_code, F.lit(min_code)))
    )
    rows = rows.withColumn("skip_reason", reason).filter(usable | F.col("skip_reason").isNotNull())
    fit = F.col("skip_reason").isNull()
    rows = rows.withColumn("a", hash_embedding(F.when(fit, F.col("docstring")))).withColumn("b", hash_embedding(F.when(fit, F.col("cleaned"))))
    return rows.select("id", F.when(fit, cosine("a", "b")).alias("semantic_score"), "skip_reason")


def audit(symbols: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """symbol_id, file_path, warnings, semantic_score, skip_reason of symbols with a warning, a score or a reason."""
    s = one_per_id(symbols).select("id", "kind", "docstring", "file_path")
    if scored is None:
        s = s.withColumns({"semantic_score": F.lit(None).cast("double"), "skip_reason": F.lit(None).cast("string")})
    else:
        s = s.join(scored.select("id", "semantic_score", "skip_reason"), "id", "left")
    mine = F.coalesce(F.col("kind").isin(KINDS), F.lit(False))
    bare = F.coalesce("docstring", F.lit("")) == ""
    t = threshold()
    low = F.format_string("Low semantic similarity (score=%.3f, threshold=%.3f)", F.col("semantic_score"), t)
    warn = F.when(mine & bare, F.array(F.lit("Missing docstring"))).when(mine & (t > 0) & (F.col("semantic_score") < t), F.array(low)).otherwise(F.array().cast("array<string>"))
    rows = s.withColumn("warnings", warn).filter((F.size("warnings") > 0) | F.col("semantic_score").isNotNull() | F.col("skip_reason").isNotNull())
    return rows.select(F.col("id").alias("symbol_id"), "file_path", "warnings", "semantic_score", "skip_reason")
