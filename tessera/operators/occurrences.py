"""Definitions and references of names, and their search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions.hints import Hints, tails, usage_intent
from tessera.functions.text import REFERENCE_KEYWORDS, identifiers, line_spans, lines
from tessera.functions.vectors import clamp

# Scores by kind of match.
EQUAL, TAIL, PART, TOKEN_EQUAL, TOKEN_PART = 1.0, 0.96, 0.74, 0.82, 0.62
DOMAIN_GAIN, FILE_STEP, FILE_MOST = 0.08, 0.02, 0.06


def definitions(symbols: DataFrame, spans: DataFrame) -> DataFrame:
    first = spans.select("path", F.col("line").alias("start_line"), "start_byte")
    last = spans.select("path", F.col("line").alias("end_line"), "end_byte")
    rows = symbols.select(F.col("name").alias("symbol"), F.col("file_path").alias("path"), "start_line", "end_line", "language", F.col("container_fqname").alias("container"), "signature").distinct()
    rows = rows.join(first, ["path", "start_line"]).join(last, ["path", "end_line"])
    return rows.select("symbol", F.lit("def").alias("kind"), "path", "start_line", "end_line", "start_byte", "end_byte", "language", "container", "signature")


def references(files: DataFrame, symbols: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per name, path and line: no keyword, three letters or more, not defined on that line."""
    fit = lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(REFERENCE_KEYWORDS)
    tokens = lines(files).select("path", "line", F.explode(F.array_distinct(F.filter(identifiers("text"), fit))).alias("symbol"))
    own = symbols.select(F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.col("name").alias("symbol")).distinct()
    rows = tokens.join(own, ["path", "line", "symbol"], "left_anti").join(spans, ["path", "line"]).join(files.select("path", "language"), "path")
    none = F.lit(None).cast("string")
    return rows.select("symbol", F.lit("ref").alias("kind"), "path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), "start_byte", "end_byte", "language", none.alias("container"), none.alias("signature"))


def build(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The occurrence relation of files (path, language, content) and their symbols."""
    one = files.dropDuplicates(["path"])
    spans = line_spans(one)
    mine = symbols.join(one.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return definitions(mine, spans).unionByName(references(one, mine, spans))


def listing(occurrences: DataFrame, prefixes: list[str] = (), language: str | None = None) -> DataFrame:
    """Filters push down to the scan; ordered by path, span, name and kind."""
    out = occurrences if language is None else occurrences.filter(F.col("language") == language)
    if prefixes:
        out = out.filter(P.under_any("path", list(prefixes)))
    return out.orderBy("path", "start_line", "end_line", "symbol", "kind")


def match_score(name: Column, h: Hints, case_sensitive: bool = False, exact_only: bool = False) -> Column:
    fold = (lambda x: x) if case_sensitive else str.lower
    n = name if case_sensitive else F.lower(name)
    parts = [F.lit(0.0)]
    for c in h.symbols or [t for t in h.tokens if len(t) >= 3]:
        full, tail = fold(c), fold(tails([c])[0])
        near = F.lit(0.0) if exact_only else F.when(n.contains(tail) | F.lit(tail).contains(n), PART).otherwise(0.0)
        parts.append(F.when(n == full, EQUAL).when(n == tail, TAIL).otherwise(near))
    for t in {fold(t) for t in h.tokens if len(t) >= 3}:
        parts.append(F.when(n == t, TOKEN_EQUAL).when(F.lit(not exact_only) & n.contains(t), TOKEN_PART).otherwise(0.0))
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def search(occurrences: DataFrame, h: Hints, k: int = 16, where: Column | None = None, case_sensitive: bool = False, exact_only: bool = False) -> DataFrame:
    """Symbol backend: top k occurrences of the names in a query."""
    rows = occurrences if where is None else occurrences.filter(where)
    hit = rows.withColumn("base", match_score(F.col("symbol"), h, case_sensitive, exact_only)).filter("base > 0")
    gain = F.greatest(F.lit(0.0), P.domain_score("path", h.domain) - 0.5) * DOMAIN_GAIN
    many = F.count("*").over(Window.partitionBy("path"))
    hit = hit.withColumn("score", F.round(clamp(clamp(F.col("base") + gain) + F.least(F.lit(FILE_MOST), FILE_STEP * (many - 1))), 6))
    uses = usage_intent(h.query)
    order = F.when(F.col("kind") == ("ref" if uses else "def"), 0).otherwise(1)
    out = hit.orderBy(order, F.desc("score"), "path", "start_line", "end_line", "symbol").limit(k)
    if h.kind == "declaration":
        out = out.withColumn("__any", F.max((F.col("kind") == "def").cast("int")).over(Window.partitionBy(F.lit(1)))).filter("__any = 0 OR kind = 'def'")  # of k rows
    return out.select("path", "start_line", "end_line", "symbol", "kind", F.col("score").alias("raw_score"))


def token_stats(occurrences: DataFrame) -> DataFrame:
    """symbol, defs, refs, files."""
    return occurrences.groupBy("symbol").agg(F.count_if(F.col("kind") == "def").alias("defs"), F.count_if(F.col("kind") == "ref").alias("refs"), F.count_distinct("path").alias("files"))
