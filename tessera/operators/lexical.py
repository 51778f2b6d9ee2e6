"""Exact search: patterns over lines, scores, roles and top-k.

All scoring is one projection over the lines that match; only hits are shuffled (by path, for what a file's hits have in
common), and the top k come out by a take-ordered, so a common pattern costs a scan and no sort of all hits. Patterns are parameters;
up to 62 of them are kept as bits of one number per line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions.grep_compat import java_pattern
from tessera.functions.hints import Hints, identifier_candidates
from tessera.functions.text import clip
from tessera.functions.vectors import clamp

# What begins a definition or an import, base scores by kind of pattern, role order, boosts.
DEFINITION = r"^\s*(?:async\s+def|def|class|function|func|interface|struct|trait|enum)\b"
IMPORT = r"^\s*(?:from\s+\S+\s+import\b|import\b|use\b|#include\b|require(?:\(|\s))"
BASE = {"verbatim": 1.0, "literal_first": 0.98, "quoted": 1.0, "symbol": 0.9, "query": 0.7}
LITERAL_BONUS = 0.05
ROLES = ["definition", "same_file_context", "reference", "import", "auxiliary"]
FILE_STEP, FILE_MOST, LINE_STEP, LINE_MOST = 0.05, 0.16, 0.03, 0.08


@dataclass(frozen=True)
class Pattern:
    text: str
    kind: str
    regex: str


def patterns(h: Hints, case: str = "sensitive", word: bool = False, fixed: bool = False, locator: bool = True) -> tuple[list[Pattern], list[Pattern]]:
    """(primary, fallback) patterns of a query, each text once; the fallback counts only if no line has a primary one."""
    make = lambda t, kind, f: Pattern(t, kind, java_pattern(t, case, word, f))
    one = lambda ps: list({p.text: p for p in reversed(ps)}.values())[::-1]
    primary = [make(h.verbatim, "verbatim", True)] if h.verbatim else [make(h.query.strip(), "literal_first", True)] if h.literal_first else []
    if primary and locator:
        return primary, []
    rest = [make(t, "quoted", fixed) for t in h.literals] + [make(t, "symbol", fixed) for t in h.symbols]
    return primary, one(rest) or ([make(h.query.strip(), "query", fixed)] if h.query.strip() else [])


def mentions(line: Column, names: list[str]) -> Column:
    return P.any_of([line.rlike(rf"(?<![A-Za-z0-9_]){n}(?![A-Za-z0-9_])") for n in (x.replace(".", r"\.").replace("#", r"\#") for x in names)])


def adjustment(path: Column | str, line: Column | str, h: Hints) -> Column:
    """Score change by definition keyword, domain and path class."""
    p = path
    out = F.when(F.col(line).rlike(DEFINITION), 0.10).otherwise(0.0)
    w = lambda test, v: F.when(test, v).otherwise(0.0)
    if h.domain == "docs_policy":
        return out + F.when(P.is_docs_authority(p), 0.12).when(P.is_docs(p), 0.08).when(P.is_workflow(p), 0.06).when(P.is_test(p), -0.08).when(P.is_source(p), -0.05).otherwise(0.0)
    if h.domain == "workflow_config":
        return out + F.when(P.is_workflow(p), 0.12).when(P.is_docs_authority(p), 0.10).when(P.is_docs(p), 0.06).when(P.is_test(p), -0.08).when(P.is_source(p), -0.04).otherwise(0.0)
    mixed = h.kind == "mixed"
    return out + w(P.is_source(p), 0.14 if mixed else 0.08) + w(P.is_docs(p), -0.08) + w(P.is_workflow(p), -0.10) + w(P.is_test(p), -0.01 if mixed else -0.05)


def role(path: str, line: str, h: Hints) -> Column:
    names = identifier_candidates(h)
    named = mentions(F.col(line), names) if names else F.lit(True)
    aux = P.is_auxiliary(path, h.domain)
    return F.when(aux, "auxiliary").when(F.col(line).rlike(IMPORT), "import").when(F.col(line).rlike(DEFINITION) & named, "definition").otherwise("reference")


def role_priority(c: str) -> Column:
    out = F.lit(len(ROLES))
    for i, r in enumerate(ROLES):
        out = F.when(F.col(c) == r, i).otherwise(out)
    return out


def matches(lines: DataFrame, ps: list[Pattern], h: Hints) -> DataFrame:
    """path, line, text, mask (bit i: pattern i), base, raw_score of the lines that hold a pattern."""
    if not 0 < len(ps) <= 62:
        raise ValueError("between 1 and 62 patterns")
    hit = [F.col("text").rlike(p.regex) for p in ps]
    found = lines.filter(P.any_of(hit))
    mask, best = F.lit(0).cast("long"), F.lit(0.0)
    for i, (p, x) in enumerate(zip(ps, hit)):
        mask = mask + F.when(x, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        base = BASE[p.kind] + (LITERAL_BONUS if p.kind in ("quoted", "verbatim") else 0.0)
        best = F.greatest(best, F.when(x, base).otherwise(0.0))
    return found.select("path", "line", "text", mask.alias("mask"), clamp(best + adjustment("path", "text", h)).alias("raw_score"), role("path", "text", h).alias("match_role"))


def boosted(hits: DataFrame, h: Hints) -> DataFrame:
    """Adds what several patterns in a file or on a line, siblings of the best file and authority contribute."""
    w = Window.partitionBy("path")
    mixed = h.domain == "code" and h.kind == "mixed"
    named = h.domain == "code" and h.kind in ("identifier", "declaration")
    rows = hits.withColumn("in_file", F.bit_count(F.expr("bit_or(mask)").over(w))).withColumn("on_line", F.bit_count("mask"))
    rows = rows.withColumn("has_definition", F.max((F.col("match_role") == "definition").cast("int")).over(w) == 1)
    rows = rows.withColumn("match_role", F.when(F.col("has_definition") & (F.col("match_role") == "reference"), "same_file_context").otherwise(F.col("match_role")))
    s = F.col("raw_score") + F.least(F.lit(FILE_MOST), FILE_STEP * (F.col("in_file") - 1)) + F.least(F.lit(LINE_MOST), LINE_STEP * (F.col("on_line") - 1))
    if mixed:
        r, test = F.col("match_role"), P.is_test("path")
        s = s + F.when(r == "import", -0.12).when((r == "definition") & ~test, -0.02).otherwise(0.0)
        s = s + F.when(r.isin("reference", "same_file_context") & P.is_source("path") & ~test, 0.03).otherwise(0.0) + F.when(test, 0.04).otherwise(0.0)
    if not named:
        s = s + F.when(P.is_authority("path", h.domain), 0.01 if mixed else 0.03).otherwise(0.0)
        if h.domain == "code":
            dirs = rows.withColumn("dir", P.parent("path"))
            best = dirs.agg(F.max(F.struct("in_file", "raw_score", "dir")).dir.alias("dir"))  # one row
            size = dirs.groupBy("dir").agg(F.count("*").alias("n")).filter("n >= 2")
            near = best.join(size, "dir").select("dir", F.lit(True).alias("near"))
            rows = dirs.join(F.broadcast(near), "dir", "left")  # at most one row
            s = s + F.when(F.coalesce("near", F.lit(False)), 0.02 if mixed else 0.05).otherwise(0.0)
    return rows.withColumn("score", F.round(clamp(s), 6))


def ranked(hits: DataFrame, h: Hints, k: int) -> DataFrame:
    """Final order and limit; columns path, start_line, end_line, snippet, raw_score, match_role."""
    if h.domain == "code" and h.kind in ("identifier", "declaration"):
        order = [role_priority("match_role"), F.desc("score"), "path", "line"]
    else:
        order = [F.desc("score"), "path", "line"]
    out = hits.orderBy(*order).limit(k)
    if h.kind == "declaration" and h.domain == "code":  # only definitions, if there is one
        out = out.withColumn("__any", F.max((F.col("match_role") == "definition").cast("int")).over(Window.partitionBy(F.lit(1)))).filter("__any = 0 OR match_role = 'definition'")  # of k rows
    return out.select("path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), clip(F.trim("text"), 320).alias("snippet"), F.col("score").alias("raw_score"), "match_role")


def search(lines: DataFrame, h: Hints, k: int = 24, where: Column | None = None, **how) -> DataFrame:
    """Exact backend: top k lines of a query. The fallback patterns are searched only if the primary ones are nowhere."""
    rows = lines if where is None else lines.filter(where)
    primary, fallback = patterns(h, **how)
    ps = primary
    if not primary or fallback and rows.filter(P.any_of([F.col("text").rlike(p.regex) for p in primary])).isEmpty():
        ps = fallback
    return ranked(boosted(matches(rows, ps, h), h), h, k)


def scan(lines: DataFrame, ps: list[str], k: int, case: str = "sensitive", word: bool = False, fixed: bool = False) -> DataFrame:
    """First matching pattern of each line, by path and line: path, line, pattern_index, text."""
    first = F.coalesce(*(F.when(F.col("text").rlike(java_pattern(p, case, word, fixed)), i) for i, p in enumerate(ps)))
    return lines.withColumn("pattern_index", first).filter("pattern_index IS NOT NULL").orderBy("path", "line").limit(k).select("path", "line", "pattern_index", "text")


def count_by_file(lines: DataFrame, regex: str) -> DataFrame:
    """path, n: lines with a match, counted on the map side first."""
    return lines.filter(F.col("text").rlike(regex)).groupBy("path").agg(F.count("*").alias("n"))
