"""Counts, line coverage and summaries over the relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions.text import warning_type

CLASSES = ["src", "tests", "scripts", "other"]


def embedded(c: str = "embedding_vector") -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def index_stats(files: DataFrame, symbols: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals; every relation is counted where it lies and four numbers are joined."""
    one = F.lit(1).alias("k")
    parts = [
        files.agg(F.count("*").alias("files")), symbols.agg(F.count("*").alias("symbols")),
        chunks.agg(F.count("*").alias("chunks"), F.count_if(embedded()).alias("embedded_chunks")), edges.agg(F.count("*").alias("edges"), F.count_if(embedded()).alias("embedded_edges")),
    ]
    out = parts[0].select("*", one)
    for p in parts[1:]:
        out = out.join(F.broadcast(p.select("*", one)), "k")
    return out.drop("k")


def checkpoint_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("files"), F.count_if(F.col("state") == "extract_complete").alias("extracted"), F.count_if(F.col("state") == "embedded_complete").alias("embedded"))


def merged_line_count(spans: DataFrame, path: str = "path", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """path, merged_lines, lines: lines that are in any span, and the sum of all spans' lines; touching spans merge.

    Equal spans are one row before the window, so copies don't make a hot path.
    """
    s = spans.select(F.col(path).alias("path"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).filter("path IS NOT NULL AND e >= s")
    total = s.groupBy("path", "s", "e").agg(F.count("*").alias("n"))
    w = Window.partitionBy("path").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    gain = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s") - 1, F.coalesce(F.max("e").over(w), F.col("s") - 1)))
    return total.withColumn("gain", gain).groupBy("path").agg(F.sum("gain").alias("merged_lines"), F.sum((F.col("e") - F.col("s") + 1) * F.col("n")).alias("lines"))


def embedding_line_metrics(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: all, unique and duplicate embedded lines of chunks and edges, with their ratios."""
    a = chunks.filter(embedded()).select(F.col("file_path").alias("path"), "start_line", "end_line")
    b = edges.filter(embedded()).select(F.col("file_path").alias("path"), F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    m = merged_line_count(a.unionByName(b)).agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"), F.coalesce(F.sum("merged_lines"), F.lit(0)).alias("unique_lines"))
    dup = F.col("total_lines") - F.col("unique_lines")
    ratio = lambda x, y: F.coalesce(F.round(x / F.nullif(y, F.lit(0)), 6), F.lit(0.0))
    return m.select("total_lines", "unique_lines", dup.alias("duplicate_lines"), ratio(dup, F.col("total_lines")).alias("duplicate_ratio"), ratio(F.col("total_lines"), F.col("unique_lines")).alias("inflation"))


def warning_summary(audits: DataFrame, paths: DataFrame) -> DataFrame:
    """grouping (type, path_class, file), key, n of all warnings in one pass by grouping sets; path classes without warnings count 0.

    audits: symbol_id, warnings; paths: symbol_id, file_path.
    """
    one = paths.groupBy("symbol_id").agg(F.min("file_path").alias("file_path"))
    rows = audits.select("symbol_id", F.explode("warnings").alias("w")).join(one, "symbol_id", "left")
    rows = rows.select(warning_type("w").alias("type"), F.coalesce(P.path_class("file_path"), F.lit("other")).alias("path_class"), F.coalesce("file_path", F.lit("")).alias("file"))
    sets = rows.groupingSets([["type"], ["path_class"], ["file"]], "type", "path_class", "file").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "path_class").otherwise("file")
    got = sets.select(kind.alias("grouping"), F.coalesce("type", "path_class", "file").alias("key"), "n")
    zero = audits.sparkSession.createDataFrame([("path_class", c, 0) for c in CLASSES], "grouping string, key string, n long")
    return got.unionByName(zero).groupBy("grouping", "key").agg(F.sum("n").alias("n"))


def top_files(summary: DataFrame, k: int = 10) -> DataFrame:
    return summary.filter("grouping = 'file' AND key <> ''").orderBy(F.desc("n"), "key").limit(k).select("key", "n")


def extension_counts(paths: DataFrame, path: str = "path", samples: int = 5) -> DataFrame:
    """extension, n, samples: the first few paths of each suffix by order, kept bounded before they are gathered."""
    rows = paths.select(F.col(path).alias("p"), P.extension_label(path).alias("extension")).filter("p IS NOT NULL")
    few = rows.withColumn("i", F.row_number().over(Window.partitionBy("extension").orderBy("p"))).filter(F.col("i") <= samples)
    few = few.groupBy("extension").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x.p).alias("samples"))
    return rows.groupBy("extension").agg(F.count("*").alias("n")).join(few, "extension")


def failure_counts(events: DataFrame, reason: str, sample: str, samples: int = 5) -> DataFrame:
    """reason, n, samples: counter and first few samples of each reason."""
    rows = events.select(F.col(reason).alias("reason"), F.col(sample).alias("s")).filter("reason IS NOT NULL")
    few = rows.withColumn("i", F.row_number().over(Window.partitionBy("reason").orderBy("s"))).filter(F.col("i") <= samples)
    few = few.groupBy("reason").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x.s).alias("samples"))
    return rows.groupBy("reason").agg(F.count("*").alias("n")).join(few, "reason")


def slowest(timings: DataFrame, k: int = 10, value: str = "total_ms", path: str = "path") -> DataFrame:
    return timings.orderBy(F.desc(value), F.desc(path)).limit(k)


def capability_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """case_id, missing, forbidden_found, status: expected and forbidden names against those that were extracted."""
    got = actual.groupBy("case_id").agg(F.collect_set("name").alias("got"))
    rows = expected.join(got, "case_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    rows = rows.select("case_id", F.array_sort(F.array_except("expected", "got")).alias("missing"), F.array_sort(F.array_intersect("forbidden", "got")).alias("forbidden_found"), "known_gap")
    bad = (F.size("missing") > 0) | (F.size("forbidden_found") > 0)
    return rows.select("case_id", "missing", "forbidden_found", F.when(~bad, "pass").when(F.col("known_gap"), "gap").otherwise("fail").alias("status"))


def comparison(runs: DataFrame, higher_is_better: bool) -> DataFrame:
    """Adds delta, delta_pct and verdict to (metric, current, baseline)."""
    d = F.col("current") - F.col("baseline")
    good = d > 0 if higher_is_better else d < 0
    return runs.select("*", d.alias("delta"), F.round(d / F.nullif("baseline", F.lit(0.0)) * 100, 6).alias("delta_pct"), F.when(d == 0, "unchanged").when(good, "improved").otherwise("regressed").alias("verdict"))
