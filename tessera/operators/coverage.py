"""Line coverage to symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tessera.runtime import one_per_id

BAND = 64


def covering_tests(coverage: DataFrame, symbols: DataFrame, band: int = BAND) -> DataFrame:
    """(id, test_id): tests with an executed line between a symbol's first and last one.

    The path is an equi key; a band of lines is a second one, so neither a huge file nor a line that every test runs makes a nested loop.
    """
    s = one_per_id(symbols).select("id", F.col("file_path").alias("path"), "start_line", "end_line").filter("path IS NOT NULL AND end_line >= start_line")
    at = lambda c: F.floor(F.col(c) / band)
    s = s.withColumn("band", F.explode(F.sequence(at("start_line"), at("end_line"))))
    c = coverage.select("test_id", "path", "line").distinct().withColumn("band", at("line"))
    return c.join(s, ["path", "band"]).filter("line BETWEEN start_line AND end_line").select("id", "test_id").distinct()


def apply_coverage(symbols: DataFrame, coverage: DataFrame) -> DataFrame:
    """id, covered_by: the union of old and new tests where a test covers the symbol; none for uncovered symbols of a touched file; else as before."""
    none = F.array().cast("array<string>")
    new = covering_tests(coverage, symbols).groupBy("id").agg(F.collect_set("test_id").alias("new"))
    touched = coverage.select(F.col("path").alias("file_path")).distinct().withColumn("touched", F.lit(True))
    rows = one_per_id(symbols).select("id", "file_path", "covered_by").join(touched, "file_path", "left").join(new, "id", "left")
    old = F.coalesce("covered_by", none)
    return rows.select("id", F.array_sort(F.when(F.col("new").isNotNull(), F.array_union(old, F.col("new"))).when(F.col("touched"), none).otherwise(old)).alias("covered_by"))


def import_contexts(contexts: DataFrame, files: DataFrame, line_data: DataFrame) -> DataFrame:
    """test_id, path, line from coverage.py's three tables; lines without a context or file drop out.

    contexts: id, context; files: id, path; line_data: file_id, context_id, line. A context is `test` or `test|phase`.
    """
    c = contexts.select(F.col("id").alias("context_id"), F.substring_index("context", "|", 1).alias("test_id")).filter("test_id <> ''")
    f = files.select(F.col("id").alias("file_id"), "path")
    return line_data.join(c, "context_id").join(f, "file_id").select("test_id", "path", F.col("line").cast("int").alias("line")).distinct()


def parse_context_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """test_id, path, line from JSON documents {test: {path: [line]}}; anything else fails."""
    m = raw.select(F.from_json(column, "map<string,map<string,array<int>>>", {"mode": "FAILFAST"}).alias("m"))
    return m.select(F.explode("m").alias("test_id", "files")).select("test_id", F.explode("files").alias("path", "ls")).select("test_id", "path", F.explode("ls").alias("line")).distinct()


def context_json(coverage: DataFrame) -> DataFrame:
    """test_id, value: one JSON object {path: [line]} per test, lines in order."""
    per = coverage.groupBy("test_id", "path").agg(F.sort_array(F.collect_set("line")).alias("ls"))
    return per.groupBy("test_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "ls"))))).alias("value"))
