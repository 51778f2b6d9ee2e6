"""What constrains a symbol: tests, neighbours and uncovered behaviour, for all symbols at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.semantic import structural_neighbors
from tessera.runtime import one_per_id


def constraining_tests(symbols: DataFrame) -> DataFrame:
    """symbol_id, test_id, strength: strong where the test's own calls name the symbol."""
    one = one_per_id(symbols)
    refs = one.select(F.col("id").alias("symbol_id"), "name", F.explode("covered_by").alias("test_id")).filter("test_id IS NOT NULL")
    tests = one.select(F.col("id").alias("test_id"), "calls")
    strong = F.coalesce(F.array_contains("calls", F.col("name")), F.lit(False))
    return refs.join(tests, "test_id", "left").select("symbol_id", "test_id", F.when(strong, "strong").otherwise("moderate").alias("strength"))


def untested(symbols: DataFrame) -> DataFrame:
    """symbol_id, warnings, risk of every symbol."""
    one = one_per_id(symbols)
    bare = F.coalesce(F.size("covered_by"), F.lit(0)) <= 0
    strict = F.coalesce(F.size("invariants"), F.lit(0)) > 0
    w = F.array_compact(F.array(
        F.when(bare, F.concat(F.lit("Symbol "), "name", F.lit(" has no dynamic test coverage."))),
        F.when(bare & strict, F.concat(F.lit("Symbol "), "name", F.lit(" has strict invariants but no tests cover it.")))))
    return one.select(F.col("id").alias("symbol_id"), w.alias("warnings"), F.when(F.size(w) > 0, "high").otherwise("low").alias("risk"))


def impact(symbols: DataFrame, radius: int = 5, most: int = 10) -> DataFrame:
    """symbol_id, impact_count, nearest: symbols within some lines, counted whole, the nearest named."""
    n = structural_neighbors(symbols, radius)
    near = n.withColumn("i", F.row_number().over(Window.partitionBy("symbol_id").orderBy("gap", "neighbor_id"))).filter(F.col("i") <= most)
    near = near.groupBy("symbol_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "neighbor_id"))), lambda x: x.neighbor_id).alias("nearest"))
    return n.groupBy("symbol_id").agg(F.count("*").alias("impact_count")).join(near, "symbol_id")


def agent_context(symbols: DataFrame, radius: int = 5) -> DataFrame:
    """One struct per symbol: tests with strength, untested behaviour, risk and impact."""
    t = constraining_tests(symbols).groupBy("symbol_id").agg(F.array_sort(F.collect_list(F.struct("test_id", "strength"))).alias("tests"))
    u = untested(symbols)
    i = impact(symbols, radius)
    none = F.array().cast("array<struct<test_id:string,strength:string>>")
    return u.join(t, "symbol_id", "left").join(i, "symbol_id", "left").select(
        "symbol_id", F.struct(F.coalesce("tests", none).alias("constraining_tests"), F.col("warnings").alias("untested_behaviors"), "risk", F.coalesce("impact_count", F.lit(0)).alias("impact_count"), F.coalesce("nearest", F.array().cast("array<string>")).alias("nearest")).alias("context"))
