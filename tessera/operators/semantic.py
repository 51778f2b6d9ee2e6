"""Exact nearest neighbours, ranking policy and first chunk per symbol."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions.hints import identifier_tail, test_intent
from tessera.functions.vectors import clamp, l2, score
from tessera.runtime import one_per_id

# Bonus for the tail, for sources; penalty for test paths, for test names; over-fetching.
POLICY = {"balanced": (0.22, 0.06, -0.20, -0.08), "source-first": (0.22, 0.12, -0.35, -0.15)}
FETCH_PLAIN, FETCH_IDENTIFIER, FETCH_SOURCE_FIRST, FETCH_CAP, FETCH_FILTERED = 2, 8, 10, 250, 12
SEMANTIC_HIGH = 0.8


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """id, distance: the k smallest squared distances, ties by id; one scan and a take-ordered."""
    q = F.array(*(F.lit(float(x)) for x in query))
    d = vectors.select(F.col(id_col).alias("id"), l2(vector_col, q).alias("distance")).filter("distance IS NOT NULL")
    return d.orderBy("distance", "id").limit(k)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", block: int = 8192, part: int = 65536) -> DataFrame:
    """query_id, id, distance, rank: the k nearest of every query (query_id, vector), exact.

    The vectors are cut into parts and the queries into blocks, both of bounded size by their counts; each block meets each part in a task of its own, as matrix
    products, and keeps k per query, so what is shuffled is vectors x blocks, queries x parts, and queries x parts x k of results.
    """
    rows = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    asks = queries.select(F.col("query_id").cast("string").alias("id"), "vector").filter("id IS NOT NULL AND vector IS NOT NULL")
    n_parts, n_blocks = (max(1, -(-df.count() // size)) for df, size in ((rows, part), (asks, block)))
    hashed = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.withColumn("part", hashed(n_parts)).withColumn("block", every(n_blocks))
    blocks = asks.withColumn("block", hashed(n_blocks)).withColumn("part", every(n_parts))

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dims, x in a.groupby(a.vector.map(len)):
            y = b[b.vector.map(len) == dims]
            if not len(y) or not dims:
                continue
            xs, ids = np.array(x.vector.tolist(), np.float64), x.id.to_numpy()
            step = max(1, 16_000_000 // len(xs))  # distances held at once
            for s in range(0, len(y), step):
                q = np.array(y.vector.iloc[s : s + step].tolist(), np.float64)
                rough = (q * q).sum(1)[:, None] + (xs * xs).sum(1)[None] - 2 * q @ xs.T
                m = min(len(xs), k + 8)  # the product rounds, so a few more are measured again
                top = np.argpartition(rough, m - 1, axis=1)[:, :m]
                for i in range(len(q)):
                    cut = rough[i, top[i]].max()
                    cand = np.flatnonzero(rough[i] <= cut + 1e-9 * (1 + abs(cut)))
                    d = ((xs[cand] - q[i]) ** 2).sum(1)
                    for j in sorted(range(len(cand)), key=lambda j: (d[j], ids[cand[j]]))[:k]:
                        out.append((y.id.iloc[s + i], ids[cand[j]], d[j]))
        return pd.DataFrame(out, columns=["query_id", "id", "distance"])

    found = left.groupBy("part", "block").cogroup(blocks.groupBy("part", "block")).applyInPandas(near, "query_id string, id string, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class Ranking:
    tail: str | None
    policy: str = "balanced"
    penalise_tests: bool = False


def ranking(query: str, policy: str = "balanced", file_filter: str | None = None) -> Ranking:
    tail = identifier_tail(query)
    return Ranking(tail, policy, not test_intent(query, file_filter) and (policy == "source-first" or tail is not None))


def fetch_size(k: int, r: Ranking, filtered: bool = False) -> int:
    times = FETCH_SOURCE_FIRST if r.policy == "source-first" else FETCH_IDENTIFIER if r.tail else FETCH_PLAIN
    return max(k, min(FETCH_CAP, max(times * k, FETCH_FILTERED * k if filtered else 0)))


def rank_score(similarity: Column, r: Ranking, name: str = "name", path: str = "file_path") -> Column:
    tail, src, test_path, test_name = POLICY[r.policy]
    s = similarity + F.when(P.in_src(path), src).otherwise(0.0)
    if r.tail:
        s = s + F.when(F.col(name) == r.tail, tail).otherwise(0.0)
    if r.penalise_tests:
        s = s + F.when(P.is_ranking_test(path), test_path).otherwise(0.0) + F.when(P.is_test_name(name), test_name).otherwise(0.0)
    return clamp(s)


def search(hits: DataFrame, chunks: DataFrame, symbols: DataFrame, r: Ranking, k: int, where: Column | None = None) -> DataFrame:
    """Vector hits (id = chunk_id, distance) to the k best symbols: joined, ranked, first chunk per symbol."""
    c = chunks.select("chunk_id", "symbol_id", F.col("start_line").alias("chunk_start"), F.col("end_line").alias("chunk_end")).dropDuplicates(["chunk_id"])
    s = one_per_id(symbols).select("id", "name", "kind", "fqname", "file_path", "language")
    rows = hits.withColumnRenamed("id", "chunk_id").join(c, "chunk_id").join(s, F.col("symbol_id") == F.col("id"))
    if where is not None:
        rows = rows.filter(where)
    rows = rows.withColumn("similarity", F.round(score("distance"), 9))
    rows = rows.withColumn("ranking_score", F.round(rank_score(F.col("similarity"), r), 9))
    order = [F.desc("ranking_score"), F.desc("similarity"), "file_path", "chunk_start", "chunk_id"]
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("symbol_id").orderBy(*order))).filter("i = 1").drop("i")
    return first.orderBy(*order).limit(k).select("symbol_id", "chunk_id", "name", "kind", "file_path", F.col("chunk_start").alias("start_line"), F.col("chunk_end").alias("end_line"), "similarity", "ranking_score")


def structured(symbols: DataFrame, chunks: DataFrame, where: Column, k: int) -> DataFrame:
    """By name, path or expression instead of vectors: the first chunk of each fitting symbol."""
    s = one_per_id(symbols).filter(where).select("id", "name", "file_path", F.col("start_line").alias("symbol_line"))
    order = Window.partitionBy("symbol_id").orderBy("chunk_part_index", "start_line", "chunk_id")
    c = chunks.withColumn("i", F.row_number().over(order)).filter("i = 1").select("symbol_id", "chunk_id", "start_line", "end_line")
    return s.join(c, F.col("id") == F.col("symbol_id")).orderBy("file_path", "symbol_line", "id").limit(k).select("id", "name", "file_path", "chunk_id", "start_line", "end_line")


def structural_neighbors(symbols: DataFrame, radius: int) -> DataFrame:
    """(symbol_id, neighbor_id, gap): other symbols of the same file whose lines are at most `radius` apart.

    Files are cut into bands of lines, and a symbol is posted in all bands that it and its surroundings touch, so that a file with very many symbols is no single group.
    """
    band = 64 + radius
    s = one_per_id(symbols).select("id", "file_path", "start_line", "end_line").filter("file_path IS NOT NULL AND start_line IS NOT NULL AND end_line >= start_line")
    at = lambda c: F.floor(c / band)
    a = s.withColumn("band", F.explode(F.sequence(at(F.col("start_line") - radius), at(F.col("end_line") + radius))))
    b = s.select(F.col("id").alias("nid"), "file_path", F.col("start_line").alias("ns"), F.col("end_line").alias("ne")).withColumn("band", F.explode(F.sequence(at(F.col("ns")), at(F.col("ne")))))
    gap = F.greatest(F.lit(0), F.col("ns") - F.col("end_line"), F.col("start_line") - F.col("ne"))
    return a.join(b, ["file_path", "band"]).filter("id <> nid").withColumn("gap", gap).filter(F.col("gap") <= radius).select(F.col("id").alias("symbol_id"), F.col("nid").alias("neighbor_id"), "gap").distinct()
