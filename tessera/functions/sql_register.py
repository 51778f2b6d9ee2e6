"""Registers the library's functions for Spark SQL, so that queries can be plain SQL over the relations."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.functions.vectors import hash_embedding
from tessera.sources.parse import parse_text

# Scalar functions are SQL expressions, which the optimizer inlines.
SCALARS = {
    "l2_distance": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", "CASE WHEN size(a) = size(b) THEN aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) - CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x * x) END"),
    "distance_score": ("d DOUBLE", "DOUBLE", "greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 1 - d / 2))"),
    "token_estimate": ("t STRING", "INT", r"size(filter(split(t, '\\s+'), x -> x <> ''))"),
    "path_class": ("p STRING", "STRING", "CASE WHEN array_contains(split(lower(p), '/'), 'src') THEN 'src' WHEN array_contains(split(lower(p), '/'), 'tests') THEN 'tests' WHEN array_contains(split(lower(p), '/'), 'scripts') THEN 'scripts' ELSE 'other' END"),
    "warning_type": ("w STRING", "STRING", "substring_index(w, ' (', 1)"),
}


@udtf(returnType="name string, kind string, fqname string, start_line int, end_line int, signature string, docstring string, calls array<string>")
class ParseSymbols:
    """SELECT * FROM files, LATERAL parse_symbols(path, language, content)."""

    def eval(self, path: str, language: str, text: str):
        if path is None or text is None:
            return
        for r in parse_text(path, (language or "").lower(), text, ""):
            yield tuple(r[c] for c in ("name", "kind", "fqname", "start_line", "end_line", "signature", "docstring", "calls"))


def register(spark: SparkSession) -> list[str]:
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    spark.udf.register("hash_embedding", hash_embedding)
    spark.udtf.register("parse_symbols", ParseSymbols)
    return [*SCALARS, "hash_embedding", "parse_symbols"]


PROVIDERS = {"hash-256": hash_embedding}


def provider(profile: str):
    """The vectorised embedding function of a profile; `PROVIDERS[name] = f` adds one. Profile names are compared without case and blanks."""
    key = re.sub(r"\s+", "-", profile.strip().lower())
    if key not in PROVIDERS:
        raise KeyError(f"no embedding provider is called {profile}; there are {sorted(PROVIDERS)}")
    return PROVIDERS[key]


def embed(df, text_col: str = "text", profile: str = "hash-256"):
    """Adds vector; every distinct text is embedded once and joined back, so copies cost nothing."""
    f = provider(profile)
    one = df.select(F.sha2(text_col, 256).alias("text_hash"), F.col(text_col).alias("__t")).filter("__t IS NOT NULL").dropDuplicates(["text_hash"])
    done = one.select("text_hash", f("__t").alias("vector"))
    return df.withColumn("text_hash", F.sha2(text_col, 256)).join(done, "text_hash", "left")
