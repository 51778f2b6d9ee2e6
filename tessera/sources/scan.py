"""Files as a source: a recursive scan with exclusion as predicates, text decoding, hashes and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions.text import looks_binary

# Languages by suffix, and directories that are never indexed.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp"}
EXCLUDED = [".git", ".hg", ".svn", ".venv", "venv", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "dist", "build", "target", "vendor"]


def raw_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, modified, size, content of all files below the root; content is read only where a plan uses it. Spark leaves out files of 0 bytes."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    return df.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def supported(path: Column | str = "path", suffixes: list[str] | None = None) -> Column:
    s = "|".join(suffixes or LANGUAGES)
    return P.lowered(path).rlike(rf"\.({s})$") & ~P.lowered(path).endswith(".min.js")


def excluded(path: Column | str = "path", names: list[str] = EXCLUDED) -> Column:
    return F.arrays_overlap(F.split(P.normalized(path), "/"), F.array(*map(F.lit, names)))


def virtualenv_roots(paths: DataFrame, path: str = "path") -> DataFrame:
    """Directories that hold pyvenv.cfg, or both bin and site-packages of a Python: found from the listing itself."""
    p = paths.select(F.col(path).alias("p"))
    marked = p.filter(F.col("p").endswith("/pyvenv.cfg")).select(F.regexp_replace("p", "/pyvenv.cfg$", "").alias("root"))
    shape = p.select(F.regexp_extract("p", r"^(.*)/(?:lib/python[^/]*|Lib)/site-packages/", 1).alias("root"), F.lit(1).alias("a")).unionByName(p.select(F.regexp_extract("p", r"^(.*)/(?:bin|Scripts)/python[^/]*$", 1).alias("root"), F.lit(2).alias("a")))
    both = shape.filter("root <> ''").groupBy("root").agg(F.bit_or("a").alias("a")).filter("a = 3").select("root")
    return marked.unionByName(both).distinct()


def without_virtualenvs(files: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Drops files below a virtualenv of the whole listing: each path is posted under its ancestors, so the join is an equi join."""
    roots = virtualenv_roots(listing, path)
    parts = F.split(F.col(path), "/")
    above = files.select(F.col(path).alias("__f"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("root"))
    bad = above.join(roots, "root", "left_semi").select(F.col("__f").alias(path)).distinct()
    return files.join(bad, path, "left_anti")


def language_of(path: Column | str = "path") -> Column:
    ext = F.regexp_extract(P.lowered(path), r"\.([^./]+)$", 1)
    out = F.lit(None).cast("string")
    for k, v in LANGUAGES.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def source_files(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """path, language, content_hash, content, modified: indexable text files. Binary files and files that aren't UTF-8 are left out."""
    listing = raw_files(spark, root)
    rows = listing.filter(supported() & ~excluded())
    if not hidden:
        rows = rows.filter(~F.substring_index("path", "/", -1).startswith("."))
    rows = without_virtualenvs(rows, listing).filter(~looks_binary("content"))
    text = F.col("content").cast("string")
    return rows.filter(F.is_valid_utf8(text)).select("path", language_of().alias("language"), F.sha2("content", 256).alias("content_hash"), text.alias("content"), "modified")


def rejected_files(spark: SparkSession, root: str) -> DataFrame:
    """path, reason (binary, not_utf8) of supported files that can't be read as text."""
    rows = raw_files(spark, root).filter(supported() & ~excluded())
    reason = F.when(looks_binary("content"), "binary").when(~F.is_valid_utf8(F.col("content").cast("string")), "not_utf8")
    return rows.select("path", reason.alias("reason")).filter("reason IS NOT NULL")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), bytes, sha256 of every file."""
    base = root.rstrip("/")
    return raw_files(spark, root).select(F.regexp_replace("path", f"^{base}/", "").alias("path"), F.col("size").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, problem (missing, unexpected, changed) by a full outer join of two manifests."""
    a = expected.select("path", F.col("sha256").alias("want"), F.col("bytes").alias("want_bytes"))
    b = actual.select("path", F.col("sha256").alias("have"), F.col("bytes").alias("have_bytes"))
    p = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when((F.col("want") != F.col("have")) | (F.col("want_bytes") != F.col("have_bytes")), "changed")
    return a.join(b, "path", "full_outer").select("path", p.alias("problem")).filter("problem IS NOT NULL")
