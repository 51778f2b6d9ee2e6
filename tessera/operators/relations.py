"""The relations: their schemas, lookups, changes, reconciliation and atomic publication.

Tables are plain files, so a change makes a new relation: rows of touched keys go out by an anti join and new rows come in by a union.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import paths as P

# The column layouts of the relations.
SCHEMAS = {
    "files": "path string, language string, content_hash string, last_indexed timestamp",
    "symbols": (
        "id string, name string, kind string, fqname string, file_path string, start_line int, end_line int, container_id string, container_fqname string, signature string, docstring string, body_hash string, "
        "embedding_vector array<float>, language string, repo_id string, commit_hash string, visibility string, exported boolean, tokens_estimate int, invariants array<string>, calls array<string>, covered_by array<string>, "
        "is_serialization_boundary boolean, implicit_contract string, signals array<struct<type:string,payload:map<string,string>,source:string,confidence:double>>, attributes map<string,string>"
    ),
    "chunks": (
        "chunk_id string, symbol_id string, chunk_part_index int, chunk_part_total int, text string, file_path string, start_line int, end_line int, start_byte bigint, end_byte bigint, "
        "tokens_estimate int, language string, repo_id string, commit_hash string, embedding_vector array<float>"
    ),
    "edges": (
        "edge_id string, edge_type string, from_id string, to_id string, from_kind string, to_kind string, file_path string, line int, confidence double, repo_id string, commit_hash string, text string, embedding_vector array<float>"
    ),
    "occurrences": "symbol string, kind string, path string, start_line int, end_line int, start_byte bigint, end_byte bigint, language string, container string, signature string",
    "occurrence_files": "path string, content_hash string, mtime_ns bigint, language string, last_indexed timestamp",
    "embedding_ledger": "embedding_profile string, record_kind string, text_hash string, vector array<float>, dimension int, created_at timestamp, updated_at timestamp",
    "audits": "symbol_id string, warnings array<string>, semantic_score double, score_metadata map<string,string>, file_path string",
    "audit_files": "path string, content_hash string",
    "checkpoints": (
        "path string, state string, content_hash string, mtime_ns bigint, size_bytes bigint, language string, symbol_count int, chunk_count int, edge_count int, "
        "symbols_added int, symbols_updated int, symbols_removed int, created_at timestamp, updated_at timestamp"
    ),
    "metadata": "key string, value string",
    "watch_state": "path string, seq bigint, deleted boolean",
}
KEYS = {"files": ["path"], "symbols": ["id"], "chunks": ["chunk_id"], "edges": ["edge_id"], "embedding_ledger": ["embedding_profile", "record_kind", "text_hash"], "audits": ["symbol_id"], "audit_files": ["path"], "occurrence_files": ["path"]}
PATH = {"files": "path", "symbols": "file_path", "chunks": "file_path", "edges": "file_path", "occurrences": "path", "occurrence_files": "path", "audits": "file_path", "audit_files": "path", "checkpoints": "path", "watch_state": "path"}
ORDER = {"symbols": ["file_path", "start_line", "id"], "chunks": ["file_path", "start_line", "chunk_part_index", "chunk_id"], "edges": ["file_path", "line", "edge_type", "edge_id"], "files": ["path"], "checkpoints": ["updated_at", "path"]}


def empty(spark: SparkSession, relation: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[relation])


def conform(df: DataFrame, relation: str) -> DataFrame:
    """The relation's columns in order and type; missing ones null, others dropped. A wrong type fails at once."""
    want = empty(df.sparkSession, relation).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))


def listing(df: DataFrame, relation: str) -> DataFrame:
    return df.orderBy(*ORDER[relation])


def filter_symbols(symbols: DataFrame, kinds: list[str] = (), file_path: str | None = None, language: str | None = None, root: str | None = None) -> DataFrame:
    """Conjunction of kind, language and path (the file or anything below it, in any stored form); pushed to the scan. One row per id."""
    out = symbols
    if kinds:
        out = out.filter(F.col("kind").isin(list(kinds)))
    if language:
        out = out.filter(F.col("language") == language)
    if file_path:
        out = out.filter(P.any_of([P.under("file_path", f) for f in P.path_forms(file_path, root)]))
    return out.dropDuplicates(["id"])


def sample_paths(symbols: DataFrame, limit: int) -> DataFrame:
    return symbols.select("file_path").distinct().orderBy("file_path").limit(limit)


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the wanted keys: a point look-up as a batch."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def edges_of(edges: DataFrame, symbol: str, direction: str = "both", edge_type: str | None = None, limit: int | None = None) -> DataFrame:
    e = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    test = {"outgoing": F.col("from_id") == symbol, "incoming": F.col("to_id") == symbol, "both": (F.col("from_id") == symbol) | (F.col("to_id") == symbol)}[direction]
    out = e.filter(test).dropDuplicates(["edge_id"]).orderBy(F.desc("confidence"), "file_path", "line", "edge_id")
    return out if limit is None else out.limit(limit)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; of new rows with one key, any one (give them distinct keys)."""
    fresh = new.dropDuplicates(key)
    return old.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def replace_files(old: DataFrame, new: DataFrame, touched: DataFrame, path_col: str) -> DataFrame:
    """All rows of the touched paths go, the new rows come."""
    gone = touched.select(F.col(touched.columns[0]).alias(path_col)).distinct()
    return old.join(gone, path_col, "left_anti").unionByName(new.select(*old.columns))


def delete(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return old.join(keys.select(*key).distinct(), key, "left_anti")


def prune(tables: dict[str, DataFrame], seen: DataFrame, prefix: str | None = None) -> dict[str, DataFrame]:
    """Removes what belongs to paths that were not seen, from every relation; with a prefix, only below it."""
    keep = seen.select(F.col(seen.columns[0]).alias("__p")).distinct()
    out = {}
    for name, df in tables.items():
        if name not in PATH:
            out[name] = df
            continue
        c = PATH[name]
        if prefix is None:
            out[name] = df.join(keep, df[c] == keep["__p"], "left_semi")
        else:
            mine = F.coalesce(P.under(c, prefix), F.lit(False))
            out[name] = df.filter(~mine).unionByName(df.filter(mine).join(keep, F.col(c) == keep["__p"], "left_semi"))
    return out


def change_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, changed, unchanged, removed) by content hash of (path, content_hash)."""
    a, b = old.select("path", F.col("content_hash").alias("was")).dropDuplicates(["path"]), new.select("path", F.col("content_hash").alias("now")).dropDuplicates(["path"])
    both = a.join(b, "path", "full_outer")
    return both.select("path", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed").alias("change"))


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path, added, updated, removed: ids that came, changed their body, or went."""
    a = old.select("id", F.col("file_path").alias("p0"), F.col("body_hash").alias("h0"), F.lit(True).alias("in0")).dropDuplicates(["id"])
    b = new.select("id", F.col("file_path").alias("p1"), F.col("body_hash").alias("h1"), F.lit(True).alias("in1")).dropDuplicates(["id"])
    r = a.join(b, "id", "full_outer").withColumn("file_path", F.coalesce("p1", "p0"))
    both = F.col("in0") & F.col("in1")
    return r.groupBy("file_path").agg(F.count_if(F.col("in0").isNull()).alias("added"), F.count_if(F.coalesce(both, F.lit(False)) & ~F.col("h0").eqNullSafe(F.col("h1"))).alias("updated"), F.count_if(F.col("in1").isNull()).alias("removed"))


def reconcile(left: DataFrame, right: DataFrame, key: str, pending: DataFrame | None = None, path_col: str = "file_path") -> DataFrame:
    """One row: both, only_left, only_right of two id sets; rows of pending paths don't count on the left."""
    a = left if pending is None else left.join(pending.select(F.col(pending.columns[0]).alias(path_col)).distinct(), path_col, "left_anti")
    a, b = a.select(F.col(key).alias("k")).filter("k IS NOT NULL").distinct(), right.select(F.col(key).alias("k")).filter("k IS NOT NULL").distinct()
    r = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "k", "full_outer")
    return r.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))


def ledger_merge(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """Per key the vector of the latest update (of equal times the larger vector) and the earliest creation."""
    key = KEYS["embedding_ledger"]
    rows = ledger.select(*key, "vector", "dimension", "created_at", "updated_at").unionByName(new.select(*key, "vector", "dimension", "created_at", "updated_at"))
    got = rows.groupBy(*key).agg(F.max(F.struct("updated_at", "vector", "dimension")).alias("r"), F.min("created_at").alias("created_at"))
    return got.select(*key, "r.vector", "r.dimension", "created_at", "r.updated_at")


def ledger_lookup(texts: DataFrame, ledger: DataFrame, profile: str, kind: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with vector or null, distinct texts to embed): each distinct missing text comes once, whatever its copies."""
    mine = ledger.filter((F.col("embedding_profile") == profile) & (F.col("record_kind") == kind))
    mine = mine.groupBy("text_hash").agg(F.max(F.struct("updated_at", "vector")).alias("r")).select("text_hash", F.col("r.vector").alias("vector"))
    rows = texts.withColumn("text_hash", F.sha2(text_col, 256)).join(mine, "text_hash", "left")
    todo = texts.filter(F.col(text_col).isNotNull()).select(F.sha2(text_col, 256).alias("text_hash"), F.col(text_col).alias("text")).dropDuplicates(["text_hash"]).join(mine, "text_hash", "left_anti")
    return rows, todo


def checkpoint_log(log: DataFrame, states: list[str] | None = None) -> DataFrame:
    """Latest row per path of an append-only log of file checkpoints; with states only the paths that are in one of them now."""
    cols = [c for c in log.columns if c not in ("path", "updated_at")]
    out = log.groupBy("path").agg(F.max(F.struct("updated_at", *cols)).alias("r")).select("path", "r.*")
    return out if states is None else out.filter(F.col("state").isin(states))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def merge_codes(*arrays: Column) -> Column:
    """Ordered union of code lists without repetitions or nulls."""
    return F.array_distinct(F.array_compact(F.flatten(F.array(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays)))))


def audits_for_file(audits: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    """Audits stored for a path, and those of symbols that lie in it, each once."""
    own = audits.filter(F.col("file_path") == path)
    held = audits.join(symbols.filter(F.col("file_path") == path).select(F.col("id").alias("symbol_id")).distinct(), "symbol_id", "left_semi")
    return own.unionByName(held).dropDuplicates(["symbol_id"])


def audit_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert in which a null path keeps the old one."""
    rest = ["warnings", "semantic_score", "score_metadata"]
    a = old.select("symbol_id", *(F.col(c).alias(f"o_{c}") for c in [*rest, "file_path"]), F.lit(True).alias("o"))
    b = new.select("symbol_id", *(F.col(c).alias(f"n_{c}") for c in [*rest, "file_path"]), F.lit(True).alias("n")).dropDuplicates(["symbol_id"])
    r = a.join(b, "symbol_id", "full_outer")
    return r.select("symbol_id", *(F.when(F.col("n"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in rest), F.coalesce("n_file_path", "o_file_path").alias("file_path"))


def reusable_audits(audits: DataFrame, audited: DataFrame, now: DataFrame) -> DataFrame:
    """Audit rows of files whose hash (path, content_hash) has not changed since."""
    same = audited.join(now.select("path", "content_hash").distinct(), ["path", "content_hash"], "left_semi")
    return audits.join(same.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")


class Store:
    """Relations under one root, in buckets of their paths; a build is written aside and becomes visible at once.

    A build has a manifest that names, for each bucket of each relation, the build that wrote it, so a build of a few files rewrites the buckets of
    these files and shares all others. It is published by a numbered pointer that is renamed into place; the newest pointer whose manifest is there
    counts, and no step removes it, so a crash between any two steps leaves the former build or the new one. The last `keep` builds stay readable
    for those who have begun to read them; `vacuum` removes what none of them names.

    buckets: choose it so that a bucket of the largest relation is about a task's worth; it stays as it is for the life of a store.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        now = self._manifest(self.current())
        self.buckets = now["buckets"] if now else buckets

    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _put(self, path: str, text: str) -> None:
        """A small file, complete or not there: written under another name and renamed."""
        tmp = self._path(f"{self.root}/tmp/{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        to = self._path(f"{self.root}/{path}")
        self._fs.mkdirs(to.getParent())
        if not self._fs.rename(tmp, to):
            raise OSError(f"{path} could not be written")

    def _get(self, path: str) -> str | None:
        p = self._path(f"{self.root}/{path}")
        if not self._fs.exists(p):
            return None
        r = self._fs.open(p)
        try:
            return bytes(r.readAllBytes()).decode()
        finally:
            r.close()

    def _manifest(self, build: str | None) -> dict | None:
        text = self._get(f"builds/{build}/manifest.json") if build else None
        return json.loads(text) if text else None

    def current(self) -> str | None:
        """The newest published build whose manifest is there."""
        for n in reversed(self._names("pointers")):
            build = n.split("-", 1)[1]
            if self._fs.exists(self._path(f"{self.root}/builds/{build}/manifest.json")):
                return build
        return None

    def _write(self, name: str, rows: DataFrame, build: str, buckets: list[int]) -> dict[str, str]:
        """Writes rows of the given buckets; returns which of them have rows."""
        part, at = PATH.get(name), f"{self.root}/builds/{build}/{name}"
        if part is None:
            rows.write.mode("overwrite").parquet(f"{at}/bucket=0")
            return {"0": build}
        keyed = rows.withColumn("bucket", self._bucket(part))
        keyed.repartition(max(1, len(buckets)), "bucket").sortWithinPartitions("bucket", part).write.mode("overwrite").partitionBy("bucket").parquet(at)  # rows of a file together: min and max prune
        return {n.split("=")[1]: build for n in self._names(f"builds/{build}/{name}") if n.startswith("bucket=")}

    def _bucket(self, part: str) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(part), F.lit(""))), F.lit(self.buckets)).cast("int")

    def stage(self, tables: dict[str, DataFrame], build: str | None = None) -> str:
        """Writes whole relations as a build; nothing is visible yet."""
        build = build or uuid.uuid4().hex[:12]
        done = {n: {"schema": df.schema.json(), "parts": self._write(n, df, build, [*range(self.buckets)])} for n, df in tables.items()}
        self._put(f"builds/{build}/manifest.json", json.dumps({"buckets": self.buckets, "relations": done}))
        return build

    def stage_changes(self, fresh: dict[str, DataFrame], touched: DataFrame, relations: list[str], build: str | None = None) -> str:
        """A build in which all rows of the touched paths (path) give way to the fresh ones; only their buckets are read and written."""
        build, was = build or uuid.uuid4().hex[:12], self._manifest(self.current()) or {"relations": {}}
        paths = touched.select("path").distinct()
        hit = [r.b for r in paths.select(self._bucket("path").alias("b")).distinct().collect()]  # at most one row per bucket
        done = dict(was["relations"])
        for n in relations:
            old = was["relations"].get(n)
            rows = self._read(n, old, hit)
            if old:
                rows = rows.join(paths.select(F.col("path").alias(PATH[n])), PATH[n], "left_anti")
            rows = rows.select(rows.columns if old or n not in fresh else fresh[n].columns)
            if n in fresh:
                rows = rows.unionByName(fresh[n].select(rows.columns)) if old else fresh[n]
            kept = {b: where for b, where in (old["parts"] if old else {}).items() if int(b) not in set(hit)}
            done[n] = {"schema": rows.schema.json(), "parts": kept | self._write(n, rows, build, hit)}
        self._put(f"builds/{build}/manifest.json", json.dumps({"buckets": self.buckets, "relations": done}))
        return build

    def publish(self, build: str) -> None:
        """Makes a build the current one; older ones go only when the pointer stands and `keep` newer ones do."""
        if self._manifest(build) is None:
            raise ValueError(f"build {build} is not complete")
        last = max((int(n.split("-")[0]) for n in self._names("pointers")), default=0)
        self._put(f"pointers/{last + 1:012d}-{build}", build)
        self.vacuum()

    def vacuum(self) -> list[str]:
        """Removes pointers beyond the last `keep`, and what is in no build that the others name; returns the builds that went."""
        pointers = self._names("pointers")
        for n in pointers[: -self.keep]:
            self._fs.delete(self._path(f"{self.root}/pointers/{n}"), False)
        named = {n.split("-", 1)[1] for n in pointers[-self.keep :]}
        published = {n.split("-", 1)[1] for n in pointers}
        used = set(named)
        for b in named:
            for rel in (self._manifest(b) or {"relations": {}})["relations"].values():
                used |= set(rel["parts"].values())
        # a build that was never published may still be written by another process: it is left alone
        gone = [b for b in self._names("builds") if b not in used and (b in published or self._get(f"builds/{b}/retired") is not None)]
        for b in self._names("builds"):
            if b in used and b not in named and self._get(f"builds/{b}/retired") is None:
                self._put(f"builds/{b}/retired", "")  # its pointer is gone, some of its buckets are still named
        for b in gone:
            self._fs.delete(self._path(f"{self.root}/builds/{b}"), True)
        return gone

    def adopt(self, source: str, build: str) -> None:
        """Takes a build that a store elsewhere on the same file system wrote in one piece."""
        self._fs.mkdirs(self._path(f"{self.root}/builds"))
        if not self._fs.rename(self._path(source), self._path(f"{self.root}/builds/{build}")):
            raise OSError(f"{source} could not be adopted")
        m = self._manifest(build)
        for rel in m["relations"].values():
            rel["parts"] = dict.fromkeys(rel["parts"], build)
        self._fs.delete(self._path(f"{self.root}/builds/{build}/manifest.json"), False)
        self._put(f"builds/{build}/manifest.json", json.dumps(m))

    def _read(self, name: str, entry: dict | None, buckets: list[int] | None = None) -> DataFrame:
        if entry is None:
            return empty(self.spark, name) if name in SCHEMAS else self.spark.createDataFrame([], "path string")
        schema = StructType.fromJson(json.loads(entry["schema"]))
        at = [f"{self.root}/builds/{b}/{name}/bucket={k}" for k, b in sorted(entry["parts"].items()) if buckets is None or int(k) in set(buckets)]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        m = self._manifest(self.current())
        return self._read(name, m["relations"].get(name) if m else None)

    @contextmanager
    def writer(self, total_ms: int = 5000, stale_ms: int = 600_000) -> Iterator[None]:
        """One writer at a time, by a lock file that only one process can create; waits grow from 25 to 250 ms. A lock older than stale_ms is broken."""
        lock = self._path(f"{self.root}/writer.lock")
        waits = iter(backoff(total_ms=total_ms))
        while True:
            try:
                self._fs.create(lock, False).close()
                break
            except Py4JJavaError:
                age = time.time() * 1000 - self._fs.getFileStatus(lock).getModificationTime() if self._fs.exists(lock) else 0
                wait = next(waits, None)
                if age > stale_ms:
                    self._fs.delete(lock, False)
                elif wait is None:
                    raise TimeoutError(f"another process writes {self.root}") from None
                else:
                    time.sleep(wait / 1000)
        try:
            yield
        finally:
            self._fs.delete(lock, False)


def backoff(first_ms: int = 25, most_ms: int = 250, total_ms: int = 5000) -> list[int]:
    """Waits between tries of a writer: doubled up to a limit, together no longer than the total."""
    out, wait = [], first_ms
    while sum(out) + wait <= total_ms:
        out.append(wait)
        wait = min(most_ms, wait * 2)
    return out


def first_per(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """First row of each key in an order; the planner keeps one candidate per task before it shuffles."""
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__i = 1").drop("__i")
