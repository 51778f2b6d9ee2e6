"""Sinks: JSON lines, an append log of searches, partitioned tables, and a byte-stable archive of a small result."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import shutil
import tarfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def stream_json(df: DataFrame) -> Iterator[str]:
    """JSON lines to the caller, one partition at a time."""
    for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("v")).toLocalIterator():
        yield r.v


def log_searches(decisions: DataFrame, queries: DataFrame, path: str) -> None:
    """Appends decisions with a hash in place of the query's text."""
    rows = decisions.join(queries.select("query_id", F.sha2("query", 256).alias("query_sha256")), "query_id").withColumn("logged_at", F.current_timestamp())
    rows.write.mode("append").json(path)


def write_by_file(df: DataFrame, path: str, file_col: str, buckets: int = 64) -> None:
    """Parquet in hash buckets of the file, sorted in each: replacing a file rewrites its bucket alone (dynamic overwrite)."""
    rows = df.withColumn("file_bucket", F.pmod(F.xxhash64(file_col), F.lit(buckets)).cast("int"))
    rows.repartition("file_bucket").sortWithinPartitions(file_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_bucket").parquet(path)


def _digest(read) -> tuple[int, str]:
    n, h = 0, hashlib.sha256()
    while part := read(1 << 20):
        n, _ = n + len(part), h.update(part)
    return n, h.hexdigest()


def archive(files: dict[str, bytes | Path], path: str, provenance: dict | None = None) -> str:
    """tar.gz with a manifest, the same bytes for the same content; returns its SHA-256. Files given by path are streamed, never held."""
    source = lambda f: io.BytesIO(f) if isinstance(f, bytes) else open(f, "rb")
    entries = []
    for n, f in sorted(files.items()):
        with source(f) as r:
            size, digest = _digest(r.read)
        entries.append({"path": n, "bytes": size, "sha256": digest})
    manifest = json.dumps({"files": entries, "provenance": provenance or {}}, sort_keys=True).encode()
    sizes = {e["path"]: e["bytes"] for e in entries} | {"manifest.json": len(manifest)}
    every = {"manifest.json": manifest} | files
    with open(path, "wb") as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0, filename="") as g, tarfile.open(fileobj=g, mode="w", format=tarfile.PAX_FORMAT) as t:
        for n in sorted(every):
            info = tarfile.TarInfo(n)
            info.size, info.mtime, info.mode = sizes[n], 0, 0o644
            with source(every[n]) as r:
                t.addfile(info, r)
    with open(path, "rb") as r:
        return _digest(r.read)[1]


def check_archive(path: str) -> list[tuple[str, str]]:
    """(path, problem) of members that differ from the manifest; names that leave the archive are a problem too. Members are streamed."""
    got, manifest = {}, None
    with tarfile.open(path, "r:gz") as t:
        for m in t:
            if m.isfile():
                if m.name == "manifest.json":
                    manifest = json.loads(t.extractfile(m).read())
                else:
                    got[m.name] = _digest(t.extractfile(m).read)[1]
    if manifest is None:
        return [("manifest.json", "missing")]
    want = {e["path"]: e for e in manifest["files"]}
    bad = [(n, "unsafe") for n in got if n.startswith("/") or ".." in n.split("/")]
    bad += [(n, "missing") for n in want if n not in got] + [(n, "unexpected") for n in got if n not in want]
    return sorted(bad + [(n, "changed") for n, e in want.items() if n in got and got[n] != e["sha256"]])


def restore_archive(path: str, target: str, overwrite: bool = False) -> list[str]:
    bad = check_archive(path)
    if bad:
        raise ValueError(f"the archive is damaged: {bad[:3]}")
    done = []
    with tarfile.open(path, "r:gz") as t:
        for m in t.getmembers():
            p = Path(target, m.name)
            if p.exists() and not overwrite:
                raise FileExistsError(p)
            p.parent.mkdir(parents=True, exist_ok=True)
            with open(p, "wb") as out:
                shutil.copyfileobj(t.extractfile(m), out)
            done.append(m.name)
    return sorted(done)
