"""coverage.py's SQLite file as a source: three tables, read where the file lies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.coverage import parse_context_json


def numbits(blob: bytes) -> list[int]:
    """Lines of a bitmap: bit i of byte b is line 8 b + i."""
    return [8 * b + i for b, byte in enumerate(blob) for i in range(8) if byte >> i & 1]


def sqlite_contexts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """test_id, path, line of coverage files that all executors reach; one file is read by one task, its rows in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        for b in batches:
            for p in b.column("path").to_pylist():
                con = sqlite3.connect(f"file:{p}?mode=ro", uri=True)
                tables = {r[0] for r in con.execute("SELECT name FROM sqlite_master")}
                if "line_bits" in tables:
                    rows = ((c, f, n) for c, f, bits in con.execute("SELECT c.context, f.path, l.numbits FROM line_bits l JOIN context c ON c.id = l.context_id JOIN file f ON f.id = l.file_id") for n in numbits(bits))
                else:
                    rows = iter(con.execute("SELECT c.context, f.path, l.line FROM line_data l JOIN context c ON c.id = l.context_id JOIN file f ON f.id = l.file_id"))
                part: list[tuple] = []
                for c, f, n in rows:
                    if test := (c or "").split("|")[0]:
                        part.append((test, f, n))
                    if len(part) >= 50_000:
                        yield _batch(part)
                        part = []
                if part:
                    yield _batch(part)
                con.close()

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, "test_id string, path string, line int").distinct()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    t, p, n = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(t), pa.array(p), pa.array(n, pa.int32())], ["test_id", "path", "line"])


def json_contexts(spark: SparkSession, path: str) -> DataFrame:
    return parse_context_json(spark.read.text(path, wholetext=True))


IMPORTERS = {"coverage-sqlite": lambda spark, path: sqlite_contexts(spark, [path]), "coverage-json": json_contexts}


def importer(name: str):
    """Importers are looked up by name; `IMPORTERS[name] = f` adds one."""
    if name not in IMPORTERS:
        raise KeyError(f"no coverage importer is called {name}; there are {sorted(IMPORTERS)}")
    return IMPORTERS[name]
