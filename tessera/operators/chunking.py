"""Chunks of symbols: text blocks, line packing under a byte budget, and checks of their spans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import chunk_id, import_lines, imports_in_scope, line_spans, signature_block, span_for_lines, split_lines, token_estimate
from tessera.runtime import one_per_id

MAX_BYTES, MIN_BYTES = 12_000, 256


def pack_lines(rows: list[str], start: int, fixed: int, most: int) -> list[tuple[int, int, str]]:
    """(first line, last line, text): as many lines to a part as fit; a longer line stands alone. Sizes are carried along, so it is one pass."""
    parts: list[tuple[int, int, str]] = []
    size = [len(r.encode()) for r in rows]

    def width(i: int, j: int) -> int:  # bytes of rows i..j joined, without blanks around it
        if j - i < 3 or not rows[i].strip() or not rows[j].strip():
            return len("\n".join(rows[i : j + 1]).strip().encode())
        return total - (len(rows[i].encode()) - len(rows[i].lstrip().encode())) - (size[j] - len(rows[j].rstrip().encode()))

    i, total = 0, 0
    for j in range(len(rows)):
        total = size[j] if j == i else total + 1 + size[j]
        if j > i and width(i, j) + fixed > most:
            parts.append((start + i, start + j - 1, "\n".join(rows[i:j]).strip()))
            i, total = j, size[j]
    parts.append((start + i, start + len(rows) - 1, "\n".join(rows[i:]).strip()))
    return parts


def build(files: DataFrame, symbols: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """The chunk relation of files (path, language, content) and their symbols.

    Header, signature and imports are column expressions; only the packing, a fold that starts anew at each part, is Python, over batches.
    """
    most = max(MIN_BYTES, most)
    text = files.select(F.col("path").alias("file_path"), "content").dropDuplicates(["file_path"])
    s = one_per_id(symbols).join(text, "file_path").filter("start_line IS NOT NULL AND end_line IS NOT NULL")
    first = F.greatest(F.lit(1), F.col("start_line"))
    s = s.withColumn("rows", F.slice(split_lines("content"), first, F.greatest(F.lit(0), F.col("end_line") - first + 1))).withColumn("body", F.regexp_replace(F.array_join("rows", "\n"), r"^\s+|\s+$", ""))
    head = F.concat(F.lit("FQNAME: "), F.coalesce(F.nullif("fqname", F.lit("")), "name"), F.lit("\nKIND: "), "kind", F.lit("\nFILE: "), "file_path", F.lit("\nLINES: "), "start_line", F.lit("-"), "end_line")
    scope = F.nullif(imports_in_scope(import_lines("content"), "body"), F.lit(""))
    s = s.withColumn("prefix", F.trim(F.concat_ws("\n\n", head, signature_block("signature"), scope)))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, cols = [], {"part": [], "total": [], "first": [], "last": [], "text": []}
            for i, (prefix, rows, start, body) in enumerate(zip(*(b.column(c).to_pylist() for c in ("prefix", "rows", "start_line", "body")))):
                whole = "\n\n".join(x for x in (prefix, "BODY:", body) if x).strip()
                if not rows:
                    got = [(start, start, "")]
                elif len(whole.encode()) <= most:
                    got = [(start, start + len(rows) - 1, body)]
                else:
                    got = pack_lines(rows, start, len(prefix.encode()) + len("BODY:") + 4, most)
                for k, (x, y, t) in enumerate(got, 1):
                    take.append(i)
                    for c, v in zip(cols.values(), (k, len(got), x, y, "\n\n".join(z for z in (prefix, "BODY:", t) if z).strip())):
                        c.append(v)
            own = b.select(["id", "file_path", "language", "repo_id", "commit_hash"]).take(pa.array(take, pa.int32()))
            kinds = [pa.int32()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(v, t) for v, t in zip(cols.values(), kinds))], [*own.schema.names, *cols])

    ddl = "id string, file_path string, language string, repo_id string, commit_hash string, part int, total int, first int, last int, text string"
    out = s.select("id", "file_path", "language", "repo_id", "commit_hash", "prefix", "rows", "start_line", "body").mapInArrow(parts, ddl)
    out = out.select(
        chunk_id("id", "part", "total", "first", "last").alias("chunk_id"), F.col("id").alias("symbol_id"), F.col("part").alias("chunk_part_index"), F.col("total").alias("chunk_part_total"), "text",
        F.col("file_path").alias("path"), F.col("first").alias("start_line"), F.col("last").alias("end_line"), token_estimate("text").alias("tokens_estimate"), "language", "repo_id", "commit_hash")
    return span_for_lines(line_spans(files.dropDuplicates(["path"])), out).withColumnRenamed("path", "file_path")


def span_violations(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, symbol_id, problem: chunks that leave their symbol's lines or overlap the part before."""
    s = symbols.select(F.col("id").alias("symbol_id"), F.col("start_line").alias("s"), F.col("end_line").alias("e")).dropDuplicates(["symbol_id"])
    before = F.lag("end_line").over(Window.partitionBy("symbol_id").orderBy("start_line", "end_line", "chunk_part_index", "chunk_id"))
    rows = chunks.select("chunk_id", "symbol_id", "start_line", "end_line", "chunk_part_index").filter("symbol_id IS NOT NULL").dropDuplicates(["chunk_id", "symbol_id"]).withColumn("before", before).join(s, "symbol_id")
    problem = F.when((F.col("start_line") < F.col("s")) | (F.col("end_line") > F.col("e")), "outside").when(F.col("start_line") <= F.col("before"), "overlap")
    return rows.withColumn("problem", problem).filter("problem IS NOT NULL").select("chunk_id", "symbol_id", "problem")
