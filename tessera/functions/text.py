"""Lines, tokens, hashes and text blocks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import col

# Words that are no references.
REFERENCE_KEYWORDS = (
    "and as assert await break case catch class const continue def default elif else enum except export false finally fn for from function if impl import in interface "
    "let match new null package private protected pub public return self static struct super switch this throw trait true try type undefined use var while"
).split()
# Words that begin an import line, and marks of a signature in their order.
IMPORT_STARTS = ["import ", "from ", "use ", "package ", "#include ", "require("]
MODIFIERS = ["public", "private", "protected", "static", "async", "final", "pub", "export"]
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def sha(*parts: Column | str) -> Column:
    """SHA-256 hex of the parts joined by |; a null counts as empty, so no part shifts."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts)), 256)


def norm_path(c: Column | str) -> Column:
    """POSIX normpath: doubled slashes, . and .. folded."""
    p = col(c)
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(
        (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)))
        .when((x == "..") & p.startswith("/"), acc).otherwise(F.concat(acc, F.array(x))))
    out = F.concat(F.when(p.startswith("/"), "/").otherwise(""), F.array_join(folded, "/"))
    return F.when(out == "", ".").otherwise(out)


def content_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def symbol_id(repo: str, path: str, language: str, kind: str, fqname: str, start: str, end: str) -> Column:
    return sha(repo, path, language, kind, fqname, start, end)


def chunk_id(symbol: Column | str, part: Column | str, total: Column | str, start: Column | str, end: Column | str) -> Column:
    return sha(symbol, part, total, start, end)


def file_node_id(repo: Column | str, path: Column | str) -> Column:
    return F.concat(F.lit("file:"), sha(repo, norm_path(path)))


def edge_id(repo: Column | str, kind: Column | str, from_: Column | str, to: Column | str, path: Column | str, line: Column | str) -> Column:
    return sha(repo, kind, from_, to, norm_path(path), line)


def edge_text(kind: Column | str, from_: Column | str, to: Column | str, path: Column | str, line: Column | str, confidence: Column | str) -> Column:
    return F.format_string("EDGE_TYPE: %s\nFROM: %s\nTO: %s\nFILE: %s\nLINE: %d\nCONFIDENCE: %.3f", col(kind), col(from_), col(to), col(path), col(line), col(confidence))


def fingerprint(c: Column) -> Column:
    """SHA-256 of a struct as JSON; its fields must be given in a fixed order."""
    return F.sha2(F.to_json(c), 256)


def token_estimate(c: Column | str) -> Column:
    """Runs without whitespace; at least 1 unless the text is blank."""
    return F.size(F.filter(F.split(col(c), r"\s+"), lambda x: x != ""))


def split_lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


def line_count(c: Column | str) -> Column:
    return F.size(split_lines(c))


def lines(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """path, line (from 1), text: one row per LF line."""
    return files.select(F.col(path).alias("path"), F.posexplode(split_lines(text)).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")


def line_spans(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """path, line, start_byte, end_byte (exclusive, with the line feed); folded within the row, so nothing is shuffled."""
    sizes = F.transform(split_lines(text), lambda x: F.octet_length(x).cast("long") + 1)
    ends = F.aggregate(sizes, F.array().cast("array<bigint>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
    total = F.octet_length(text).cast("long")
    # array building in a fold is quadratic in the lines of a row, so long files go through the window below
    short = files.filter(F.size(split_lines(text)) <= 64).select(F.col(path).alias("path"), total.alias("total"), F.posexplode(F.arrays_zip(ends.alias("end"), sizes.alias("size"))).alias("pos", "x"))
    short = short.select("path", (F.col("pos") + 1).alias("line"), (F.col("x.end") - F.col("x.size")).alias("start_byte"), F.least("x.end", "total").alias("end_byte"))
    rest = files.filter(F.size(split_lines(text)) > 64).select(F.col(path).alias("path"), total.alias("total"), F.posexplode(sizes).alias("pos", "size"))
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rest = rest.withColumn("end", F.sum("size").over(w)).select("path", (F.col("pos") + 1).alias("line"), (F.col("end") - F.col("size")).alias("start_byte"), F.least("end", "total").alias("end_byte"))
    return short.unionByName(rest)


def span_for_lines(spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds start_byte and end_byte to wanted (path, start_line, end_line, ...); lines outside the file give null."""
    first = spans.select("path", F.col("line").alias("start_line"), "start_byte")
    last = spans.select("path", F.col("line").alias("end_line"), "end_byte")
    return wanted.join(first, ["path", "start_line"], "left").join(last, ["path", "end_line"], "left")


def extract_bytes(content: Column | str, start: Column | str, end: Column | str) -> Column:
    """Text of the byte range [start, end) of a binary column; null where the range isn't inside; broken characters are replaced."""
    c, s, e = col(content), col(start), col(end)
    ok = (s >= 0) & (e >= s) & (e <= F.octet_length(c))
    return F.when(ok, F.make_valid_utf8(F.substring(c, (s + 1).cast("int"), (e - s).cast("int")).cast("string")))


def looks_binary(content: Column | str) -> Column:
    """A NUL in the first 2048 bytes."""
    return F.substring(col(content), 1, 2048).cast("string").contains("\x00")


def identifiers(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(f"({IDENTIFIER})"), F.lit(1))


def reference_tokens(body: Column | str, own_name: Column | str, most: int = 25) -> Column:
    """Sorted distinct identifiers of three or more letters without keywords and the symbol's own name, the first 25."""
    fit = lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(REFERENCE_KEYWORDS) & ~x.eqNullSafe(col(own_name))
    return F.slice(F.array_sort(F.array_distinct(F.filter(identifiers(body), fit))), 1, most)


def clip(c: Column | str, most: int) -> Column:
    return F.when(F.length(col(c)) > most, F.concat(F.rtrim(F.left(col(c), F.lit(most))), F.lit(" ..."))).otherwise(col(c))


def one_line(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def context(lines_: Column, line: Column | str, radius: int) -> Column:
    """The lines around a line of an array of lines, joined."""
    start = F.greatest(F.lit(1), col(line) - radius)
    return F.array_join(F.slice(lines_, start.cast("int"), (col(line) + radius - start + 1).cast("int")), "\n")


def import_lines(c: Column | str) -> Column:
    stripped = F.transform(split_lines(c), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(stripped, lambda x: x.rlike("^(" + "|".join(s.replace("(", r"\(") for s in IMPORT_STARTS) + ")"))


def imports_in_scope(imports: Column, body: Column | str, most: int = 8) -> Column:
    """Block of up to 8 import lines that share a word of three or more letters with the body; '' if none does."""
    low = F.lower(col(body))
    used = F.filter(imports, lambda i: F.exists(F.split(i, "[^A-Za-z0-9_]+"), lambda t: (F.length(t) > 2) & low.contains(F.lower(t))))
    return F.when(F.size(used) > 0, F.concat(F.lit("IMPORTS_IN_SCOPE:\n"), F.array_join(F.slice(used, 1, most), "\n"))).otherwise("")


def signature_block(c: Column | str) -> Column:
    s = F.trim(F.coalesce(col(c), F.lit("")))
    params = F.when(s.contains("(") & s.contains(")"), _or(F.trim(F.substring_index(F.regexp_replace(s, r"(?s)^[^(]*\(", ""), ")", 1)), "<none>")).otherwise("<unknown>")
    returns = F.when(s.contains("->"), _or(F.trim(F.substring_index(F.regexp_replace(s, r"(?s)^.*?->", ""), ":", 1)), "<unknown>")).otherwise("<unknown>")
    found = F.filter(F.array(*map(F.lit, MODIFIERS)), lambda m: F.lower(s).contains(m))
    text = F.concat(F.lit("SIGNATURE:\nRAW: "), s, F.lit("\nPARAMS: "), params, F.lit("\nRETURNS: "), returns, F.lit("\nMODIFIERS: "), _or(F.array_join(found, ", "), "<none>"))
    return F.when(s == "", "SIGNATURE:\nRAW: <unknown>").otherwise(text)


def _or(c: Column, other: str) -> Column:
    return F.when(c != "", c).otherwise(other)


def strip_docstring(c: Column | str) -> Column:
    """Python code without the first triple-quoted string of either kind below its header line."""
    head, tail = F.substring_index(col(c), "\n", 1), F.regexp_replace(col(c), r"(?s)^[^\n]*\n?", "")
    for q in ('"""', "'''"):
        tail = F.regexp_replace(tail, rf"(?s)^((?:(?!{q}).)*){q}.*?{q}", "$1")
    return F.when(col(c).contains("\n"), F.concat(head, F.lit("\n"), tail)).otherwise(col(c))


def prepare_code(c: Column | str, language: Column | str, most: int | None = 4000) -> Column:
    body = F.when(F.lower(col(language)) == "python", strip_docstring(c)).otherwise(col(c))
    bare = F.regexp_replace(body, r"^\s+|\s+$", "")
    return bare if most is None else F.left(bare, F.lit(most))


def strip_quotes(c: Column | str) -> Column:
    return F.regexp_replace(F.trim(col(c)), "^[\"'`]+|[\"'`]+$", "")


def warning_type(c: Column | str) -> Column:
    return F.substring_index(col(c), " (", 1)


def cpp_parts(c: Column | str) -> Column:
    return F.filter(F.split(col(c), "::"), lambda x: x != "")
