"""Functions and methods paired with their documentation.

Source files are lexed by a state machine that knows the strings and comments of each language; braces (in Python,
indentation) outside of these delimit the functions, and the comment that ends directly above a function, or the string
directly below a Python signature, is its documentation. The symbols table says which functions count; files and symbols meet in a
join by path and line, so neither a large file's symbols nor a repository are gathered in one task.

Kept is a pair whose documentation says something: after quotes, comment marks and lines that begin with @ or : are removed, the first
word is not todo, fixme, tbd or xxx, and at least five different words of three or more letters are not words of the name.

Defined cases: a null id or kind leaves a row out; rows of one id count once (they agree but for the commit; else the smallest row counts).
A file given twice is lexed twice and its findings merged; of two different texts in one place the smaller counts. An unclosed string or comment ends
with the file (a one-line string with its line); unclosed braces end with the file. Empty texts and tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import is_blank

# First words of documentation that says nothing.
TRIVIAL = {"todo", "fixme", "tbd", "xxx"}
LEAST_WORDS, WORD_LETTERS = 5, 3

_STR = r"\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_TEMPLATE = r"`(?:\\.|[^`\\])*(?:`|\Z)"
# a quote after which no quote follows within one sign is a Rust lifetime
_RUST_STR = r"b?r(?P<hash>#*)\".*?(?:\"(?P=hash)|\Z)|b?\"(?:\\.|[^\"\\])*(?:\"|\Z)|b?'(?:\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])'|'"
_JAVA_TEXT = r"\"\"\".*?(?:\"\"\"|\Z)"
_PY_STR = r"[rRbBuUfFtT]{0,2}(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|" + _STR + ")"


def _machine(strings: str, *comments: str) -> re.Pattern[str]:
    return re.compile(rf"(?P<comment>{'|'.join(comments)})|(?P<string>{strings})|(?P<open>[{{(\[])|(?P<close>[}})\]])|(?P<end>;)", re.S)


_MACHINES = {
    "python": _machine(_PY_STR, r"\#[^\n]*"),
    "typescript": _machine(_STR + "|" + _TEMPLATE, _LINE, _BLOCK),
    "javascript": _machine(_STR + "|" + _TEMPLATE, _LINE, _BLOCK),
    "go": _machine(_STR + "|`[^`]*(?:`|\\Z)", _LINE, _BLOCK),
    "rust": _machine(_RUST_STR, _LINE, r"/\*"),
    "java": _machine(_JAVA_TEXT + "|" + _STR, _LINE, _BLOCK),
}
_NESTED = re.compile(r"/\*|\*/")
_DEF = re.compile(r"[ \t]*(?:async[ \t]+)?def[ \t]+\w")


def tokens(text: str, language: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of comments, strings, brackets and semicolons; anything else is code between them."""
    machine, at = _MACHINES.get(language, _MACHINES["javascript"]), 0
    while m := machine.search(text, at):
        start, at = m.span()
        kind = m.lastgroup if m.lastgroup != "hash" else "string"
        if language == "rust" and m.group() == "/*":  # Rust's block comments nest
            depth = 1
            while depth:
                n = _NESTED.search(text, at)
                depth, at = (depth + (1 if n.group() == "/*" else -1), n.end()) if n else (0, len(text))
        if at == start:
            at += 1
            continue
        yield kind, start, at


class Lexed:
    """Comments that end above a line, and functions with their extent, of one file."""

    def __init__(self, text: str, language: str):
        self.text, self.python = text, language == "python"
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.tokens = list(tokens(text, language))
        self.at = [t[1] for t in self.tokens]

    def line(self, pos: int) -> int:
        return bisect_right(self.starts, pos)

    def row(self, line: int) -> str:
        end = self.starts[line] if line < len(self.starts) else len(self.text)
        return self.text[self.starts[line - 1] : end].rstrip("\r\n")

    def _whole(self, start: int, end: int) -> bool:
        """Nothing but blanks stands beside it on its lines."""
        before = self.text[self.starts[self.line(start) - 1] : start]
        stop = self.text.find("\n", end)
        return not before.strip() and not self.text[end : stop if stop >= 0 else len(self.text)].strip()

    def comments(self) -> dict[int, str]:
        """Line on which it ends: a block comment, or a whole run of comment lines."""
        out: dict[int, str] = {}
        run: list[str] = []
        last = -1
        for kind, s, e in self.tokens:
            if kind != "comment" or not self._whole(s, e):
                continue
            body, line = self.text[s:e], self.line(max(s, e - 1))
            if body.startswith("/*"):
                out[line] = body
                continue
            if self.line(s) != last + 1:
                if run:
                    out[last] = "\n".join(run)
                run = []
            run.append(body)
            last = line
        if run:
            out[last] = "\n".join(run)
        return out

    def functions(self) -> Iterator[tuple[int, int, str | None]]:
        """(first line, last line, string below the signature) of Python's functions; the first line is the first decorator's."""
        spans = [(s, e) for kind, s, e in self.tokens if kind in ("string", "comment")]
        inside = set()
        for s, e in spans:
            inside.update(range(self.line(s) + 1, self.line(max(s, e - 1)) + 1))
        opened: dict[int, int] = {}  # line within brackets: the line where the outermost one opens
        depth = 0
        for kind, s, _ in self.tokens:
            if kind == "open":
                outer, depth = (self.line(s) if not depth else outer), depth + 1
            elif kind == "close" and depth:
                depth -= 1
                if not depth:
                    opened.update(dict.fromkeys(range(outer + 1, self.line(s) + 1), outer))
        n = len(self.starts)
        for line in range(1, n + 1):
            row = self.row(line)
            if line in inside or not _DEF.match(row):
                continue
            first = line
            while first > 1 and self.row(up := opened.get(first - 1, first - 1)).lstrip().startswith("@") and up not in inside:
                first = up
            depth, end = 0, None
            i, pos = bisect_right(self.at, self.starts[line - 1] - 1), self.starts[line - 1]
            while end is None:
                nxt = self.tokens[i] if i < len(self.tokens) else ("end", len(self.text), len(self.text))
                if not depth and (colon := self.text.find(":", pos, nxt[1])) >= 0:
                    end = colon
                    break
                if nxt[1] >= len(self.text):
                    break
                depth += (nxt[0] == "open") - (nxt[0] == "close")
                pos, i = nxt[2], i + 1
            if end is None:
                continue
            doc, last = None, self.line(end)
            k = bisect_right(self.at, end)
            if k < len(self.tokens) and self.tokens[k][0] == "string" and self.line(self.tokens[k][1]) == last + 1 and not self.text[end + 1 : self.tokens[k][1]].strip():
                doc = self.text[self.tokens[k][1] : self.tokens[k][2]]
            indent = len(row) - len(row.lstrip())
            for below in range(last + 1, n + 1):
                r = self.row(below)
                if r.strip() and below not in inside and len(r) - len(r.lstrip()) <= indent and not r.lstrip().startswith((")", "]", "}")):
                    break
                if r.strip():
                    last = below
            yield first, last, doc

    def ends(self) -> list[int]:
        """For each token: the last line of the declaration that goes on there; its braces' end, or its semicolon before any brace."""
        match: dict[int, int] = {}
        stack: list[int] = []
        for i, (kind, _, _) in enumerate(self.tokens):
            if kind == "open":
                stack.append(i)
            elif kind == "close" and stack:
                match[stack.pop()] = i
        n = len(self.tokens)
        out = [len(self.starts)] * (n + 1)
        for i in range(n - 1, -1, -1):
            kind, s, _ = self.tokens[i]
            if kind in ("close", "end"):
                out[i] = self.line(s)
            elif kind == "open":
                j = match.get(i, n)
                out[i] = len(self.starts) if j == n else self.line(self.tokens[j][1]) if self.text[s] == "{" else out[j + 1]
            else:
                out[i] = out[i + 1]
        return out

    def block_end(self, line: int, ends: list[int]) -> int:
        return ends[bisect_right(self.at, self.starts[line - 1] - 1)]


def lex_files(source_texts: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """path, line, comment, literal, code: what stands above and below each line that can begin a function.

    comment ends on the line above; literal and code belong to a Python function that begins on the line; for the other languages code is the
    block that begins there. starts (path, starts): further lines of a file for which code is asked, with a comment above or not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("line", pa.int32()), ("comment", pa.string()), ("literal", pa.string()), ("code", pa.string())])
        for b in batches:
            out: list[dict] = []
            size = 0
            for path, language, text, asked in zip(*(b.column(c).to_pylist() for c in ("path", "language", "content", "starts"))):
                f = Lexed(text, (language or "").strip().lower())
                rows: dict[int, dict] = {n + 1: {"comment": c} for n, c in f.comments().items()}
                if f.python:
                    for first, last, doc in f.functions():
                        rows.setdefault(first, {}).update(literal=doc, code="\n".join(map(f.row, range(first, last + 1))))
                else:
                    ends = f.ends()
                    for n in asked or []:
                        if 1 <= n <= len(f.starts):
                            rows.setdefault(n, {})
                    for n in rows:
                        if n <= len(f.starts) and f.row(n).strip():
                            rows[n]["code"] = "\n".join(map(f.row, range(n, f.block_end(n, ends) + 1)))
                for n, r in rows.items():
                    out.append({"path": path, "line": n, "comment": r.get("comment"), "literal": r.get("literal"), "code": r.get("code")})
                    size += sum(len(x) for x in r.values() if x)
                    if size > 1 << 25:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = source_texts.select("path", "language", "content").filter("path IS NOT NULL AND content IS NOT NULL")
    rows = rows.withColumn("starts", F.lit(None).cast("array<int>")) if starts is None else rows.join(starts.select("path", "starts"), "path", "left")
    return rows.mapInArrow(run, "path string, line int, comment string, literal string, code string")


_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "function", "new", "else", "throw", "do", "try", "with", "await", "typeof", "super", "synchronized", "assert"}
_MODIFIERS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp|readonly|override|async|get|set)[ \t]+)*"
# Declarations at the beginning of a line of code; where a call would look the same, a block has to follow the closing bracket.
_GO, _RUST = r"^[ \t]*func\s+(?:\([^)]*\)\s*)?(\w+)", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern)\s+)*fn\s+(\w+)"
_FUNCTION = r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)"
_ARROW = r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=\n]+)?=>\s*\{"
_METHOD = rf"^[ \t]*{_MODIFIERS}\*?[ \t]*([A-Za-z_$#][\w$]*)\s*(?:<[^>\n]*>)?\("
_JAVA = rf"^[ \t]*{_MODIFIERS}(?:<[^>\n]+>\s+)?[A-Za-z_$][\w$.<>\[\],?& ]*?[\s\]>]([A-Za-z_$][\w$]*)\s*\("
_BLOCK_FOLLOWS = re.compile(r"\s*(?::[^{};=]*|throws[^{};]*)?\{")
_DECLARED = {
    "go": [(_GO, False)], "rust": [(_RUST, False)], "java": [(_JAVA, True), (_METHOD, True)],
    "javascript": [(_FUNCTION, False), (_ARROW, False), (_METHOD, True)], "typescript": [(_FUNCTION, False), (_ARROW, False), (_METHOD, True)],
}


def declarations(f: Lexed, language: str) -> Iterator[tuple[str, int, int, str | None]]:
    """(name, first line, last line, documentation) of the functions of a file in a language with braces; annotations above belong to a function."""
    plain, at = [], 0
    for kind, s, e in f.tokens:
        if kind in ("comment", "string"):
            plain += [f.text[at:s], re.sub(r"[^\n]", " ", f.text[s:e])]
            at = e
    code = "".join([*plain, f.text[at:]])
    above, ends, seen = f.comments(), f.ends(), set()
    close: dict[int, int] = {}
    stack: list[int] = []
    for kind, s, _ in f.tokens:
        if kind == "open":
            stack.append(s)
        elif kind == "close" and stack:
            close[stack.pop()] = s
    for pattern, block in _DECLARED.get(language, _DECLARED["javascript"]):
        for m in re.finditer(pattern, code, re.M):
            if m[1] in _NOT_NAMES or m.start(1) in seen or block and not ((e := close.get(m.end() - 1)) and _BLOCK_FOLLOWS.match(code, e + 1)):
                continue
            if block and m[0].split()[0] in _NOT_NAMES:
                continue
            seen.add(m.start(1))
            line = first = f.line(m.start() + len(m[0]) - len(m[0].lstrip()))
            while first > 1 and f.row(first - 1).lstrip().startswith(("@", "#[")):
                first -= 1
            yield m[1], first, f.block_end(line, ends), above.get(first - 1)


def source_functions(source_texts: DataFrame) -> DataFrame:
    """path, name, start_line, end_line, code, doc (null without documentation) of every function in source files, from the files alone.

    Braces (in Python, indentation) decide where a function ends; its documentation is the comment that ends directly above it or, in Python, the
    string below its signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("code", pa.string()), ("doc", pa.string())])
        for b in batches:
            out: list[dict] = []
            size = 0
            for path, language, text in zip(*(b.column(c).to_pylist() for c in ("path", "language", "content"))):
                f = Lexed(text, language := (language or "").strip().lower())
                if f.python:
                    above = f.comments()
                    rows = []
                    for first, last, doc in f.functions():
                        head = next(r for r in map(f.row, range(first, last + 1)) if _DEF.match(r))
                        rows.append((re.match(r"\s*(?:async\s+)?def\s+(\w+)", head)[1], first, last, doc or above.get(first - 1)))
                else:
                    rows = [*declarations(f, language)]
                for name, first, last, doc in rows:
                    out.append({"path": path, "name": name, "start_line": first, "end_line": last, "code": "\n".join(map(f.row, range(first, last + 1))), "doc": doc})
                    size += len(out[-1]["code"])
                    if size > 1 << 25:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = source_texts.select("path", "language", "content").filter("path IS NOT NULL AND content IS NOT NULL").distinct()
    return rows.mapInArrow(run, "path string, name string, start_line int, end_line int, code string, doc string")


def source_pairs(source_texts: DataFrame) -> DataFrame:
    """path, name, start_line, end_line, code, description: one row per documented function of the source files; code is always there."""
    return _telling(source_functions(source_texts).filter(~is_blank("doc")))


_OPEN = re.compile(r"^(?:[rRbBuUfFtT]{0,2}(?:\"\"\"|'''|\"|')|/\*+!?|//+!?|#+!?|\*+(?!/))")
_CLOSE = re.compile(r"(?:\*+/|\"\"\"|'''|\"|')$")
_LETTERS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


def description(doc: str) -> str:
    """The documentation without quotes, comment marks and lines that begin with @ or :."""
    lines = []
    text = doc.strip()
    for i, raw in enumerate(text.split("\n")):
        line = raw.strip()
        comment = re.match(r"[/#*]", line)
        if i == 0 or comment:
            line = _OPEN.sub("", line, count=1).strip()
        line = _CLOSE.sub("", line).strip() if i == text.count("\n") or comment else line
        if line and not line.startswith(("@", ":")):
            lines.append(line)
    return "\n".join(lines)


def name_words(name: str) -> set[str]:
    return {p.lower() for p in _PARTS.findall(name or "")}


def says_something(text: str, name: str) -> bool:
    words = [w.lower() for w in _LETTERS.findall(text)]
    return bool(words) and words[0] not in TRIVIAL and len({w for w in words if len(w) >= WORD_LETTERS} - name_words(name)) >= LEAST_WORDS


def pairs(symbols: DataFrame, source_texts: DataFrame) -> DataFrame:
    """id, name, kind, language, signature, code (null where no source is given), description: one row per documented function."""
    cols = ["name", "kind", "language", "signature", "docstring", "file_path", "start_line"]
    mine = symbols.select("id", *cols).filter("id IS NOT NULL AND kind IS NOT NULL").withColumn("kind", F.lower(F.regexp_replace("kind", r"(?U)^\s+|\s+$", "")))
    mine = mine.filter(F.col("kind").isin("function", "method")).groupBy("id").agg(F.min(F.struct(*cols)).alias("r")).select("id", "r.*")
    starts = mine.groupBy(F.col("file_path").alias("path")).agg(F.collect_set("start_line").alias("starts"))
    found = lex_files(source_texts, starts).groupBy("path", "line").agg(*(F.min(c).alias(c) for c in ("comment", "literal", "code")))
    both = mine.join(found, (F.col("file_path") == F.col("path")) & (F.col("start_line") == F.col("line")), "left")
    doc = F.coalesce(*(F.when(~is_blank(c), F.col(c)) for c in ("docstring", "literal", "comment")))
    return _telling(both.withColumn("doc", doc).filter("doc IS NOT NULL").select("id", "name", "kind", "language", "signature", "code", "doc"))


def _telling(rows: DataFrame) -> DataFrame:
    """Rows whose documentation (doc, the last column) says something beyond the name; description takes its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [description(d) for d in b.column("doc").to_pylist()]
            ok = pa.array([says_something(t, n) for t, n in zip(texts, b.column("name").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "description"]).filter(ok)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in rows.columns[:-1]) + ", description string")
