"""Source text to symbols: Python by its own syntax tree, other languages by a brace scanner over lexed text.

What the scanner covers: functions, methods, classes, interfaces, traits, structs and enums of JavaScript, TypeScript, Go, Rust, Java, C
and C++ whose declaration begins on its own line; in JavaScript functions that are assigned to names, members of bound objects and property descriptors; in C++ what
macros with plain arguments declare. Computed names are not seen.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import synthetic

# Parts of names that mark a boundary of serialisation.
SERIALIZATION = ["serialize", "deserialize", "to_dict", "from_dict", "to_json", "from_json", "parse"]
DDL = (
    "id string, name string, kind string, fqname string, file_path string, start_line int, end_line int, container_id string, container_fqname string, signature string, docstring string, body_hash string, language string, repo_id string, "
    "visibility string, exported boolean, tokens_estimate int, invariants array<string>, calls array<string>, is_serialization_boundary boolean, implicit_contract string, "
    "signals array<struct<type:string,payload:map<string,string>,source:string,confidence:double>>"
)
_CALL = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)\s*\(")
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "match", "function", "func", "fn", "sizeof", "synchronized", "new", "await", "super"}
_MODS = r"(?:(?:pub(?:\([^)]*\))?|export|default|public|private|protected|static|final|abstract|async|unsafe|const|override|virtual|inline|extern|get|set)\s+)*"
_RULES = {
    "javascript": [(rf"{_MODS}class\s+(\w+)", "class"), (rf"{_MODS}interface\s+(\w+)", "interface"), (rf"{_MODS}enum\s+(\w+)", "enum"), (rf"{_MODS}type\s+(\w+)\s*=", "type"), (rf"{_MODS}function\s*\*?\s*(\w+)", "function"),
                   (r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)", "function"), (r"(?:[\w.]+\.)(\w+)\s*=\s*(?:async\s+)?function\b", "function"), (rf"{_MODS}([A-Za-z_$][\w$]*)\s*\([^;]*\)\s*(?::[^{{;]+)?\{{", "method")],
    "go": [(r"func\s+\([^)]*\)\s*(\w+)", "method"), (r"func\s+(\w+)", "function"), (r"type\s+(\w+)\s+interface", "interface"), (r"type\s+(\w+)\s+struct", "type"), (r"type\s+(\w+)\b", "type")],
    "rust": [(rf"{_MODS}fn\s+(\w+)", "function"), (rf"{_MODS}trait\s+(\w+)", "trait"), (rf"{_MODS}enum\s+(\w+)", "enum"), (rf"{_MODS}(?:struct|type)\s+(\w+)", "type"), (r"impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)", "class")],
    "java": [(rf"{_MODS}class\s+(\w+)", "class"), (rf"{_MODS}(?:@)?interface\s+(\w+)", "interface"), (rf"{_MODS}enum\s+(\w+)", "enum"), (rf"{_MODS}(?:<[^>]+>\s*)?[\w<>\[\],.?]+\s+(\w+)\s*\([^;]*\)\s*(?:throws\s+[\w, .]+)?\{{", "method")],
    "c": [(r"(?:class)\s+(\w+)[^;]*$", "class"), (r"(?:typedef\s+)?struct\s+(\w+)[^;]*$", "type"), (r"enum\s+(?:class\s+)?(\w+)", "enum"), (r"namespace\s+(\w+)", "type"), (rf"{_MODS}[\w:<>*&\s]+?[\s*&]((?:\w+::)*~?\w+)\s*\([^;]*\)\s*(?:const)?\s*\{{?$", "function")],
}
for _a, _b in (("typescript", "javascript"), ("tsx", "javascript"), ("cpp", "c")):
    _RULES[_a] = _RULES[_b]
_RULES = {k: [(re.compile(r"\s*" + r), kind) for r, kind in v] for k, v in _RULES.items()}
_CONTAINERS = {"class", "interface", "trait", "type", "enum"}


def _sha(*parts: object) -> str:
    return hashlib.sha256("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()


def _row(path: str, repo: str, language: str, kind: str, name: str, above: list[dict], start: int, end: int, lines: list[str], signature: str, doc: str | None, calls: list[str], invariants: list[str], decorators: list[str] = ()) -> dict:
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    box = above[-1] if above else None
    fq = f"{box['fqname'] if box else stem}.{name}"
    if any("fixture" in d for d in decorators):
        kind = "fixture"
    low = signature.lower()
    if language == "python":
        vis, exp = ("private", False) if name.startswith("_") else ("public", True)
    elif language == "go":
        vis, exp = ("public", True) if name[:1].isupper() else ("private", False)
    elif language == "rust":
        vis, exp = ("public", True) if re.search(r"\bpub\b", signature) else ("private", False)
    elif language in ("javascript", "typescript", "tsx", "java"):
        vis = "private" if re.search(r"\bprivate\b", low) else "protected" if re.search(r"\bprotected\b", low) else "public"
        exp = vis == "public"
    else:
        vis, exp = None, None
    body = "\n".join(lines[start - 1 : end])
    contract = name[5:].replace("_", " ").strip() if language == "python" and kind == "function" and name.startswith("test_") else None
    json_call = next((c for c in calls if "json.dump" in c or "json.load" in c), None)
    boundary = any(k in name.lower() for k in SERIALIZATION) or json_call is not None
    sig = lambda t, **p: {"type": t, "payload": list(p.items()), "source": "parser", "confidence": 1.0}
    signals = [sig("code.call", target=c) for c in calls] + [sig("code.invariant", expression=i) for i in invariants]
    signals += [sig("test.implicit_contract", text=contract)] if contract is not None else []
    signals += [sig("boundary.serialization", detector="json_call" if json_call else "name_keyword")] if boundary else []
    return {
        "id": _sha(repo, path, language, kind, fq, start, end), "name": name, "kind": kind, "fqname": fq, "file_path": path, "start_line": start, "end_line": end,
        "container_id": box["id"] if box else None, "container_fqname": box["fqname"] if box else None, "signature": signature, "docstring": doc, "body_hash": _sha(body), "language": language, "repo_id": repo,
        "visibility": vis, "exported": exp, "tokens_estimate": len(body.split()), "invariants": invariants, "calls": calls, "is_serialization_boundary": boundary, "implicit_contract": contract, "signals": signals,
    }


def parse_python(path: str, text: str, repo: str) -> list[dict]:
    """Functions and classes with decorators, docstring, calls in order and assertions; a file with an error is scanned by its indentation."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return scan_python(path, text, repo)
    lines, out = text.split("\n"), []

    def visit(node: ast.AST, above: list[dict]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                inner = [n for n in ast.walk(child)]
                calls = list(dict.fromkeys(ast.unparse(n.func) for n in inner if isinstance(n, ast.Call)))
                claims = [ast.unparse(n.test) + (f", {ast.unparse(n.msg)}" if n.msg else "") for n in inner if isinstance(n, ast.Assert)]
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                row = _row(path, repo, "python", kind, child.name, above, first, child.end_lineno, lines, lines[child.lineno - 1].strip().rstrip(":"), ast.get_docstring(child, clean=False), calls, claims, [ast.unparse(d) for d in child.decorator_list])
                out.append(row)
                visit(child, [*above, row])
            else:
                visit(child, above)

    visit(tree, [])
    return out


_PY_SKIP = re.compile(r"[rRbBuUfF]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|\'\'\'.*?(?:\'\'\'|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|#[^\n]*", re.S)
_PY_HEAD = re.compile(r"([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)")
_PY_CALL = re.compile(r"(?<!def )(?<!class )(?<![\w.])([A-Za-z_][\w.]*)[ \t]*\(")
_PY_DOC = re.compile(r"\s*[rRuU]?(\"\"\"|\'\'\'|\"|')(.*?)\1", re.S)
_PY_WORDS = {"def", "class", "if", "elif", "while", "for", "in", "and", "or", "not", "return", "yield", "lambda", "assert", "with", "await", "except", "import", "is", "raise", "del"}


def scan_python(path: str, text: str, repo: str) -> list[dict]:
    """What can be told of a file that is no valid Python: headers by line, their extent by indentation, with strings and comments blanked first."""
    lines = text.split("\n")
    plain = _PY_SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text).split("\n")
    starts = [0]
    for r in lines:
        starts.append(starts[-1] + len(r) + 1)
    width = lambda r: len(r) - len(r.lstrip())
    out: list[dict] = []
    open_: list[tuple[int, dict]] = []
    for i, r in enumerate(plain):
        m = _PY_HEAD.match(r)
        if not m:
            continue
        depth, head = 0, i
        while True:  # to the line on which the header's brackets close
            depth += sum(plain[head].count(c) for c in "([{") - sum(plain[head].count(c) for c in ")]}")
            if depth <= 0 or head + 1 == len(plain):
                break
            head += 1
        last = head
        for j in range(head + 1, len(plain)):
            if plain[j].strip():
                if width(plain[j]) <= len(m[1]) and plain[j].lstrip()[0] not in ")]}":
                    break
                last = j
            elif lines[j].strip() and width(lines[j]) > len(m[1]):
                last = j  # a line of a string
        first = i
        while first and plain[first - 1].lstrip().startswith("@") and width(plain[first - 1]) == len(m[1]):
            first -= 1
        while open_ and open_[-1][0] >= len(m[1]):
            open_.pop()
        doc = _PY_DOC.match(text, starts[min(head + 1, len(lines))])
        calls = list(dict.fromkeys(c for c in _PY_CALL.findall("\n".join(plain[head + 1 : last + 1])) if c not in _PY_WORDS))
        claims = [x.strip()[7:] for x in lines[head + 1 : last + 1] if x.strip().startswith("assert ")]
        row = _row(path, repo, "python", "class" if m[2] == "class" else "function", m[3], [a for _, a in open_], first + 1, last + 1, lines, lines[i].strip().rstrip(":"), doc[2] if doc else None, calls, claims, [x.strip()[1:] for x in lines[first:i]])
        out.append(row)
        open_.append((len(m[1]), row))
    return out


_SKIP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|`(?:\\.|[^`\\])*`?|'(?:\\.|[^'\\\n])'|'(?:[^'\\\n]|\\.)*'(?=[\s,;)\]}])", re.S)


def parse_braces(path: str, text: str, language: str, repo: str) -> list[dict]:
    """Declarations and their blocks: strings and comments are blanked, then brackets are matched in one pass."""
    blank = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    lines, bare = text.split("\n"), blank.split("\n")
    close: dict[int, int] = {}
    stack: list[int] = []
    opened: dict[int, list[int]] = {}
    for n, row in enumerate(bare, 1):
        for c in row:
            if c == "{":
                stack.append(n)
            elif c == "}" and stack:
                opened.setdefault(stack.pop(), []).append(n)
    for n, ends in opened.items():
        close[n] = max(ends)
    out: list[dict] = []
    above: list[dict] = []
    for n, row in enumerate(bare, 1):
        while above and above[-1]["end_line"] < n:
            above.pop()
        for rule, kind in _RULES.get(language, []):
            m = rule.match(row)
            if not m or m.group(1) in _NOT_CALLS:
                continue
            inside = bool(above) and above[-1]["kind"] in _CONTAINERS
            if kind == "method" and language == "java" and not above:
                kind = "function"  # outside of any class
            if kind == "method" and not inside and language not in ("go",) or kind == "function" and "=" not in m.group() and language in ("rust", "c", "cpp") and inside:
                if kind == "method":
                    continue
                kind = "method"
            start = next((k for k in range(n, min(n + 8, len(bare)) + 1) if "{" in bare[k - 1] or bare[k - 1].rstrip().endswith(";")), n)
            end = close.get(start, n) if "{" in bare[start - 1] else start
            first = n
            while first > 1 and re.match(r"\s*(@\w|#\[)", lines[first - 2]):
                first -= 1
            body = "\n".join(bare[n - 1 : end])
            calls = [c for c in dict.fromkeys(x.strip() for x in _CALL.findall(body.split("{", 1)[-1])) if c.split(".")[0] not in _NOT_CALLS]
            name = m.group(1).split("::")[-1]
            doc = _comment_above(lines, first)
            r = _row(path, repo, language, kind, name, above, first, max(end, n), lines, lines[n - 1].strip().rstrip("{").strip(), doc, calls if kind not in _CONTAINERS else [], [])
            out.append(r)
            above.append(r)
            break
    return out


def _comment_above(lines: list[str], first: int) -> str | None:
    i = first - 2
    if i < 0:
        return None
    if lines[i].rstrip().endswith("*/"):
        j = i
        while j > 0 and "/*" not in lines[j]:
            j -= 1
        return "\n".join(lines[j : i + 1]).strip()
    j = i
    while j >= 0 and lines[j].strip().startswith("//"):
        j -= 1
    return "\n".join(lines[j + 1 : i + 1]).strip() or None


def parse_bound(path: str, text: str, language: str, repo: str, known: list[dict]) -> list[dict]:
    """Functions bound to properties, and macro-made symbols; what a declaration has already named is left out."""
    blank, lines = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text), text.split("\n")
    found = synthetic.cpp_macros(text) if language == "cpp" else synthetic.javascript(text, blank)
    have = {(r["name"], r["start_line"]) for r in known} | {(r["kind"], r["fqname"]) for r in known}
    line = lambda p: text.count("\n", 0, p) + 1
    out = []
    for kind, owner, name, start, end in found:
        first = line(start)
        around = [r for r in known if r["kind"] in _CONTAINERS and r["start_line"] <= first <= r["end_line"]] if language == "cpp" else []
        fq = ".".join(x for x in ((around[-1]["fqname"] if around else None), owner) if x)
        box = [{"id": None, "fqname": fq}] if fq else []
        calls = [c for c in dict.fromkeys(x.strip() for x in _CALL.findall(blank[start:end].split("{", 2)[-1])) if c.split(".")[0] not in _NOT_CALLS] if language != "cpp" else []
        r = _row(path, repo, language, kind, name, box, first, line(max(start, end - 1)), lines, lines[first - 1].strip(), _comment_above(lines, first), calls, [])
        if (name, first) not in have and (kind, r["fqname"]) not in have:
            have.add((name, first))
            out.append(r)
    return out


def parse_text(path: str, language: str, text: str, repo: str) -> list[dict]:
    rows = parse_python(path, text, repo) if language == "python" else parse_braces(path, text, language, repo)
    if language in ("javascript", "typescript", "tsx", "cpp"):
        rows += parse_bound(path, text, language, repo, rows)
    return sorted({r["id"]: r for r in rows}.values(), key=lambda r: (r["file_path"], r["start_line"], r["end_line"], r["id"]))


def symbols(files: DataFrame, repo_id: str, commit_hash: str = "unknown") -> DataFrame:
    """The symbol relation of files (path, language, content): one file is parsed in one task, files are spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[dict] = []
            for path, language, text in zip(*(b.column(c).to_pylist() for c in ("path", "language", "content"))):
                out += parse_text(path, (language or "").lower(), text, repo_id)
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

    many = pa.list_(pa.string())
    s, i = pa.string(), pa.int32()
    kinds = {"start_line": i, "end_line": i, "exported": pa.bool_(), "tokens_estimate": i, "invariants": many, "calls": many, "is_serialization_boundary": pa.bool_(),
             "signals": pa.list_(pa.struct([("type", s), ("payload", pa.map_(s, s)), ("source", s), ("confidence", pa.float64())]))}
    names = re.findall(r"(?:^|, )(\w+) (?=string|int|boolean|array)", DDL)
    SCHEMA = pa.schema([(n, kinds.get(n, s)) for n in names])
    rows = files.select("path", "language", "content").filter("path IS NOT NULL AND content IS NOT NULL").mapInArrow(run, DDL)
    return rows.withColumns({"commit_hash": F.lit(commit_hash), "covered_by": F.array().cast("array<string>"), "embedding_vector": F.lit(None).cast("array<float>"), "attributes": F.create_map().cast("map<string,string>")})


def project_signals(df: DataFrame) -> DataFrame:
    """invariants, calls and flags folded from the signals of each row."""
    of = lambda t, k: F.array_distinct(F.transform(F.filter("signals", lambda s: s.type == t), lambda s: s.payload[k]))
    return df.withColumns({"invariants": of("code.invariant", "expression"), "calls": of("code.call", "target"),
                           "is_serialization_boundary": F.exists("signals", lambda s: s.type == "boundary.serialization"), "implicit_contract": F.try_element_at(of("test.implicit_contract", "text"), F.lit(1))})


def languages(spark: SparkSession) -> DataFrame:
    """language, symbols, imports, engine: what each language is covered by."""
    rows = [("python", True, True, "syntax tree")] + [(k, True, k not in ("c", "cpp"), "brace scanner") for k in sorted(_RULES)]
    return spark.createDataFrame(rows, "language string, symbols boolean, imports boolean, engine string")
