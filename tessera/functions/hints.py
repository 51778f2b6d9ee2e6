"""Query analysis on the driver: a query is a parameter, not data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Word lists and phrases of the query analysis.
DECLARATION_WORDS = ["def", "class", "function", "method", "struct", "interface", "trait", "enum"]
DECLARATION_MODIFIERS = ["async", "public", "private", "protected", "static", "export"]
STOPWORDS = ["the", "and", "for", "with", "from", "error", "line"]
QUESTION_WORDS = ["what", "where", "when", "why", "how", "which", "who", "should", "does", "order", "tuple", "table", "safe", "safety", "return", "returns", "behavior", "behaviour"]
PROCESS_WORDS = ["absolute", "alias", "config", "configs", "footer", "forwarded", "format", "order", "parity", "preserve", "redirect", "tuple", "uri", "workflow", "workflows"]
WORKFLOW_PHRASES = [
    "ci", "workflow", "workflows", ".github", "github actions", "matrix", "label", "labels", "backport", "stable branch", "stable/", "subject prefix", "commit prefix", "backport footer",
    "contributing", "review stage", "trac", "lane", "migrations workflow", "pyproject.toml", "tox.ini",
]
DOCS_PHRASES = ["docs", "docs/internals", "readme", "changelog", "history", "release notes", "release-notes", "deprecation", "paper trail", "warning", "warnings"]
LITERAL_SIGNS = "[](){}<>/=+-."

# The patterns of words, dotted names, quoted literals, paths, stack lines, identifiers, and of usage and test intent.
_WORD = re.compile(r"\b[A-Za-z_][A-Za-z0-9_]*\b")
_DOTTED = re.compile(r"\b[A-Za-z_][A-Za-z0-9_]*(?:[.:#][A-Za-z_][A-Za-z0-9_]*)*\b")
_QUOTED = re.compile(r"[\"']([^\"']+)[\"']")
_PATH = re.compile(r"(?:\.?/?[A-Za-z0-9_./-]+\.[A-Za-z0-9_]+)")
_STACK = re.compile(r"([A-Za-z0-9_./-]+\.[A-Za-z0-9_]+):([0-9]{1,7})")
_WHOLE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:[.:#][A-Za-z_][A-Za-z0-9_]*)*(?:\(\))?\s*\(?")
_USAGE = re.compile(r"\b(?:calls?|callers?|uses?|usages?|references?|refs?)\b", re.I)
_TESTS = re.compile(r"\b(?:tests?|pytest|fixture|unittest|spec)\b", re.I)


@dataclass(frozen=True)
class Hints:
    query: str
    symbols: list[str] = field(default_factory=list)
    literals: list[str] = field(default_factory=list)
    verbatim: str | None = None
    paths: list[str] = field(default_factory=list)
    stack: list[tuple[str, int]] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)
    declarations: list[str] = field(default_factory=list)
    kind: str = "natural_language"
    domain: str = "code"
    literal_first: bool = False


def unique(values: list[str]) -> list[str]:
    """Without blanks and repetitions, in order of first occurrence."""
    return list(dict.fromkeys(v.strip() for v in values if v.strip()))


def strip_declaration(query: str) -> tuple[str, list[str]]:
    words = query.split()
    rest = words
    while rest and rest[0].lower() in DECLARATION_MODIFIERS:
        rest = rest[1:]
    found = []
    while rest and rest[0].lower() in DECLARATION_WORDS:
        found.append(rest[0].lower())
        rest = rest[1:]
    return (" ".join(rest) if found and rest else query.strip()), found


def is_identifier(query: str) -> bool:
    return bool(_WHOLE.fullmatch(query.strip()))


def symbol_shaped(symbols: list[str]) -> bool:
    return any(re.search(r"[_.:#]", s) or any(c.isupper() for c in s[1:]) for s in symbols)


def verbatim_literal(query: str) -> str | None:
    q = query.strip()
    return q if re.fullmatch(r"\S+", q) and re.search(r"[/\\]", q) and any(c.isalnum() for c in q) else None


def literal_first(query: str) -> bool:
    q = query.strip()
    if not re.fullmatch(r"\S{3,}", q) or is_identifier(q) or not any(c.isalnum() for c in q):
        return False
    return any(c in LITERAL_SIGNS or c == "\\" for c in q if not c.isalnum())


def query_domain(query: str, more: list[str] = (), whole_words: bool = False) -> str:
    """Phrases are found anywhere, also within words, unless whole_words is set."""
    texts = [x.lower() for x in [query, *more]]
    has = (lambda p, t: re.search(rf"(?<!\w){re.escape(p)}(?!\w)", t)) if whole_words else (lambda p, t: p in t)
    flow, docs = (sum(any(has(p, t) for t in texts) for p in phrases) for phrases in (WORKFLOW_PHRASES, DOCS_PHRASES))
    return "workflow_config" if flow and flow >= docs else "docs_policy" if docs else "code"


def query_kind(query: str, declarations: list[str], symbols: list[str], tokens: list[str]) -> str:
    named = bool(symbols or tokens)
    if declarations and named:
        return "declaration"
    if is_identifier(query):
        return "identifier"
    words = {w.lower() for w in _WORD.findall(query) if len(w) >= 3} - set(STOPWORDS)
    if not named:
        return "natural_language"
    if words & {*PROCESS_WORDS, *QUESTION_WORDS}:
        return "mixed"
    return "identifier" if symbol_shaped(symbols) and len(words) <= 2 else "mixed"


def analyze(query: str) -> Hints:
    rest, declarations = strip_declaration(query)
    literals, paths = unique(_QUOTED.findall(query)), unique(_PATH.findall(query))
    quoted = [s for x in literals for s in _DOTTED.findall(x) if s.lower() not in DECLARATION_WORDS]
    dull = {*STOPWORDS, *DECLARATION_WORDS}
    symbols = unique([s for s in _DOTTED.findall(rest) if len(s) >= 3 and s.lower() not in dull] + [s for s in quoted if s.lower() not in dull])
    tokens = unique([t.lower() for t in _WORD.findall(rest) if len(t) >= 3 and t.lower() not in DECLARATION_WORDS] + [s.lower() for s in quoted])
    stack = [(p.strip(), int(n)) for p, n in _STACK.findall(query) if int(n) >= 1]
    return Hints(query, symbols, literals, verbatim_literal(query), paths, stack, tokens, declarations, query_kind(query, declarations, symbols, tokens), query_domain(query, [*paths, *literals]), literal_first(query))


def tails(symbols: list[str]) -> list[str]:
    return unique([re.split(r"[.:#]", s)[-1] for s in symbols])


def identifier_candidates(h: Hints) -> list[str]:
    return unique([t for t in [*tails(h.symbols), *h.symbols, *h.tokens] if len(t) >= 3])


def usage_intent(query: str) -> bool:
    return bool(_USAGE.search(query))


def test_intent(query: str, file_filter: str | None = None) -> bool:
    low = query.strip().lower()
    hit = _TESTS.search(query) or "/tests/" in low or low.startswith("tests/") or " test_" in f" {low}"
    return bool(hit or file_filter and re.search(r"(^|/)(tests?/|test_)|_test\.(py|go)$|\.spec\.[jt]sx?$", file_filter.lower()))


def identifier_tail(query: str) -> str | None:
    """Last part of a query that is one identifier."""
    q = query.strip()
    return re.split(r"[.:#]+", q)[-1] if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(?:[.:#]+[A-Za-z_][A-Za-z0-9_]*)*", q) else None


def split_operands(parts: list[str], known_paths: list[str] = ()) -> tuple[str, list[str]]:
    """(query, paths): words at the end of a query that look like paths (or are known ones) become scope filters, unless nothing else is left."""
    looks = lambda p: p in known_paths or bool(re.fullmatch(r"\.{0,2}/?[\w.-]+(/[\w.-]+)*/?", p)) and ("/" in p or p in (".", ".."))
    k = len(parts)
    while k > 1 and looks(parts[k - 1]):
        k -= 1
    return " ".join(parts[:k]), [p.rstrip("/") or p for p in parts[k:]]
