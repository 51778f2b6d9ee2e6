"""Queries that are written as a grep or rg command line, read on the driver."""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass, field

# Flags without effect here, and flags whose value is skipped.
IGNORED_FLAGS = ["-n", "-H", "-r", "-R", "-l", "-c", "-o", "-h", "-s", "-I", "-E", "-P", "-a", "-u", "-uu", "-uuu", "--line-number", "--no-heading", "--color", "--hidden", "--recursive", "--files-with-matches", "--count", "--with-filename"]
VALUE_FLAGS = ["-A", "-B", "-C", "-m", "-t", "-T", "-j", "-d", "--after-context", "--before-context", "--context", "--max-count", "--type", "--type-not", "--threads", "--max-depth", "--sort"]


@dataclass(frozen=True)
class Grep:
    command: str | None = None
    pattern: str | None = None
    quoted: bool = False
    paths: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    case: str = "sensitive"
    word: bool = False
    fixed: bool = False
    unknown: list[str] = field(default_factory=list)
    error: str | None = None


def parse(query: str) -> Grep:
    """Anything but a command line of grep, egrep, fgrep or rg comes back without a command."""
    if not re.match(r"\s*(?:rg|[ef]?grep)\s", query):
        return Grep()
    try:
        lexer = shlex.shlex(query, posix=False)
        lexer.whitespace_split, lexer.commenters = True, ""
        raw, argv = list(lexer), shlex.split(query)
    except ValueError as e:
        return Grep(command=query.split()[0], error=str(e))
    if len(raw) != len(argv):
        raw = argv
    out: dict = {"command": argv[0], "fixed": argv[0] == "fgrep", "case": "sensitive", "word": False}
    rest: list[int] = []
    globs: list[str] = []
    unknown: list[str] = []
    i, plain = 1, False
    while i < len(argv):
        a = argv[i]
        name, _, value = a.partition("=")
        if plain or a == "-" or not a.startswith("-") or raw[i][:1] in "'\"":
            rest.append(i)
        elif a == "--":
            plain = True
        elif a in ("-i", "--ignore-case"):
            out["case"] = "ignore"
        elif a in ("-S", "--smart-case"):
            out["case"] = "smart"
        elif a in ("-w", "--word-regexp"):
            out["word"] = True
        elif a in ("-F", "--fixed-strings"):
            out["fixed"] = True
        elif name in ("-g", "--glob", "-e", "--regexp") or name in VALUE_FLAGS:
            if not value:
                i += 1
                if i >= len(argv):
                    return Grep(command=argv[0], error=f"{a} needs a value")
                value = argv[i]
            if name in ("-g", "--glob"):
                globs.append(value)
            elif name in ("-e", "--regexp"):
                rest.insert(0, i)
        elif a not in IGNORED_FLAGS and name not in IGNORED_FLAGS and not re.match(r"-[ABCmtTj]\d", a):
            unknown.append(a)
        i += 1
    if not rest:
        return Grep(command=argv[0], unknown=unknown, error="no pattern")
    k = rest[0]
    return Grep(**out, pattern=argv[k], quoted=raw[k][:1] in "'\"", paths=[argv[j].rstrip("/") or "/" for j in rest[1:]],
                include=[g for g in globs if not g.startswith("!")], exclude=[g[1:] for g in globs if g.startswith("!") and g[1:]], unknown=unknown)


def java_pattern(pattern: str, case: str = "sensitive", word: bool = False, fixed: bool = False) -> str:
    """Regular expression for rlike; a pattern that is none is taken literally."""
    body = re.escape(pattern) if fixed else pattern
    try:
        re.compile(body)
    except re.error:
        body = re.escape(pattern)
    if word:
        body = rf"(?<![A-Za-z0-9_])(?:{body})(?![A-Za-z0-9_])"
    fold = case == "ignore" or case == "smart" and pattern == pattern.lower()
    return f"(?i){body}" if fold else body
