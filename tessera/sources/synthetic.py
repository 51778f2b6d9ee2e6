"""Symbols that no declaration names: functions bound to properties in JavaScript, and what C++ macros declare."""

from __future__ import annotations

import re
from collections.abc import Iterator

_NAME = r"[A-Za-z_$][\w$]*"
_CALLABLE = rf"(?:async\s+)?(?:(?P<kind>function|class)\b|\([^()]*\)\s*=>|{_NAME}\s*=>)"
_DEFINE = re.compile(rf"Object\.defineProperty\(\s*({_NAME}(?:\.{_NAME})*)\s*,\s*(['\"])({_NAME})\2\s*,\s*\{{")
_DESCRIPTOR = re.compile(rf"\b(?:value|get|set)\s*(?:\([^()]*\)\s*\{{|:\s*{_CALLABLE})")
_OBJECT = re.compile(rf"(?:(?:const|let|var)\s+)?({_NAME}(?:\.{_NAME})*)\s*=\s*\{{")
_MEMBER = re.compile(rf"\s*(?:(?:get|set|async)\s+)?({_NAME})\s*(?:\([^()]*\)\s*\{{|:\s*{_CALLABLE})")
_ALIAS = re.compile(rf"(?:const|let|var)\s+({_NAME})\s*=\s*({_NAME}(?:\.{_NAME})*)\s*(?:;|\n)")
_MACRO = re.compile(r"^[ \t]*#[ \t]*define[ \t]+(\w+)\(([^()]*)\)((?:[^\n]*\\\n)*[^\n]*)", re.M)
_IDENTIFIER = re.compile(r"[A-Za-z_]\w*")


def _block(blank: str, start: int) -> int:
    """Place after the bracket that closes the one at start; the text's end if none does."""
    depth = 0
    for m in re.finditer(r"[{}]", blank[start:]):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return start + m.end()
    return len(blank)


def javascript(text: str, blank: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(kind, owner, name, start, end) of functions in Object.defineProperty descriptors and in objects that are bound to a name; aliases of an owner count as the owner."""
    alias = dict(_ALIAS.findall(blank))
    real = lambda p: ".".join([alias.get(p.split(".")[0], p.split(".")[0]), *p.split(".")[1:]])
    for m in _DEFINE.finditer(text):
        if blank[m.start()] == " ":
            continue
        end = _block(blank, m.end() - 1)
        d = _DESCRIPTOR.search(blank, m.end(), end)
        if d:
            yield ("class" if d.group("kind") == "class" else "method"), real(m.group(1)), m.group(3), m.start(), end
    for m in _OBJECT.finditer(blank):
        end, at, depth = _block(blank, m.end() - 1), m.end(), 0
        fresh = True  # a member begins after the opening bracket or a comma at depth 0
        while at < end - 1:
            c = blank[at]
            if fresh and not depth and (k := _MEMBER.match(blank, at)):
                if k.group("kind") != "class" and k.group(1) not in ("function", "if", "for", "while", "switch"):
                    name_at = k.start(1)
                    brace = blank.find("{", k.end() - 1, end)
                    stop = _block(blank, brace) if brace >= 0 else k.end()
                    yield "method", real(m.group(1)), k.group(1), name_at, stop
                    at = max(stop, k.end())
                    fresh = False
                    continue
            depth += (c in "{([") - (c in "})]")
            fresh = (fresh and c.isspace()) or (c == "," and not depth)
            at += 1


def cpp_macros(text: str) -> Iterator[tuple[str, str | None, str, int, int]]:
    """(kind, owner, name, start, end) of classes, methods and functions that a macro's parameters name, at each use with plain names."""
    patterns = {}
    for m in _MACRO.finditer(text):
        params, body = [p.strip() for p in m.group(2).split(",") if p.strip()], m.group(3)
        for i, p in enumerate(params):
            if re.search(rf"\b(?:class|struct)\s+{re.escape(p)}\b", body):
                patterns[m.group(1)] = ("class", None, i, len(params))
                break
            owner = next((j for j, o in enumerate(params) if re.search(rf"\b{re.escape(o)}::{re.escape(p)}\s*\(", body)), None)
            if owner is not None:
                patterns[m.group(1)] = ("method", owner, i, len(params))
                break
            if re.search(rf"\w[\s*&]+{re.escape(p)}\s*\([^()]*\)\s*(?:const\s*)?\\?\s*\{{", body):
                patterns[m.group(1)] = ("function", None, i, len(params))
                break
    if not patterns:
        return
    spans = [m.span() for m in _MACRO.finditer(text)]
    for m in re.finditer(rf"\b({'|'.join(map(re.escape, patterns))})\(([^()]*)\)", text):
        kind, owner, i, n = patterns[m.group(1)]
        args = [a.strip() for a in m.group(2).split(",")]
        if len(args) == n and all(_IDENTIFIER.fullmatch(args[k]) for k in ({i} | ({owner} if owner is not None else set()))) and not any(a <= m.start() < b for a, b in spans):
            yield kind, (args[owner] if owner is not None else None), args[i], m.start(), m.end()
