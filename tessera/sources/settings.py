"""Layered settings: defaults, a TOML or JSON file, environment, then explicit values; each layer wins over the one before."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

PREFIX = "TESSERA_"


@dataclass(frozen=True)
class Settings:
    max_chunk_bytes: int = 12_000
    embedding_profile: str = "hash-256"
    top_k: int = 5
    max_files: int = 8
    max_snippets: int = 12
    max_chars: int = 12_000
    snippet_chars: int = 320
    threshold_exact: float = 0.70
    threshold_semantic: float = 0.66
    threshold_symbol: float = 0.68
    watch_seconds: float = 0.3
    hidden: bool = False


# The ranges to which numbers are clamped.
RANGES = {"max_chunk_bytes": (256, None), "top_k": (1, 250), "max_files": (1, 200), "max_snippets": (1, 500), "max_chars": (200, None), "snippet_chars": (40, None), "threshold_exact": (0.0, 1.0), "threshold_semantic": (0.0, 1.0), "threshold_symbol": (0.0, 1.0), "watch_seconds": (0.05, None)}


def _coerce(name: str, kind: str, v: object) -> object:
    if kind == "bool":
        out: object = v if isinstance(v, bool) else str(v).strip().lower() in ("1", "true", "yes", "on")
    else:
        out = {"int": lambda x: int(float(x)), "float": float, "str": str}[kind](v)
    low, high = RANGES.get(name, (None, None))
    if low is not None:
        out = max(low, out)
    return min(high, out) if high is not None else out


def load_settings(path: str | None = None, env: dict[str, str] | None = None, **overrides) -> Settings:
    """Unknown keys are ignored; a value that can't be read as its type is an error that names the key."""
    layers: list[dict] = []
    if path and Path(path).exists():
        text = Path(path).read_text()
        layers.append(json.loads(text) if path.endswith(".json") else tomllib.loads(text))
    names = {f.name: f.type for f in fields(Settings)}
    e = os.environ if env is None else env
    layers.append({n: e[PREFIX + n.upper()] for n in names if PREFIX + n.upper() in e})
    layers.append({k: v for k, v in overrides.items() if v is not None})
    out = Settings()
    for layer in layers:
        for k, v in layer.items():
            if k in names:
                try:
                    out = replace(out, **{k: _coerce(k, names[k], v)})
                except (TypeError, ValueError, KeyError) as err:
                    raise ValueError(f"setting {k}: {v!r} is no {names[k]}") from err
    return out
