"""Factories by name: built in, from installed packages (entry points), or given as module:function. Used for parsers, embedding providers, stores and hosts of a watch."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from importlib.metadata import entry_points


class Registry:
    """Factories of one kind; entry points of the group are read when a name is first asked for, built-in ones go first."""

    def __init__(self, group: str, builtin: dict[str, Callable] | None = None, aliases: dict[str, str] | None = None):
        self.group, self.builtin, self.aliases = group, dict(builtin or {}), dict(aliases or {})

    def _installed(self) -> dict[str, object]:
        return {e.name: e for e in entry_points(group=self.group)}

    def available(self) -> list[tuple[str, str]]:
        """(name, builtin or entrypoint) in order."""
        names = {n: "entrypoint" for n in self._installed()} | {n: "builtin" for n in self.builtin}
        return sorted(names.items())

    def resolve(self, name: str, override: str | None = None) -> Callable:
        """The factory; override names a function of a module and wins."""
        if override:
            module, _, attribute = override.partition(":")
            found = getattr(import_module(module), attribute or "create", None)
            if not callable(found):
                raise LookupError(f"{override} is no factory")
            return found
        name = self.aliases.get(name, name)
        if name in self.builtin:
            return self.builtin[name]
        installed = self._installed()
        if name not in installed:
            raise LookupError(f"no factory of {self.group} is called {name}; there are {[n for n, _ in self.available()]}")
        return installed[name].load()


def stores() -> Registry:
    """How relations are kept: a function (spark, root) to something with read, stage and publish."""
    from tessera.operators.relations import Store

    return Registry("tessera.stores", {"files": Store}, {"parquet": "files", "default": "files"})


def hosts() -> Registry:
    """How a watch runs: a function (query, beat, wanted) that returns when the watch has ended."""
    from tessera.streaming.watch import serve

    return Registry("tessera.hosts", {"foreground": serve}, {"default": "foreground"})
