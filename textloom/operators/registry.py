"""Named plug-ins: analyzers and embedding back ends are kept in one of these each."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    """Names and what they stand for. A name is taken once; ``accepts`` says what may be added."""

    def __init__(self, kind: str, accepts: Callable[[Any], bool] = callable):
        self.kind, self.accepts, self.entries = kind, accepts, {}

    def adding(self, name: str) -> Callable[[Any], Any]:
        """Decorator that files the decorated object under ``name``."""
        if not (isinstance(name, str) and name):
            raise ValueError(f"the name of an {self.kind} is a non-empty string, not {name!r}")

        def file(entry: Any) -> Any:
            if not self.accepts(entry):
                raise TypeError(f"{entry!r} cannot serve as {self.kind}")
            if self.entries.setdefault(name, entry) is not entry:
                raise ValueError(f"there is an {self.kind} {name!r} by now; choose another name")
            return entry
        return file

    def names(self) -> list[str]:
        return sorted(self.entries)

    def find(self, name: str) -> Any:
        try:
            return self.entries[name]
        except KeyError:
            raise KeyError(f"no {self.kind} {name!r} among {', '.join(self.names())}") from None
