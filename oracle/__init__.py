"""DuckDB statements equivalent to the registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("corpus", "retrieval", "answers", "quality", "records")


def statements() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out.update(import_module(f"oracle.{name}").SQL)
    return out
