"""Code-duplication analytics on Spark: exact groups, near-duplicate pairs, refactoring candidates, policy checks."""

from __future__ import annotations

from importlib import import_module

_PUBLIC = {
    "Scan": "plans.engine",
    "abstract_candidates": "plans.engine",
    "exact_groups": "plans.engine",
    "from_directory": "sources.tables",
    "from_table": "sources.tables",
    "near_matches": "plans.engine",
}
__all__ = list(_PUBLIC)


def __getattr__(name: str):
    """Workers import parts of the package often and need little of it, so public names load when used."""
    if name not in _PUBLIC:
        raise AttributeError(name)
    return getattr(import_module(f".{_PUBLIC[name]}", __name__), name)
