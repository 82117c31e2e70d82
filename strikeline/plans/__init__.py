"""Named queries over the option-market tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scans", "relations", "domain", "serving", "stores", "streams", "folders")


def load() -> tuple[dict, dict]:
    """All queries and their SQL."""
    for name in MODULES:
        import_module(f"strikeline.plans.{name}")
    from strikeline.plans.registry import ORACLE, QUERIES

    return QUERIES, ORACLE
