"""Named queries over the test tables, with the same queries as SQL where SQL can say them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("cleaning", "properties", "scoring", "splitting", "files", "learning")


def _collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(import_module(f"seqtables.catalog.{module}"), name)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("Q")


def oracle_sql() -> dict[str, str]:
    return _collect("SQL")
