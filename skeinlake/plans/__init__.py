"""Named queries of the library and the SQL that states each of them."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and SQL.
MODULES = ["general", "reference"]


def _all(kind: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__name__}.{m}"), kind)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
