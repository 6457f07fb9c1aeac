"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from loomstat.plans import measurement, publication, series, texts

_MODULES = (measurement, series, texts, publication)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
