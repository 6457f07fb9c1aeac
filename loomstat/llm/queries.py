"""The queries of the ten problems and their SQL; a query without SQL is tested against a plain definition in tests/llm."""

from __future__ import annotations

from loomstat.llm import annotators, near_copies, packing, percentiles, quota_sample, sentences, site_lines, stable_sample, text_quality, token_ids

_MODULES = (quota_sample, sentences, near_copies, percentiles, stable_sample, site_lines, annotators, token_ids, packing, text_quality)


def queries() -> dict:
    """Every function pN_... of the problems' modules, by name."""
    return {name: f for module in _MODULES for name, f in vars(module).items() if name[0] == "p" and name[1].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLE", {}).items()}
