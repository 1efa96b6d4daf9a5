"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from orrery.llm import decontamination, exact_dedup, language, licenses, line_dedup, mixing, near_dedup, ppm, quality, warc

MODULES = (decontamination, mixing, near_dedup, language, ppm, licenses, quality, exact_dedup, line_dedup, warc)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
