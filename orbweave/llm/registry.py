"""Queries and SQL of the subpackage's operators."""

from __future__ import annotations

from orbweave.llm import chroma, conversations, ctph, decontaminate, divergence, langid, licenses, linededup, mixing, neardup, pieces, pii, secrets

MODULES = (secrets, licenses, langid, linededup, mixing, neardup, pieces, pii, chroma, ctph, decontaminate, divergence, conversations)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
