"""All named queries, and the SQL that states the same results."""

from __future__ import annotations

from parlance.plans import changes, metrics, record, speech, texts, upkeep, voices

MODULES = (record, speech, texts, voices, metrics, upkeep, changes)


def queries() -> dict:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
