"""All queries by name, and their SQL."""

from __future__ import annotations

from gleanery.plans import catalog, content, evaluation, fusion, ledgers, lexical, lookup, maintenance, memory, search, sinks, streams, training, vectors  # noqa: F401


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
