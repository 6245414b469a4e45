"""All registered queries."""

from __future__ import annotations

from lexiloom.plans import registry


def _load() -> None:
    from lexiloom.plans import queries_data  # noqa: F401
    from lexiloom.plans import queries_text, queries_vectors, queries_scores, queries_jobs  # noqa: F401


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
