"""All queries of the library and their SQL."""

from __future__ import annotations

from tidepanel.plans import evaluation, panels, registry, stores  # noqa: F401  the modules register their queries


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.SQL)
