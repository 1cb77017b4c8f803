"""All queries of the engine, by name, with their SQL counterparts."""

from __future__ import annotations

from . import books, jobs, mosaics, pages, pixels, texts, wholes  # noqa: F401  they register their queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
