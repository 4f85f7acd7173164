"""Every query of the library by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from vellum.queries import QUERIES, SQL, analysis, changes, facets, geo, ordering, predicates, relations, relevance  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
