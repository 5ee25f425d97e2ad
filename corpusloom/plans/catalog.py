"""All queries of the core by name, and their SQL oracles."""

from __future__ import annotations

from corpusloom.plans import catalog_io, catalog_relational, catalog_rules, catalog_struct, catalog_systems, catalog_text  # noqa: F401
from corpusloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
