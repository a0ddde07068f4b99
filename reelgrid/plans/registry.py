"""All queries of the library and their SQL."""

from __future__ import annotations

from reelgrid.plans import catalog, presentation, rules, search, serving, streams, tenants, text

MODULES = [serving, catalog, text, rules, presentation, search, streams, tenants]


def queries() -> dict:
    found: dict = {}
    for m in MODULES:
        if twice := found.keys() & m.QUERIES.keys():
            raise ValueError(f"queries of one name: {sorted(twice)}")
        found |= m.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
