"""All core queries by name, with the SQL each is compared with."""

from __future__ import annotations

from granary.plans import lists, rules, search, tables, texts, values

MODULES = (texts, values, search, tables, lists, rules)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
