"""Queries from plain values: conditions, grouping, fields, order and pages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _single(name: str, value: Any, like: frozenset[str], unequal: bool) -> Column:
    field = F.col(name)
    if callable(value):
        return value(field)
    if name in like:
        return F.contains(field.cast("string"), F.lit(str(value)))
    if value is None:
        return field.isNotNull() if unequal else field.isNull()
    return field != F.lit(value) if unequal else field == F.lit(value)


def condition(columns: list[str], where: dict[str, Any], like: str | None = None, between: str | None = None, any_of: str | None = None) -> Column:
    """All of the ``where`` entries together.

    A list stands for any of its values, a leading ``_`` of a name for "not equal", a function for what it returns of the
    column. Names in ``like`` have to contain the value, those in ``between`` lie within the two values; of the names in
    ``any_of`` one has to hold. The three are comma-separated names. Entries of unknown columns are left out.
    """
    likes, ranges, either = (frozenset(n.strip() for n in (x or "").split(",") if n.strip()) for x in (like, between, any_of))
    found: list[Column] = []
    alternatives: list[Column] = []
    for key, value in where.items():
        unequal = key.startswith("_") and key not in columns
        name = key[1:] if unequal else key
        if name not in columns:
            continue
        values = list(value) if isinstance(value, (list, tuple)) else [value]
        if name in ranges:
            own = F.col(name).between(F.lit(values[0]), F.lit(values[1]))
        else:
            own = reduce(Column.__or__, [_single(name, v, likes, unequal) for v in values], F.lit(False))
        (alternatives if name in either else found).append(own)
    if alternatives:
        found.append(reduce(Column.__or__, alternatives))
    return reduce(Column.__and__, found, F.lit(True))


def _named(df: DataFrame, names: str | None) -> list[str]:
    return [n.strip() for n in (names or "").split(",") if n.strip() in df.columns]


def counted(df: DataFrame, group: str | None = None, like: str | None = None, between: str | None = None, any_of: str | None = None, **where: Any) -> DataFrame:
    """One row with ``n``: rows that hold, or groups of them where ``group`` names columns."""
    rows = df.filter(condition(df.columns, where, like, between, any_of))
    keys = _named(df, group)
    return (rows.select(*keys).distinct() if keys else rows).agg(F.count("*").alias("n"))


def selected(
    df: DataFrame, fields: str | None = None, group: str | None = None, order_by: str | None = None, descending: bool = False, page: int | None = None, size: int = 10,
    change: Callable[[DataFrame], DataFrame] | None = None, like: str | None = None, between: str | None = None, any_of: str | None = None, **where: Any,
) -> DataFrame:
    """Rows that hold: fields, one row a group (its number of rows as ``n``), order and page (from 1), unknown names left out.

    ``change`` rewrites the query before fields and order are taken.
    """
    rows = df.filter(condition(df.columns, where, like, between, any_of))
    rows = change(rows) if change else rows
    keys = _named(rows, group)
    rows = rows.groupBy(*keys).agg(F.count("*").alias("n")) if keys else rows
    order = [F.desc_nulls_last(n) if descending else F.asc_nulls_first(n) for n in _named(rows, order_by)]
    rows = rows.orderBy(*order) if order else rows
    if page is not None:
        rows = rows.offset((max(1, page) - 1) * size).limit(size)
    names = _named(rows, fields)
    return rows.select(*names) if names else rows
