"""Ordered policy gates: a row's first failing reason, or all of them, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Checks = list[tuple[str, Column]]


def first_reason(checks: Checks, passed: str) -> Column:
    """The name of the first check that holds; a null check does not hold."""
    out = F
    for name, check in checks:
        out = out.when(check, F.lit(name))
    return out.otherwise(F.lit(passed))


def all_reasons(checks: Checks) -> Column:
    """The sorted names of all checks that hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(check, F.lit(name)) for name, check in checks])))


def quality_band(length: Column, confidence: Column | None = None) -> Column:
    """low, medium or high by length and, where known, the recognition confidence (0 to 100)."""
    sure = F.lit(None).cast("double") if confidence is None else confidence
    return F.when(sure < 45, "low").when((length >= 500) & (sure.isNull() | (sure >= 70)), "high").when(length >= 120, "medium").otherwise("low")


def page_class(page: Column, text: Column, quality: Column) -> Column:
    """blank, front_matter, low_quality or body."""
    return (
        F.when(F.length(F.trim(text)) < 40, "blank").when((page <= 8) & text.rlike("목차|머리말|판권|차례"), "front_matter").when(quality == "low", "low_quality").otherwise("body")
    )
