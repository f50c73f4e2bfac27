"""Times as text and back, as Column expressions; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(x: Column, micros: bool = True) -> Column:
    """``2024-01-02T03:04:05.678901+00:00``, or without the fraction; as usual none is written for a whole second."""
    whole, zone = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")
    fraction = F.date_format(x, "SSSSSS")
    return F.concat(whole, F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), zone) if micros else F.concat(whole, zone)


def run_id(x: Column) -> Column:
    """``20240102T030405Z``."""
    return F.date_format(x, "yyyyMMdd'T'HHmmss'Z'")


def local(x: Column, zone: str) -> Column:
    """``2024-01-02 12:04:05`` in a time zone."""
    return F.date_format(F.from_utc_timestamp(x, zone), "yyyy-MM-dd HH:mm:ss")


def midnight(x: Column) -> Column:
    """The beginning of a date's day."""
    return x.cast("date").cast("timestamp")


def day(x: Column) -> Column:
    """``2024-01-02``; null stays."""
    return F.date_format(x, "yyyy-MM-dd")


def parsed_day(x: Column) -> Column:
    """A date from ``2024-01-02``, ``2024.1.2``, ``2024/01/02``, ``20240102`` or ``2024-01`` (its first day), else null."""
    text = F.regexp_replace(F.trim(x), r"[./]\\s*", "-")
    full = F.when(text.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))
    month = F.when(text.rlike("^[0-9]{4}-[0-9]{1,2}$"), F.concat(text, F.lit("-1")))
    return F.coalesce(full, month, text).try_cast("date")
