"""Tolerant casts for untyped records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import _col


def to_number(c: Column | str) -> Column:
    """Double, or null when the value is not a number (ANSI casts would fail)."""
    return _col(c).try_cast("double")


def to_whole(c: Column | str) -> Column:
    """Long; '3.0' is accepted through double. Null when not a number.

    Whole numbers are cast as they are, because a double holds them only up to 2**53.
    """
    return F.coalesce(_col(c).try_cast("long"), to_number(c).try_cast("long"))


def epoch_ms_to_time(c: Column | str) -> Column:
    """Epoch milliseconds to a zone-free UTC timestamp; null when not a number.

    Zone-free (TIMESTAMP_NTZ), so the value does not move with the session zone.
    """
    ms = to_whole(c)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), ms.cast("decimal(20,0)") / F.lit(1000).cast("decimal(4,0)")
    )


def to_flag(c: Column | str) -> Column:
    """Boolean; missing or unreadable gives false."""
    return F.coalesce(_col(c).try_cast("boolean"), F.lit(False))


def to_text(c: Column | str) -> Column:
    """String; missing gives ''."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def first_non_null(*columns: Column | str) -> Column:
    return F.coalesce(*[_col(c) for c in columns])
