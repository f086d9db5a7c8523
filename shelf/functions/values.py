"""Null, default and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_default(c: Column | str, default) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(default))


def first_or(c: Column | str, default: str) -> Column:
    """First array element; ``default`` for a NULL or empty array."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.size(c) > 0, F.get(c, F.lit(0))).otherwise(F.lit(default))


# fixed values: the three accepted spellings of a date
DAY, MONTH, YEAR = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}$", r"^\d{4}$"


def published_date(c: Column | str) -> Column:
    """Full date, or the first day of a bare month or year; anything else NULL.

    The patterns guard the cast: on its own it would also take '2020-5' or '20200'.
    """
    c = F.col(c) if isinstance(c, str) else c
    spelled = (
        F.when(c.rlike(DAY), c)
        .when(c.rlike(MONTH), F.concat(c, F.lit("-01")))
        .when(c.rlike(YEAR), F.concat(c, F.lit("-01-01")))
    )
    return spelled.try_cast("date")


def publication_year(c: Column | str) -> Column:
    """Year of a full date, else the leading four digits of a bare month or year.

    '2020-13' has no date but still a year.
    """
    c = F.col(c) if isinstance(c, str) else c
    return (
        F.when(c.rlike(DAY), F.year(c.try_cast("date")))
        .when(c.rlike(MONTH) | c.rlike(YEAR), F.substring(c, 1, 4).try_cast("int"))
    )
