"""Scalar functions whose Spark namesake differs: the semantics of the query dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def greatest(*columns: Column) -> Column:
    """Null if any argument is null."""
    return F.when(_any_null(columns), None).otherwise(F.greatest(*columns))


def least(*columns: Column) -> Column:
    return F.when(_any_null(columns), None).otherwise(F.least(*columns))


def _any_null(columns: tuple[Column, ...]) -> Column:
    out = columns[0].isNull()
    for c in columns[1:]:
        out = out | c.isNull()
    return out


def log(x: Column, base: float) -> Column:
    """Argument first, base second."""
    return F.log(float(base), x)


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def contains_substr(text: Column, part: str) -> Column:
    """Case-insensitive."""
    return F.lower(text).contains(part.lower())


def regexp_extract(text: Column, pattern: str) -> Column:
    """The first group if there is one, else the match; null without a match."""
    group = 1 if "(" in pattern.replace("\\(", "").replace("(?", "") else 0
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def trunc_week(day: Column) -> Column:
    """Weeks start on Sunday."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def week_of_year(day: Column) -> Column:
    """Weeks start on Sunday; days before the first Sunday are in week 0."""
    return F.floor((F.dayofyear(day) + 7 - F.dayofweek(day)) / 7).cast("int")


def date_diff(later: Column, earlier: Column, unit: str) -> Column:
    """Boundaries crossed, not whole units passed."""
    months = F.year(later) * 12 + F.month(later) - F.year(earlier) * 12 - F.month(earlier)
    match unit.upper():
        case "DAY":
            return F.datediff(later, earlier)
        case "WEEK":
            return (F.datediff(trunc_week(later), trunc_week(earlier)) / 7).cast("int")
        case "MONTH":
            return months
        case "QUARTER":
            return F.year(later) * 4 + F.quarter(later) - F.year(earlier) * 4 - F.quarter(earlier)
        case "YEAR":
            return F.year(later) - F.year(earlier)
    raise ValueError(f"unit {unit}")
