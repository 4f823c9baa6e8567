"""Rounding and ratios.

Arguments are SQL expressions over columns, mostly a column name. One expression
text is one call into the JVM, where a tree of column calls would be twenty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _round_sql(value: str, digits: int) -> str:
    scale = f"{10.0**digits}D"
    return f"(sign({value}) * floor(abs({value}) * {scale} + 0.5D) / {scale} + 0D)"


def _ratio_sql(part: str, whole: str) -> str:
    return f"(cast({part} as double) / nullif(cast({whole} as double), 0D))"


def _percent_sql(part: str, whole: str) -> str:
    return f"(100D * cast({part} as double) / nullif(cast({whole} as double), 0D))"


def rounded(value: str, digits: int = 2) -> Column:
    """Round half away from zero in double arithmetic.

    ``F.round`` rounds the decimal rendering (1.005 gives 1.01). Published rates
    follow binary arithmetic (1.005 lies below the half and gives 1.0).
    """
    return F.expr(_round_sql(f"cast({value} as double)", digits))


def rounded_ratio(part: str, whole: str, digits: int = 2) -> Column:
    """part / whole, rounded; NULL when the whole is zero."""
    return F.expr(_round_sql(_ratio_sql(part, whole), digits))


def percent(part: str, whole: str, digits: int = 2) -> Column:
    return F.expr(_round_sql(_percent_sql(part, whole), digits))


def exact_percent(part: str, whole: str) -> Column:
    return F.expr(_percent_sql(part, whole))


def money(value: str) -> Column:
    """A decimal sum as a double with two digits."""
    return rounded(value, 2)
