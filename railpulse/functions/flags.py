"""Predicates and labels on payment attempts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from railpulse import dimensions as D


def succeeded() -> Column:
    return F.col("final_status") == D.SUCCESS


def failed() -> Column:
    return F.col("final_status") == D.FAILED


def technical_by_code() -> Column:
    """Narrow technical decline: by code prefix, network errors excluded."""
    return F.col("failure_code").like(D.TD_CODES)


def business_by_code() -> Column:
    return F.col("failure_code").like(D.BD_CODES)


def technical_by_type() -> Column:
    """Wide technical decline: by declared decline type, network errors included."""
    return F.col("technical_or_business_decline") == D.TECHNICAL


def business_by_type() -> Column:
    return F.col("technical_or_business_decline") == D.BUSINESS


def timed_out() -> Column:
    return F.col("error_category") == D.TIMEOUT


def in_peak(hour: Column) -> Column:
    return hour.between(*D.PEAK_HOURS)


def hour_window(hour: Column) -> Column:
    label = F.lit(D.OTHER_HOURS)
    for low, high, name in reversed(D.HOUR_WINDOWS):
        label = F.when(hour.between(low, high), name).otherwise(label)
    return label


def amount_bucket(amount: Column, contiguous: bool = False) -> Column:
    """Bucket label of an amount.

    The published intervals are closed and leave gaps, whose amounts fall to the
    last label. ``contiguous`` closes the gaps: each bucket starts right above
    the end of the one before it.
    """
    label = F.lit(D.LARGE_LABEL)
    for low, high, name in reversed(D.AMOUNT_BUCKETS):
        inside = amount <= high if contiguous else amount.between(low, high)
        label = F.when(inside, name).otherwise(label)
    return F.when(amount < D.MICRO_LIMIT, D.MICRO_LABEL).otherwise(label)


def blank(column: str) -> Column:
    """NULL or empty text; columns of other types are compared as text."""
    return F.col(column).isNull() | (F.col(column).cast("string") == "")


def micros_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def count_where(condition: Column) -> Column:
    """Conditional count that is 0, never NULL, within a group."""
    return F.count(F.when(condition, 1))


def sum_where(condition: Column, amount: str = "amount") -> Column:
    return F.sum(F.when(condition, F.col(amount)).otherwise(F.lit(0)))
