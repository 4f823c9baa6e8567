"""Reliability over the hours of the day, the days of the week and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railpulse import dimensions as D
from railpulse.functions import flags
from railpulse.functions.numbers import percent, rounded, rounded_ratio
from railpulse.operators.tallies import tally, weighted


def _hour_tally(tx: DataFrame) -> DataFrame:
    return tally(weighted(tx), F.hour("timestamp").alias("hour_of_day"))


def hourly_profile(tx: DataFrame) -> DataFrame:
    """Counts and rates per hour of day; the technical rate is the narrow one."""
    total = F.col("total")
    return (
        _hour_tally(tx)
        .select(
            "hour_of_day",
            total.alias("total_txns"),
            F.col("success").alias("success_txns"),
            F.col("failed").alias("failed_txns"),
            percent("success", "total").alias("psr_percentage"),
            percent("failed", "total").alias("failure_rate_percentage"),
            percent("td_narrow", "total").alias("td_rate_percentage"),
            flags.hour_window(F.col("hour_of_day")).alias("time_window_type"),
        )
        .orderBy("hour_of_day")
    )


def hourly_chart(tx: DataFrame) -> DataFrame:
    """Volume, success and narrow technical decline rate per hour of day."""
    total = F.col("total")
    return (
        _hour_tally(tx)
        .select(
            "hour_of_day",
            total.alias("total_txns"),
            percent("success", "total").alias("psr_pct"),
            percent("td_narrow", "total").alias("td_rate_pct"),
        )
        .orderBy("hour_of_day")
    )


def peak_summary(tx: DataFrame) -> DataFrame:
    """The evening peak against the rest of the day."""
    period = F.when(flags.in_peak(F.hour("timestamp")), D.PEAK_LABEL).otherwise(D.OFF_PEAK_LABEL)
    t = tally(weighted(tx), period.alias("period_type"))
    total = F.col("total")
    return t.select(
        "period_type",
        total.alias("total_volume"),
        percent("success", "total").alias("psr_percentage"),
        percent("td_narrow", "total").alias("td_rate_percentage"),
        percent("bd_narrow", "total").alias("bd_rate_percentage"),
        rounded_ratio("value", "amounts").alias("avg_txn_amount"),
    )


def peak_multiplier(tx: DataFrame) -> DataFrame:
    """Average volume of a peak hour over that of an off-peak hour.

    Hours are averaged over the hours of day that occur.
    """
    hours = _hour_tally(tx).select("hour_of_day", F.col("total").alias("n"))
    peak = flags.in_peak(F.col("hour_of_day"))
    sides = hours.agg(
        F.avg(F.when(peak, F.col("n"))).alias("peak_avg"),
        F.avg(F.when(~peak, F.col("n"))).alias("off_peak_avg"),
    )
    return sides.select(
        rounded("peak_avg").alias("avg_peak_hour_volume"),
        rounded("off_peak_avg").alias("avg_off_peak_hour_volume"),
        rounded_ratio("peak_avg", "off_peak_avg").alias("peak_multiplier"),
    )


def weekday_profile(tx: DataFrame) -> DataFrame:
    """Counts and rates per day of week, Monday being 0."""
    t = tally(weighted(tx), F.weekday("timestamp").alias("day_of_week"))
    total = F.col("total")
    return t.select(
        "day_of_week",
        total.alias("total_txns"),
        F.col("failed").alias("failed_txns"),
        percent("success", "total").alias("psr_percentage"),
        percent("td_narrow", "total").alias("td_rate_percentage"),
    ).orderBy("day_of_week")


def rolling_failure_rate(tx: DataFrame, hours: int = 3) -> DataFrame:
    """Failure rate over the trailing ``hours`` clock hours, per hour with data.

    The frame is a time range, so hours without attempts do not stretch it. The
    window sees one row per hour of the covered period, not the attempts.
    """
    hour = F.date_trunc("HOUR", "timestamp").cast("timestamp_ntz")
    hourly = tally(weighted(tx), hour.alias("hour_start")).select(
        "hour_start", F.col("total").alias("n"), F.col("failed").alias("f")
    )
    # Clock hours as numbers make the range frame a plain numeric one.
    epoch_hour = F.timestamp_diff("HOUR", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("hour_start"))
    trailing = Window.orderBy("epoch_hour").rangeBetween(1 - hours, 0)
    return (
        hourly.withColumn("epoch_hour", epoch_hour)
        .select(
            "hour_start",
            F.col("n").alias("total_txns"),
            F.col("f").alias("failed_txns"),
            F.sum("n").over(trailing).alias("rolling_txns"),
            F.sum("f").over(trailing).alias("rolling_failures"),
        )
        .withColumn("rolling_failure_rate", percent("rolling_failures", "rolling_txns"))
        .orderBy("hour_start")
    )
