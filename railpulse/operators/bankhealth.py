"""Rolling success rate of payer banks with an alert, for batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.functions import flags
from railpulse.functions.numbers import exact_percent, percent, rounded

ALERT_BELOW = 88.0
# An incident goes on until the rate is back at this.
RELEASE_AT = 90.0


UNITS = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400}


def _seconds(duration: str) -> int:
    """Length of a duration such as '5 minutes'."""
    number, unit = duration.split()
    return int(number) * UNITS[unit.lower().rstrip("s")]


def _rolling(tx: DataFrame, window: str, slide: str, watermark: str | None) -> DataFrame:
    """Attempts and successes per payer bank and sliding window ``w``."""
    rows = tx.select(F.col("timestamp").cast("timestamp").alias("event_time"), "payer_bank_id", "final_status")
    rows = rows.withColumns({"n": F.lit(1), "good": F.when(flags.succeeded(), 1).otherwise(0)})
    if watermark is None and _seconds(window) % _seconds(slide):
        raise ValueError(f"slide {slide!r} does not divide window {window!r}")
    if watermark is not None:
        rows = rows.withWatermark("event_time", watermark)
    else:
        steps = rows.groupBy(F.window("event_time", slide).alias("step"), "payer_bank_id")
        rows = steps.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn(
            "event_time", F.col("step.start")
        )
    return rows.groupBy(F.window("event_time", window, slide).alias("w"), "payer_bank_id").agg(
        F.sum("n").alias("txns"), F.sum("good").alias("ok")
    )


def rolling_bank_health(
    tx: DataFrame,
    window: str = "5 minutes",
    slide: str = "1 minute",
    alert_below: float = ALERT_BELOW,
    watermark: str | None = None,
) -> DataFrame:
    """Success rate per payer bank and sliding window, with an alert mark.

    For a stream give ``watermark``; windows are then final, and written, once
    the watermark has passed their end. A batch is first reduced to one row per
    bank and ``slide``, which must divide ``window``, and only those rows are
    spread over the windows they belong to.
    """
    return _rolling(tx, window, slide, watermark).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "payer_bank_id",
        "txns",
        F.col("ok").alias("successes"),
        percent("ok", "txns").alias("rolling_psr"),
        (exact_percent("ok", "txns") < F.lit(alert_below)).alias("alert"),
    )


def bank_incidents(
    tx: DataFrame,
    window: str = "5 minutes",
    slide: str = "1 minute",
    alert_below: float = ALERT_BELOW,
    release_at: float = RELEASE_AT,
    quiet: str = "2 minutes",
    watermark: str | None = None,
) -> DataFrame:
    """One row per incident of a bank, in place of an alert for each of its windows.

    An incident begins with the first window under ``release_at`` of a run that falls
    under ``alert_below``, and goes on while windows stay under ``release_at``, so that a
    rate that swings about the alert bound is one incident. Windows end up in different
    incidents if the ends of neighbours are more than ``quiet`` apart; a window without
    attempts says nothing. ``worst_psr`` is the lowest rate, ``alert_windows`` the number
    of windows under ``alert_below``, ``txns`` the most attempts in one window.

    On a stream, with ``watermark``, sessions are built over closed windows, two stateful
    steps in one query; an incident is final once the watermark has passed its end by
    ``quiet``. A batch gives the same rows, open incidents included.
    """
    low = _rolling(tx, window, slide, watermark).withColumn("psr", exact_percent("ok", "txns"))
    low = low.select("payer_bank_id", F.window_time("w").alias("at"), "w", "txns", "psr").filter(F.col("psr") < release_at)
    runs = low.groupBy(F.session_window("at", quiet), "payer_bank_id").agg(
        F.min("w.start").alias("start"),
        F.max("w.end").alias("end"),
        F.count(F.lit(1)).alias("windows"),
        flags.count_where(F.col("psr") < alert_below).alias("alert_windows"),
        F.max("txns").alias("txns"),
        F.min("psr").alias("worst"),
    )
    return runs.filter(F.col("alert_windows") > 0).select(
        "payer_bank_id",
        F.col("start").cast("timestamp_ntz").alias("started"),
        F.col("end").cast("timestamp_ntz").alias("ended"),
        "windows",
        "alert_windows",
        "txns",
        rounded("worst").alias("worst_psr"),
    )
