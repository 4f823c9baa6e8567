"""Duplicate attempts: same user, payee and amount within a short time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.functions import flags
from railpulse.functions.numbers import percent
from railpulse.operators.neighbours import HOT_ROWS, with_previous

LOCK_KEY = ["user_id", "payee_bank_id", "amount"]


def duplicate_attempts(
    tx: DataFrame, window_s: float = 180, keys: list[str] = LOCK_KEY, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Attempts made within ``window_s`` of the previous one of the same key,
    with that attempt's id and the gap in seconds."""
    rows = tx.select(*dict.fromkeys([*keys, "transaction_id", "timestamp", "final_status"]))
    chain = with_previous(rows, keys, "timestamp", "transaction_id", ["transaction_id", "timestamp"], hot_rows)
    gap = flags.micros_between(F.col("previous_timestamp"), F.col("timestamp"))
    return (
        chain.withColumn("gap_micros", gap)
        .filter(F.col("gap_micros") <= F.lit(int(window_s * 1_000_000)))
        .select(
            *keys,
            "transaction_id",
            "timestamp",
            "final_status",
            "previous_transaction_id",
            (F.col("gap_micros").cast("double") / F.lit(1e6)).alias("gap_seconds"),
        )
    )


def completed_chain(tx: DataFrame, keys: list[str] = LOCK_KEY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The completed payments with the gap in microseconds since the previous one of the same key."""
    rows = tx.filter(flags.succeeded()).select(*dict.fromkeys([*keys, "transaction_id", "timestamp"]))
    chain = with_previous(rows, keys, "timestamp", "transaction_id", ["timestamp"], hot_rows)
    return chain.withColumn("gap_micros", flags.micros_between(F.col("previous_timestamp"), F.col("timestamp")))


def repeats_completed(window_s: float = 180) -> Column:
    """How many rows of :func:`completed_chain` repeat an earlier payment."""
    return flags.count_where(F.col("gap_micros") <= F.lit(int(window_s * 1_000_000)))


def duplicate_payment_rate(
    tx: DataFrame, window_s: float = 180, keys: list[str] = LOCK_KEY, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row: completed payments, those that repeat an earlier completed one,
    and their share."""
    t = completed_chain(tx, keys, hot_rows).agg(
        F.count(F.lit(1)).alias("completed_payments"), repeats_completed(window_s).alias("duplicate_payments")
    )
    return t.withColumn(
        "duplicate_payment_rate", percent("duplicate_payments", "completed_payments")
    )


def lock_windows(
    tx: DataFrame,
    window: str = "180 seconds",
    keys: list[str] = LOCK_KEY,
    watermark: str | None = None,
) -> DataFrame:
    """Duplicates under a lock key that includes the time window itself.

    Attempts of one key in the same window share a lock: the first is accepted,
    the others are locked. A plain aggregate with map-side partial sums, so no
    key is too hot. One row per lock with locked attempts. With ``watermark`` it
    runs on streams and reports a lock once the watermark has passed it.
    """
    rows = tx.select(*keys, F.col("timestamp").cast("timestamp").alias("event_time"))
    if watermark is not None:
        rows = rows.withWatermark("event_time", watermark)
    locks = rows.groupBy(F.window("event_time", window).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("attempts"), F.min("event_time").alias("first")
    )
    return locks.filter(F.col("attempts") > 1).select(
        *keys,
        F.col("w.start").cast("timestamp_ntz").alias("lock_start"),
        F.col("first").cast("timestamp_ntz").alias("accepted_at"),
        "attempts",
        (F.col("attempts") - 1).alias("locked_attempts"),
    )
