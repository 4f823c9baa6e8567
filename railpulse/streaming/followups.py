"""Attempts that follow a network timeout, on a stream: an interval join of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.functions import flags


def timeout_follow_ups(
    tx: DataFrame,
    window_s: int = 180,
    code: str = "ERR_NET_01",
    watermark: str = "10 minutes",
    period: str = "1 hour",
) -> DataFrame:
    """Every failure with the given code, how many attempts the same user makes within
    ``window_s`` after it, and the seconds to the first (NULL without any).

    Failures and attempts are two streams joined on user and time. A failure is held
    until the watermark has passed its window; then it comes out, followed or not, with
    the other failures of its ``period``. Attempts of the failure's very time count if
    their id is larger. The join key holds the time in slices of ``window_s``, in two of
    which a failure looks, so that the attempts of a busy user are spread over tasks and
    met by near failures only. Attempts without a user or a time are left out, those
    later than the watermark allows are dropped. The frame of a batch gives the same rows,
    all of them.
    """
    rows = tx.filter(F.col("user_id").isNotNull() & F.col("timestamp").isNotNull())
    rows = rows.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", watermark)
    slot = F.floor(F.unix_micros("event_time") / F.lit(window_s * 1_000_000))
    # All attempts move both watermarks: a condition on the time as well is not moved
    # below them by the planner, so a pause of failures holds nothing back.
    is_failure = F.when(F.col("event_time").isNull(), F.lit(False)).otherwise(flags.failed() & (F.col("failure_code") == code))
    failures = rows.filter(is_failure).select(
        F.col("user_id").alias("failed_user"),
        F.col("transaction_id").alias("failure"),
        F.col("event_time").alias("failed_at"),
        F.explode(F.array(slot, slot + 1)).alias("failed_slot"),
    )
    attempts = rows.select("user_id", "transaction_id", F.col("event_time").alias("attempted_at"), slot.alias("slot"))
    follows = (
        (F.col("failed_user") == F.col("user_id"))
        & (F.col("failed_slot") == F.col("slot"))
        & (F.col("attempted_at") >= F.col("failed_at"))
        & (F.col("attempted_at") <= F.col("failed_at") + F.expr(f"interval {int(window_s)} seconds"))
        & ((F.col("attempted_at") > F.col("failed_at")) | (F.col("transaction_id") > F.col("failure")))
    )
    joined = failures.join(attempts, follows, "left_outer")
    found = joined.groupBy(F.window("failed_at", period), "failed_user", "failure").agg(
        F.min("failed_at").alias("failed_at"),
        F.count("transaction_id").alias("following_attempts"),
        F.min("attempted_at").alias("first"),
    )
    gap = flags.micros_between(F.col("failed_at"), F.col("first")).cast("double") / F.lit(1e6)
    return found.select(
        F.col("failure").alias("transaction_id"),
        F.col("failed_user").alias("user_id"),
        F.col("failed_at").cast("timestamp_ntz").alias("failed_at"),
        "following_attempts",
        gap.alias("first_gap_seconds"),
    )
