"""Failure friction of users and their segments.

The attempts are first reduced to one row per user, with map-side partial sums.
Users join that reduced frame on the key it is already partitioned by, so the
attempts themselves are never joined. ``users`` holds each user id once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.functions import flags
from railpulse.functions.numbers import money, percent, rounded_ratio


def user_totals(tx: DataFrame) -> DataFrame:
    """One row per user with counts and failed value.

    Every report below takes the attempts or these totals; totals written once
    serve them all. Columns a report does not use are pruned away.
    """
    if "user_txns" in tx.columns:
        return tx
    return tx.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("user_txns"),
        flags.count_where(flags.succeeded()).alias("ok"),
        flags.count_where(flags.failed()).alias("bad"),
        flags.count_where(flags.technical_by_code()).alias("td"),
        flags.sum_where(flags.failed()).alias("failed_value"),
    )


def _segments(users: DataFrame, tx: DataFrame, segment: Column | str, severe: int) -> DataFrame:
    return (
        user_totals(tx)
        .join(users, "user_id")
        .groupBy(segment)
        .agg(
            F.count(F.lit(1)).alias("users"),
            F.sum("user_txns").alias("txns"),
            F.sum("ok").alias("ok"),
            F.sum("bad").alias("bad"),
            flags.count_where(F.col("bad") >= severe).alias("severe"),
        )
    )


def segment_friction(users: DataFrame, tx: DataFrame, severe: int = 3) -> DataFrame:
    """Per user segment: active users, volumes, success rate, failures per user
    and users with at least ``severe`` failures."""
    t = _segments(users, tx, "user_segment", severe)
    return t.select(
        "user_segment",
        F.col("users").alias("total_users_in_segment"),
        F.col("txns").alias("segment_txn_volume"),
        F.col("bad").alias("segment_failed_volume"),
        percent("ok", "txns").alias("segment_psr"),
        rounded_ratio("bad", "users").alias("avg_failures_per_user"),
        F.col("severe").alias("users_with_3plus_failures"),
        percent("severe", "users").alias("pct_users_severely_impacted"),
    ).orderBy(F.desc("segment_txn_volume"), "user_segment")


def severe_impact(users: DataFrame, tx: DataFrame, severe: int = 3) -> DataFrame:
    """Share of active users with at least ``severe`` failures, per segment."""
    t = _segments(users, tx, "user_segment", severe)
    return t.select(
        "user_segment", percent("severe", "users").alias("pct_severely_impacted")
    ).orderBy(F.desc("pct_severely_impacted"), "user_segment")


def age_group_friction(users: DataFrame, tx: DataFrame, severe: int = 3) -> DataFrame:
    """The same friction figures per age group."""
    t = _segments(users, tx, "age_group", severe)
    return t.select(
        "age_group",
        F.col("users").alias("active_users"),
        F.col("txns").alias("txn_volume"),
        F.col("bad").alias("failed_volume"),
        percent("ok", "txns").alias("psr_percentage"),
        percent("severe", "users").alias("pct_severely_impacted"),
    )


def tenure_friction(users: DataFrame, tx: DataFrame, severe: int = 3, band_days: int = 365) -> DataFrame:
    """The same friction figures per tenure band of ``band_days`` days."""
    band = F.floor(F.col("tenure_days") / F.lit(band_days)).cast("int").alias("tenure_band")
    t = _segments(users, tx, band, severe)
    return t.select(
        "tenure_band",
        F.col("users").alias("active_users"),
        F.col("txns").alias("txn_volume"),
        F.col("bad").alias("failed_volume"),
        percent("ok", "txns").alias("psr_percentage"),
        percent("severe", "users").alias("pct_severely_impacted"),
    )


def impacted_power_users(
    tx: DataFrame, users: DataFrame, min_txn: int = 10, min_fail: int = 3, k: int = 20
) -> DataFrame:
    """The ``k`` users with most failures among users of at least ``min_txn``
    attempts and ``min_fail`` failures; the user id settles ties.

    Users are filtered by their counts before the join.
    """
    heavy = user_totals(tx).filter((F.col("user_txns") >= min_txn) & (F.col("bad") >= min_fail))
    return (
        heavy.join(users, "user_id")
        .select(
            "user_id",
            "user_segment",
            "state",
            F.col("user_txns").alias("total_attempts"),
            F.col("bad").alias("failed_attempts"),
            F.col("td").alias("technical_declines"),
            percent("ok", "user_txns").alias("user_psr"),
            money("failed_value").alias("user_failed_value_inr"),
        )
        .orderBy(F.desc("failed_attempts"), "user_id")
        .limit(k)
    )
