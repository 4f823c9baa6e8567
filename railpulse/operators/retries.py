"""Retries: a failed attempt and the user's next attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse import dimensions as D
from railpulse.functions import flags
from railpulse.functions.numbers import exact_percent, percent, rounded
from railpulse.operators.neighbours import HOT_ROWS, with_island, with_next

MICROS = 1_000_000


def attempt_chain(tx: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every attempt with the user's next one and the gap in microseconds.

    The reports below take the attempts or this chain; a chain written once
    serves them all.
    """
    if "gap_micros" in tx.columns:
        return tx
    chain = with_next(
        tx.select("user_id", "transaction_id", "timestamp", "amount", "final_status", "failure_code"),
        ["user_id"],
        "timestamp",
        "transaction_id",
        ["transaction_id", "timestamp", "amount", "final_status"],
        hot_rows,
    )
    gap = flags.micros_between(F.col("timestamp"), F.col("next_timestamp"))
    return chain.withColumn("gap_micros", gap)


def _within(window_s: float) -> Column:
    # Microseconds, since whole seconds would let 900.5 s pass as 900 s.
    return F.col("gap_micros") <= F.lit(int(window_s * MICROS))


def retry_attempts(
    tx: DataFrame, window_s: float = 900, tol: float | None = 0.10, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Failed attempts followed by another one of the same user within
    ``window_s`` seconds and, unless ``tol`` is None, of a similar amount."""
    retried = attempt_chain(tx, hot_rows).filter(
        flags.failed() & F.col("next_transaction_id").isNotNull() & _within(window_s)
    )
    if tol is None:
        return retried
    difference = F.abs(F.col("amount") - F.col("next_amount"))
    allowed = F.lit(str(tol)).cast("decimal(6,4)") * F.col("amount")
    return retried.filter(difference <= allowed)


def _per_code(attempts: DataFrame) -> DataFrame:
    """Retry counts per failure code, before any dimension is joined."""
    return attempts.groupBy("failure_code").agg(
        F.count(F.lit(1)).alias("retried"),
        flags.count_where(F.col("next_final_status") == D.SUCCESS).alias("ok"),
        flags.count_where(F.col("next_final_status") == D.FAILED).alias("bad"),
        F.sum(F.col("gap_micros").cast("decimal(28,0)")).alias("gap"),
    )


def retry_policy(
    tx: DataFrame,
    error_codes: DataFrame,
    window_s: float = 900,
    tol: float = 0.10,
    min_rate: float = 50,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Retry outcome and recommended policy per error code."""
    keys = ["error_category", "error_code", "error_description", "technical_or_business_decline"]
    known = _per_code(retry_attempts(tx, window_s, tol, hot_rows)).join(
        error_codes, F.col("failure_code") == F.col("error_code")
    )
    t = known.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("retried", "ok", "bad", "gap")])
    transient = F.col("error_category").isin(D.TECHNICAL, D.TIMEOUT)
    often_works = exact_percent("ok", "retried") >= F.lit(float(min_rate))
    policy = (
        F.when(transient & often_works, D.AUTO_RETRY)
        .when(F.col("error_code").isin(D.NO_RETRY_CODES), D.NO_RETRY)
        .otherwise(D.MANUAL_RETRY)
    )
    return t.select(
        *keys,
        F.col("retried").alias("total_retried_failures"),
        F.col("ok").alias("successful_retries"),
        F.col("bad").alias("failed_retries"),
        percent("ok", "retried").alias("retry_success_rate_pct"),
        rounded(f"cast(gap as double) / retried / {MICROS}D", 1).alias("avg_time_to_retry_seconds"),
        policy.alias("product_retry_policy"),
    ).orderBy(F.desc("total_retried_failures"), "error_code")


def retry_by_category(
    tx: DataFrame, error_codes: DataFrame, window_s: float = 900, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Retry outcome per error category, amounts not compared."""
    known = _per_code(retry_attempts(tx, window_s, None, hot_rows)).join(
        error_codes, F.col("failure_code") == F.col("error_code")
    )
    return (
        known.groupBy("error_category")
        .agg(F.sum("retried").alias("total_retries"), F.sum("ok").alias("ok"))
        .select(
            "error_category",
            "total_retries",
            percent("ok", "total_retries").alias("retry_success_rate"),
        )
    )


def retry_frequency(
    tx: DataFrame, window_s: float = 900, quick_s: float = 300, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per failure code: how many failures are retried within ``window_s``, and
    how many retries within ``quick_s`` succeed."""
    failures = attempt_chain(tx, hot_rows).filter(flags.failed())
    retried = F.coalesce(_within(window_s), F.lit(False))
    quick = F.coalesce(_within(quick_s), F.lit(False))
    t = failures.groupBy("failure_code").agg(
        F.count(F.lit(1)).alias("failures"),
        flags.count_where(retried).alias("retried_failures"),
        flags.count_where(quick).alias("quick_retries"),
        flags.count_where(quick & (F.col("next_final_status") == D.SUCCESS)).alias("quick_successes"),
    )
    return t.select(
        "*",
        percent("retried_failures", "failures").alias("retry_frequency_pct"),
        percent("quick_successes", "quick_retries").alias("quick_success_pct"),
    )


def attempts_after_timeout(
    tx: DataFrame, window_s: float = 180, code: str = "ERR_NET_01", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row: failures with the given network code, how many of them the user
    follows with another attempt within ``window_s``, and the share."""
    timeouts = attempt_chain(tx, hot_rows).filter(flags.failed() & (F.col("failure_code") == code))
    t = timeouts.agg(
        F.count(F.lit(1)).alias("timeout_failures"),
        flags.count_where(_within(window_s)).alias("followed_by_attempt"),
    )
    return t.withColumn(
        "followed_pct", percent("followed_by_attempt", "timeout_failures")
    )


def retry_episodes(
    tx: DataFrame, window_s: float = 900, hot_rows: int = HOT_ROWS, watched: DataFrame | None = None
) -> DataFrame:
    """One row per episode: a failure and the attempts the user makes after it, each within
    ``window_s`` seconds of the one before, up to the first that does not fail.

    ``outcome`` is RECOVERED if the last attempt succeeds, ABANDONED if it fails and no
    other follows within the window, OPEN if it fails less than a window before the end
    of the data (the latest attempt of ``watched``, by default ``tx``), and UNKNOWN for
    any other status. ``failure_code`` is that of the first failure. Attempts without a
    user or a time belong to no episode.
    """
    end = (tx if watched is None else watched).agg(F.max("timestamp")).scalar()
    known = tx.select("user_id", "transaction_id", "timestamp", "final_status", "failure_code").filter(
        F.col("user_id").isNotNull() & F.col("timestamp").isNotNull()
    )
    window = F.lit(int(window_s * MICROS))
    gap = flags.micros_between(F.col("previous_timestamp"), F.col("timestamp"))
    goes_on = F.coalesce((F.col("previous_final_status") == D.FAILED) & (gap <= window), F.lit(False))
    rows = with_island(
        known, ["user_id"], "timestamp", "transaction_id", ["timestamp", "final_status"], ~goes_on, hot_rows
    )
    seen = F.struct("timestamp", "transaction_id", "final_status", "failure_code")
    episodes = rows.groupBy("user_id", "island").agg(
        F.count(F.lit(1)).alias("attempts"), F.min(seen).alias("first"), F.max(seen).alias("last")
    )
    status = F.col("last.final_status")
    is_over = flags.micros_between(F.col("last.timestamp"), end) >= window
    outcome = (
        F.when(status == D.SUCCESS, "RECOVERED")
        .when((status == D.FAILED) & is_over, "ABANDONED")
        .when(status == D.FAILED, "OPEN")
        .otherwise("UNKNOWN")
    )
    return episodes.filter(F.col("first.final_status") == D.FAILED).select(
        "user_id",
        F.col("first.transaction_id").alias("first_transaction_id"),
        F.col("last.transaction_id").alias("last_transaction_id"),
        F.col("first.failure_code").alias("failure_code"),
        F.col("first.timestamp").alias("started_at"),
        "attempts",
        flags.micros_between(F.col("first.timestamp"), F.col("last.timestamp")).alias("micros"),
        outcome.alias("outcome"),
    )


def retry_episodes_by_code(
    tx: DataFrame, window_s: float = 900, hot_rows: int = HOT_ROWS, watched: DataFrame | None = None
) -> DataFrame:
    """Per code of the first failure: how episodes end, at which attempt they succeed, and
    how many attempts and seconds that takes on average. Rates are over ended episodes."""
    recovered = F.col("outcome") == "RECOVERED"
    t = retry_episodes(tx, window_s, hot_rows, watched).groupBy("failure_code").agg(
        F.count(F.lit(1)).alias("episodes"),
        flags.count_where(recovered).alias("recovered"),
        flags.count_where(recovered & (F.col("attempts") == 2)).alias("recovered_at_second"),
        flags.count_where(recovered & (F.col("attempts") > 2)).alias("recovered_later"),
        flags.count_where(F.col("outcome") == "ABANDONED").alias("abandoned"),
        flags.count_where(F.col("outcome") == "OPEN").alias("still_open"),
        F.max("attempts").alias("most_attempts"),
        F.sum(F.when(recovered, F.col("attempts"))).alias("tries"),
        F.sum(F.when(recovered, F.col("micros").cast("decimal(28,0)"))).alias("spent"),
    )
    return t.select(
        *[c for c in t.columns if c not in ("tries", "spent")],
        percent("recovered", "(recovered + abandoned)").alias("recovery_pct"),
        rounded("cast(tries as double) / nullif(recovered, 0)", 2).alias("attempts_to_success"),
        rounded(f"cast(spent as double) / nullif(recovered, 0) / {MICROS}D", 1).alias("seconds_to_success"),
    )
