"""Abandonment after a failed attempt, by the Kaplan-Meier estimate.

Whoever makes another attempt after a failure has come back; whoever has not, may yet.
Failures shortly before the end of the data have been watched for a short time only.
Counting them as lost makes the last day look bad, leaving them out makes it look good;
the estimate uses each failure for as long as it was watched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railpulse import dimensions as D
from railpulse.functions import flags
from railpulse.functions.numbers import percent, rounded
from railpulse.operators.experiment import CONTROL, SALT, TREATMENT, variant_of
from railpulse.operators.neighbours import HOT_ROWS
from railpulse.operators.retries import attempt_chain

HORIZON_S, GRID_S = 86_400, 60
MICROS = 1_000_000


def failure_steps(
    tx: DataFrame,
    *keys: Column | str,
    horizon_s: int = HORIZON_S,
    grid_s: int = GRID_S,
    hot_rows: int = HOT_ROWS,
    watched: DataFrame | None = None,
) -> DataFrame:
    """Failures per group and step of ``grid_s`` seconds: (keys, step, returned, censored).

    A failure is counted at the step in which the user's next attempt falls, or, if none
    came within ``horizon_s``, at the last whole step for which it was watched. The data
    end with the latest attempt of ``watched``, by default ``tx``; a chain of failures alone
    needs it. At most a row per step and group, from partial sums.
    ``tx`` are attempts or their chain; those without a user or a time are left out.
    """
    grid, last = grid_s * MICROS, -(-horizon_s // grid_s)
    end = (tx if watched is None else watched).agg(F.max("timestamp").alias("end")).scalar()
    failures = attempt_chain(tx, hot_rows).filter(flags.failed() & F.col("user_id").isNotNull() & F.col("timestamp").isNotNull())
    watched = flags.micros_between(F.col("timestamp"), end)
    back = F.expr(f"(gap_micros + {grid - 1}) div {grid}")
    rows = failures.withColumn("_watched", watched).withColumn("_back", F.when(back <= last, back))
    seen = F.least(F.expr(f"_watched div {grid}"), F.lit(last).cast("long"))
    steps = rows.groupBy(*keys, F.coalesce("_back", seen).alias("step"))
    return steps.agg(
        F.count("_back").alias("returned"), flags.count_where(F.col("_back").isNull()).alias("censored")
    )


def return_curve(steps: DataFrame, keys: list[str], grid_s: int = GRID_S) -> DataFrame:
    """The share of failures not yet returned from, after each step in which someone did.

    Of those at risk at a step (not back and still watched), some return; the shares that
    stay multiply. The windows see a row per step of a group.
    """
    down = Window.partitionBy(*keys).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    at_risk = steps.withColumn("at_risk", F.sum(F.col("returned") + F.col("censored")).over(down))
    stay = F.expr("1D - cast(returned as double) / at_risk")
    # Logarithms of shares; nobody is left where all that are at risk return.
    left = at_risk.withColumns({"_log": F.when(stay > 0, F.log(stay)), "_gone": stay == 0})
    left = left.withColumn("_spread", F.expr("if(returned < at_risk, returned / (cast(at_risk as double) * (at_risk - returned)), 0D)"))
    over = {"_log": F.sum("_log").over(up), "_gone": F.max("_gone").over(up), "_spread": F.sum("_spread").over(up)}
    left = left.withColumns(over)
    staying = F.when(F.col("_gone"), 0.0).otherwise(F.exp(F.coalesce("_log", F.lit(0.0))))
    return left.withColumn("away", staying).select(
        *keys,
        "step",
        (F.col("step") * grid_s).alias("seconds"),
        "at_risk",
        "returned",
        "censored",
        "away",
        (F.col("away") * F.sqrt("_spread")).alias("standard_error"),
    )


def abandonment(
    tx: DataFrame,
    keys: dict[str, Column],
    horizon_s: int = HORIZON_S,
    grid_s: int = GRID_S,
    hot_rows: int = HOT_ROWS,
    watched: DataFrame | None = None,
) -> DataFrame:
    """Per group: failures, those followed by another attempt of the user within
    ``horizon_s``, those not watched that long, the estimated share that never comes back
    within it, its standard error, the median time to the next attempt (NULL if fewer than
    half come back), and the plain share that counts the unwatched as lost."""
    names = list(keys)
    by = [c.alias(n) for n, c in keys.items()]
    steps = failure_steps(tx, *by, horizon_s=horizon_s, grid_s=grid_s, hot_rows=hot_rows, watched=watched)
    curve = return_curve(steps, names, grid_s)
    last = -(-horizon_s // grid_s)
    rows = curve.groupBy(*names).agg(
        F.sum(F.expr("returned + censored")).alias("failures"),
        F.sum("returned").alias("returned"),
        F.sum(F.expr(f"if(step < {last}, censored, 0L)")).alias("watched_less"),
        F.max_by("away", "step").alias("away"),
        F.max_by("standard_error", "step").alias("error"),
        F.min(F.when(F.col("away") <= 0.5, F.col("seconds"))).alias("median_return_seconds"),
    )
    return rows.select(
        *names,
        "failures",
        "returned",
        "watched_less",
        rounded("100D * away", 4).alias("abandonment_pct"),
        rounded("100D * error", 4).alias("standard_error_points"),
        F.col("median_return_seconds").cast("double").alias("median_return_seconds"),
        percent("failures - returned", "failures", 4).alias("unadjusted_pct"),
    )


def abandonment_by_code(
    tx: DataFrame, horizon_s: int = HORIZON_S, grid_s: int = GRID_S, hot_rows: int = HOT_ROWS, watched: DataFrame | None = None
) -> DataFrame:
    """Abandonment after each failure code."""
    return abandonment(tx, {"failure_code": F.col("failure_code")}, horizon_s, grid_s, hot_rows, watched)


def abandonment_by_variant(
    tx: DataFrame,
    horizon_s: int = HORIZON_S,
    grid_s: int = GRID_S,
    salt: str = SALT,
    treated_pct: int = 50,
    hot_rows: int = HOT_ROWS,
    watched: DataFrame | None = None,
) -> DataFrame:
    """Abandonment in both variants of the experiment."""
    variant = variant_of(F.col("user_id"), salt, treated_pct)
    return abandonment(tx, {"variant": variant}, horizon_s, grid_s, hot_rows, watched)


def dropoff_increase(by_variant: DataFrame) -> DataFrame:
    """One row: by how many points the treatment's abandonment exceeds the control's,
    ``dropoff_increase``; NULL if a variant has no failures."""

    def of(variant: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col("abandonment_pct")))

    rows = by_variant.agg(of(CONTROL).alias("control"), of(TREATMENT).alias("treatment"))
    return rows.select(rounded("treatment - control", 4).alias("dropoff_increase"))


def rollback_metrics(duplicate_rate: DataFrame, by_variant: DataFrame) -> DataFrame:
    """The metrics of the rollback triggers as one row, for :func:`railpulse.operators.kpis.limit_breaches`
    with :data:`railpulse.dimensions.ROLLBACK_LIMITS`."""
    return dropoff_increase(by_variant).withColumn(D.DUPLICATE_RATE, duplicate_rate.select(D.DUPLICATE_RATE).scalar())
