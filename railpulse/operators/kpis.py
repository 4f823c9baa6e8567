"""System-wide indicators, recoverable value and limit checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse import dimensions as D
from railpulse.functions import flags
from railpulse.functions.numbers import money, percent, rounded, rounded_ratio
from railpulse.operators.tallies import outcome_cells, tally, value_where, weighted, with_codes


def core_kpis(tx: DataFrame, error_codes: DataFrame) -> DataFrame:
    """One row of counts, rates and values.

    The technical rate is the wide one, so timeouts are a part of it.
    """
    t = tally(with_codes(outcome_cells(tx), error_codes), codes=True)
    total = F.coalesce(F.col("total"), F.lit(0))
    return t.select(
        total.alias("total_transactions"),
        F.col("success").alias("successful_transactions"),
        F.col("failed").alias("failed_transactions"),
        percent("success", "total").alias("psr_percentage"),
        percent("failed", "total").alias("failure_rate_percentage"),
        percent("td_wide", "total").alias("technical_decline_rate"),
        percent("bd_wide", "total").alias("business_decline_rate"),
        percent("timeout", "total").alias("timeout_decline_rate"),
        money("value").alias("total_value_inr"),
        money("success_value").alias("successful_value_inr"),
        money("failed_value").alias("value_at_risk_inr"),
        percent("failed_value", "value").alias("pct_value_at_risk"),
        rounded_ratio("value", "amounts").alias("avg_txn_amount_inr"),
    )


def _recoverable(tx: DataFrame, error_codes: DataFrame) -> DataFrame:
    """One row: failed, technical and soft business value of known codes."""
    failures = with_codes(outcome_cells(tx.filter(flags.failed())), error_codes, "inner")
    return failures.agg(
        F.sum("cell_value").cast("double").alias("failed_value"),
        value_where(flags.technical_by_type() | flags.timed_out()).cast("double").alias("technical_value"),
        value_where(F.col("error_code").isin(D.SOFT_DECLINE_CODES)).cast("double").alias("soft_value"),
    )


def recovery_scenarios(
    tx: DataFrame, error_codes: DataFrame, scenarios: list[tuple[str, float, float]] = D.SCENARIOS
) -> DataFrame:
    """One row with the recovered value and its share for each scenario.

    Failures whose code is not in ``error_codes`` are left out everywhere, the
    denominator included.
    """
    columns = [
        rounded("failed_value").alias("total_transaction_value_at_risk_inr"),
        rounded("technical_value").alias("recoverable_technical_value_inr"),
        rounded("soft_value").alias("soft_business_decline_value_inr"),
    ]
    for name, technical, soft in scenarios:
        recovered = f"({technical}D * technical_value + {soft}D * soft_value)"
        columns += [
            rounded(recovered).alias(f"{name}_recovered_value_inr"),
            percent(recovered, "failed_value").alias(f"{name}_recovery_pct"),
        ]
    return _recoverable(tx, error_codes).select(*columns)


def recovery_by_scenario(
    tx: DataFrame, error_codes: DataFrame, scenarios: list[tuple[str, float, float]] = D.SCENARIOS
) -> DataFrame:
    """The same figures in long form, one row per scenario."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("scenario"), F.lit(t).alias("technical"), F.lit(s).alias("soft"))
            for name, t, s in scenarios
        ]
    )
    long = _recoverable(tx, error_codes).select("*", F.inline(rows))
    recovered = "(technical * technical_value + soft * soft_value)"
    return long.select(
        "scenario",
        rounded(recovered).alias("recovered_value_inr"),
        percent(recovered, "failed_value").alias("recovery_pct"),
    )


def status_breakdown(tx: DataFrame) -> DataFrame:
    """Attempts per status label; failures that are neither technical nor
    business by code count as network."""
    label = (
        F.when(flags.succeeded(), D.STATUS_LABELS["success"])
        .when(flags.technical_by_code(), D.STATUS_LABELS["technical"])
        .when(flags.business_by_code(), D.STATUS_LABELS["business"])
        .otherwise(D.STATUS_LABELS["network"])
    )
    return weighted(tx).groupBy(label.alias("status_category")).agg(F.sum("cell_txns").alias("count"))


def kill_switch_metrics(core: DataFrame, duplicate_rate: DataFrame) -> DataFrame:
    """The one row of :func:`core_kpis` with the duplicate payment rate, itself
    one row, as a further column: all metrics that have a limit."""
    name = "duplicate_payment_rate"
    return core.withColumn(name, duplicate_rate.select(name).scalar())


def limit_breaches(kpis: DataFrame, limits: list[tuple[str, float]] = D.KPI_LIMITS) -> DataFrame:
    """Metrics of a one-row KPI frame that exceed their limit.

    A limit that cannot be checked, because the frame lacks its metric or the
    metric is NULL, comes out with a NULL observation.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                (F.col(name) if name in kpis.columns else F.lit(None)).cast("double").alias("observed"),
                F.lit(float(limit)).alias("upper_limit"),
            )
            for name, limit in limits
        ]
    )
    return (
        kpis.select(F.inline(pairs))
        .filter(F.col("observed").isNull() | (F.col("observed") > F.col("upper_limit")))
        .select("metric", "observed", "upper_limit", rounded("observed - upper_limit").alias("excess"))
    )
