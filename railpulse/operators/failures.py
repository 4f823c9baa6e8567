"""Failures by reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railpulse.functions import flags
from railpulse.functions.numbers import percent, rounded_ratio
from railpulse.operators.tallies import outcome_cells, with_codes


def _failure_cells(tx: DataFrame, error_codes: DataFrame) -> DataFrame:
    return with_codes(outcome_cells(tx.filter(flags.failed())), error_codes)


def failure_breakdown(tx: DataFrame, error_codes: DataFrame) -> DataFrame:
    """Failures per decline type, category, code and description.

    Codes missing from ``error_codes`` stay visible under their own code.
    """
    groups = (
        _failure_cells(tx, error_codes)
        .groupBy(
            F.coalesce("technical_or_business_decline", F.lit("Other")).alias("decline_type"),
            F.coalesce("error_category", F.lit("Unknown")).alias("error_category"),
            "failure_code",
            F.coalesce("error_description", F.lit("Unclassified Error")).alias("error_description"),
        )
        .agg(
            F.sum("cell_txns").alias("failure_count"),
            F.sum("cell_amounts").alias("failed_amounts"),
            F.sum("cell_value").alias("failed_value"),
        )
        # Always true. Both uses of the groups below thereby need the same columns,
        # and the planner computes the groups once and reuses their exchange.
        .filter((F.col("failure_count") > 0) | F.col("failed_value").isNotNull() | (F.col("failed_amounts") > 0))
    )
    # Ranks depend on the count alone. Distinct counts are few even when there
    # are many unknown codes: k of them need at least k*(k+1)/2 failures.
    counts = groups.groupBy("failure_count").agg(F.count(F.lit(1)).alias("tied_groups"))
    ranks = counts.select(
        F.col("failure_count").alias("ranked_count"),
        F.dense_rank().over(Window.orderBy(F.col("failure_count").desc())).alias("failure_rank"),
        F.sum(F.col("failure_count") * F.col("tied_groups")).over(Window.partitionBy()).alias("all_failures"),
    )
    return (
        groups.join(ranks, F.col("failure_count") == F.col("ranked_count"))
        .select(
            "decline_type",
            "error_category",
            "failure_code",
            "error_description",
            "failure_count",
            percent("failure_count", "all_failures").alias("pct_contribution_to_failures"),
            F.col("failed_value").cast("double").alias("total_failed_value_inr"),
            rounded_ratio("failed_value", "failed_amounts").alias("avg_failed_amount_inr"),
            F.col("failure_rank").cast("int"),
        )
        .orderBy(F.desc("failure_count"), "failure_code")
    )


def failure_reasons(tx: DataFrame, error_codes: DataFrame) -> DataFrame:
    """Failures per category and description; unknown codes describe themselves."""
    return (
        _failure_cells(tx, error_codes)
        .groupBy(
            F.coalesce("error_category", F.lit("Unknown")).alias("category"),
            F.coalesce("error_description", "failure_code").alias("description"),
        )
        .agg(F.sum("cell_txns").alias("count"))
        .orderBy(F.desc("count"), "description")
    )


def failure_rollup(tx: DataFrame, error_codes: DataFrame) -> DataFrame:
    """Failures with subtotals: per type, category and code, per type and
    category, per type, and over all. ``grouping_level`` tells the rows apart."""
    cells = _failure_cells(tx, error_codes).select(
        F.coalesce("technical_or_business_decline", F.lit("Other")).alias("decline_type"),
        F.coalesce("error_category", F.lit("Unknown")).alias("error_category"),
        "failure_code",
        "cell_txns",
        "cell_value",
    )
    return cells.rollup("decline_type", "error_category", "failure_code").agg(
        F.grouping_id().cast("int").alias("grouping_level"),
        F.sum("cell_txns").alias("failure_count"),
        F.sum("cell_value").cast("double").alias("failed_value_inr"),
    )
