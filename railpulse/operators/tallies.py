"""Counting shared by the reports.

A report that needs dimensions first reduces the fact table to one row per
combination of its keys, failure code and status, with map-side partial sums.
Dimensions are joined to that reduced frame, never to the attempts: the code of a
success, which most attempts carry, is one row there and not a hot join key. A
report without dimensions is one aggregate over the attempts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.functions import flags


def hourly_cells(tx: DataFrame) -> DataFrame:
    """The attempts rolled up by clock hour, banks, type, amount bucket, code and
    status. Its size depends on the period and the dimensions, not on the number
    of attempts. Write it once and give it to the reports in place of the
    attempts: they then share a single pass over the fact table.
    """
    return tx.groupBy(
        F.date_trunc("HOUR", "timestamp").cast("timestamp_ntz").alias("timestamp"),
        "payer_bank_id",
        "payee_bank_id",
        "transaction_type",
        flags.amount_bucket(F.col("amount")).alias("amount_bucket"),
        "failure_code",
        "final_status",
    ).agg(
        F.count(F.lit(1)).alias("cell_txns"),
        F.count("amount").alias("cell_amounts"),
        F.sum("amount").alias("cell_value"),
    )


def is_rolled_up(tx: DataFrame) -> bool:
    return "cell_txns" in tx.columns


def weighted(tx: DataFrame) -> DataFrame:
    """Attempts as cells of one attempt each; hourly cells as they are."""
    if is_rolled_up(tx):
        return tx
    known = F.col("amount").isNotNull().cast("int")
    return tx.withColumns({"cell_txns": F.lit(1), "cell_amounts": known, "cell_value": F.col("amount")})


def outcome_cells(tx: DataFrame, *keys: Column | str) -> DataFrame:
    """Attempts and value per key combination, failure code and status, from the
    attempts or from their hourly cells. What dimensions are then joined to."""
    return (
        weighted(tx)
        .groupBy(*keys, "failure_code", "final_status")
        .agg(*[F.sum(c).alias(c) for c in ("cell_txns", "cell_amounts", "cell_value")])
    )


def with_codes(cells: DataFrame, error_codes: DataFrame, how: str = "left") -> DataFrame:
    return cells.join(error_codes, F.col("failure_code") == F.col("error_code"), how)


def txns_where(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("cell_txns")).otherwise(F.lit(0)))


def value_where(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("cell_value")).otherwise(F.lit(0)))


def base_tally() -> list[Column]:
    """Counts and values that need no dimension."""
    return [
        F.sum("cell_txns").alias("total"),
        txns_where(flags.succeeded()).alias("success"),
        txns_where(flags.failed()).alias("failed"),
        txns_where(flags.technical_by_code()).alias("td_narrow"),
        txns_where(flags.business_by_code()).alias("bd_narrow"),
        F.sum("cell_amounts").alias("amounts"),
        F.sum("cell_value").alias("value"),
        value_where(flags.succeeded()).alias("success_value"),
        value_where(flags.failed()).alias("failed_value"),
    ]


def code_tally() -> list[Column]:
    """Counts that need the error-code dimension."""
    return [
        txns_where(flags.technical_by_type()).alias("td_wide"),
        txns_where(flags.business_by_type()).alias("bd_wide"),
        txns_where(flags.timed_out()).alias("timeout"),
    ]


def tally(cells: DataFrame, *keys: Column | str, codes: bool = False) -> DataFrame:
    """Cells of any kind summed up per key; ``codes`` when they carry error codes."""
    columns = base_tally() + (code_tally() if codes else [])
    return cells.groupBy(*keys).agg(*columns)
