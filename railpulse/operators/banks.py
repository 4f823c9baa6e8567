"""Reliability of payer banks, payee banks and their pairs.

Every report aggregates by bank id first; bank names join the reduced frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railpulse import dimensions as D
from railpulse.functions import flags
from railpulse.functions.numbers import exact_percent, money, percent
from railpulse.operators.tallies import outcome_cells, tally, with_codes


def _payer_cells(tx: DataFrame, banks: DataFrame, error_codes: DataFrame, *keys) -> DataFrame:
    cells = outcome_cells(tx, "payer_bank_id", *keys)
    named = cells.join(banks, F.col("payer_bank_id") == F.col("bank_id"))
    return with_codes(named, error_codes)


def payer_bank_ranking(
    tx: DataFrame, banks: DataFrame, error_codes: DataFrame, min_volume: int = 100
) -> DataFrame:
    """Payer banks of at least ``min_volume`` attempts, least reliable first.

    The rank follows the unrounded success rate. Its window sees one row per
    bank, after the volume filter.
    """
    t = tally(_payer_cells(tx, banks, error_codes), "bank_name", "bank_type", codes=True)
    total = F.col("total")
    kept = t.filter(total >= min_volume)
    return kept.select(
        F.col("bank_name").alias("payer_bank_name"),
        "bank_type",
        total.alias("total_volume"),
        F.col("success").alias("success_volume"),
        F.col("failed").alias("failure_volume"),
        percent("success", "total").alias("bank_psr"),
        percent("td_wide", "total").alias("technical_decline_rate"),
        percent("bd_wide", "total").alias("business_decline_rate"),
        F.rank().over(Window.orderBy(exact_percent("success", "total"))).alias("reliability_rank_asc"),
    ).orderBy("bank_psr", "payer_bank_name")


def bank_psr_td(tx: DataFrame, banks: DataFrame, error_codes: DataFrame) -> DataFrame:
    """Success and wide technical decline rate of every payer bank."""
    t = tally(_payer_cells(tx, banks, error_codes), "bank_name", codes=True)
    return t.select(
        "bank_name",
        percent("success", "total").alias("psr"),
        percent("td_wide", "total").alias("td_rate"),
    ).orderBy("psr", "bank_name")


def _pair_tally(tx: DataFrame, banks: DataFrame) -> DataFrame:
    pairs = outcome_cells(tx, "payer_bank_id", "payee_bank_id")
    payer = banks.select(F.col("bank_id").alias("payer_bank_id"), F.col("bank_name").alias("payer_bank"))
    payee = banks.select(F.col("bank_id").alias("payee_bank_id"), F.col("bank_name").alias("payee_bank"))
    named = pairs.join(payer, "payer_bank_id").join(payee, "payee_bank_id")
    return tally(named, "payer_bank", "payee_bank")


def bank_pair_matrix(tx: DataFrame, banks: DataFrame, min_volume: int = 200, k: int = 15) -> DataFrame:
    """The ``k`` pairs with the highest rounded failure rate among pairs of at
    least ``min_volume`` attempts; names settle ties."""
    rows = (
        _pair_tally(tx, banks)
        .filter(F.col("total") >= min_volume)
        .select(
            "payer_bank",
            "payee_bank",
            F.col("total").alias("pair_volume"),
            F.col("failed").alias("pair_failures"),
            percent("failed", "total").alias("pair_failure_rate"),
            money("failed_value").alias("pair_value_at_risk"),
        )
    )
    return rows.orderBy(F.desc("pair_failure_rate"), "payer_bank", "payee_bank").limit(k)


def bank_pair_pivot(tx: DataFrame, banks: DataFrame, payee_names: list[str] | None = None) -> DataFrame:
    """Failure rate with payers as rows and the named payees as columns.

    The columns are the given names or else those of the banks table, which is
    small and read for them, so no job looks for names among the attempts. The
    pivot turns one row per pair.
    """
    if payee_names is None:
        payee_names = sorted(r[0] for r in banks.select("bank_name").distinct().collect() if r[0] is not None)
    rate = percent("sum(failed)", "sum(total)", 1)
    return (
        _pair_tally(tx, banks)
        .groupBy("payer_bank")
        .pivot("payee_bank", payee_names)
        .agg(rate)
        .orderBy("payer_bank")
    )


def bank_type_peak(tx: DataFrame, banks: DataFrame, error_codes: DataFrame) -> DataFrame:
    """Volume, success and wide technical decline rate per bank type, inside and
    outside the evening peak."""
    peak = flags.in_peak(F.hour("timestamp")).alias("is_peak")
    t = tally(_payer_cells(tx, banks, error_codes, peak), "bank_type", "is_peak", codes=True)
    return t.select(
        "bank_type",
        "is_peak",
        F.col("total").alias("total_volume"),
        percent("success", "total").alias("psr_percentage"),
        percent("td_wide", "total").alias("technical_decline_rate"),
    )


def decline_by_bank_role(tx: DataFrame, banks: DataFrame, error_codes: DataFrame) -> DataFrame:
    """Declines seen from either side of the payment: one row per role and bank,
    with the bank's share of all technical declines of that role."""
    cells = with_codes(outcome_cells(tx, "payer_bank_id", "payee_bank_id"), error_codes)
    pairs = cells.groupBy("payer_bank_id", "payee_bank_id").agg(
        F.sum("cell_txns").alias("txns"),
        F.sum(F.when(flags.technical_by_type(), F.col("cell_txns")).otherwise(0)).alias("td"),
        F.sum(F.when(flags.business_by_type(), F.col("cell_txns")).otherwise(0)).alias("bd"),
    )
    roles = F.array(
        F.struct(F.lit("payer").alias("bank_role"), F.col("payer_bank_id").alias("role_bank_id")),
        F.struct(F.lit("payee").alias("bank_role"), F.col("payee_bank_id").alias("role_bank_id")),
    )
    sides = pairs.select(F.inline(roles), "txns", "td", "bd")
    named = sides.join(banks, F.col("role_bank_id") == F.col("bank_id"))
    t = named.groupBy("bank_role", "bank_name").agg(
        F.sum("txns").alias("total_volume"),
        F.sum("td").alias("technical_declines"),
        F.sum("bd").alias("business_declines"),
    )
    return t.select(
        "*",
        percent("technical_declines", "total_volume").alias("technical_decline_rate"),
        percent("technical_declines", "sum(technical_declines) over (partition by bank_role)").alias("td_share_of_role"),
    )
