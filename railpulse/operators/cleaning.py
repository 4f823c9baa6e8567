"""Cleaning of raw payment attempts.

Both cleaners keep one row per transaction id. The planner turns "first row of a
group" into a group limit that runs before and after the shuffle, so an id with
very many copies leaves each map task as a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railpulse import dimensions as D
from railpulse.functions.text import looked_up, stripped
from railpulse.operators.quality import parsed_amount, valid_amount
from railpulse.schemas import TRANSACTION_COLUMNS


def _known_network() -> Column:
    return F.coalesce(F.nullif("network_type", F.lit("")), F.lit(D.DEFAULT_NETWORK))


def _first_per_id(rows: DataFrame, *order: Column | str) -> DataFrame:
    by_id = Window.partitionBy("transaction_id").orderBy(*order)
    return (
        rows.withColumn("_place", F.row_number().over(by_id))
        .filter(F.col("_place") == 1)
        .select(*TRANSACTION_COLUMNS)
    )


def clean_view(raw: DataFrame, alias_map: dict[str, str] = D.BANK_ALIASES) -> DataFrame:
    """One valid row per transaction id, the earliest by timestamp.

    Rows of equal timestamp are told apart by all other output columns, so the
    result does not depend on the order of the input. A bank that is no alias
    stays as it is, surrounding spaces included.
    """
    bank = F.col("payer_bank_id")
    rows = raw.filter(valid_amount()).withColumns(
        {
            "amount": parsed_amount(),
            "payer_bank_id": F.coalesce(looked_up(F.upper(F.trim(bank)), alias_map), bank),
            "network_type": _known_network(),
        }
    )
    rest = [c for c in TRANSACTION_COLUMNS if c not in ("transaction_id", "timestamp")]
    return _first_per_id(rows, "timestamp", *rest)


def clean_transactions(
    raw: DataFrame, seq_col: str = "ingest_seq", alias_map: dict[str, str] = D.BANK_ALIASES
) -> DataFrame:
    """One valid row per transaction id, the first by ingest order.

    A distributed scan has no file order, so the order comes from ``seq_col``,
    which is unique within an id. Banks are stripped of white space in any case.
    """
    bank = stripped(F.col("payer_bank_id"))
    rows = raw.filter(valid_amount()).withColumns(
        {
            "amount": parsed_amount(),
            "payer_bank_id": F.coalesce(looked_up(F.upper(bank), alias_map), bank),
            "network_type": _known_network(),
        }
    )
    return _first_per_id(rows, seq_col)


def accepted_ids(raw: DataFrame) -> DataFrame:
    """The ids that cleaning keeps: those with a valid row, each once. No row needs ranking for that."""
    return raw.filter(valid_amount()).select("transaction_id").distinct()


def clean_stage_events(stages: DataFrame, clean_tx: DataFrame) -> DataFrame:
    """The stage rows whose transaction survived cleaning, repeats included.

    ``clean_tx`` are cleaned attempts or just their ids, as :func:`accepted_ids` gives
    them from raw ones."""
    return stages.join(clean_tx.select("transaction_id"), "transaction_id", "left_semi")
