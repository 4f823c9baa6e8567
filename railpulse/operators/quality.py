"""Audit of raw payment attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse import dimensions as D
from railpulse.functions import flags
from railpulse.functions.text import stripped
from railpulse.schemas import MONEY

# What an id has besides valid rows: rows of invalid amount, a row accepted before the input.
INVALID, EARLIER = 1, 2


def parsed_amount(column: str = "amount") -> Column:
    """The amount as money; NULL for text that is no finite number."""
    return F.col(column).try_cast(MONEY)


def valid_amount(column: str = "amount") -> Column:
    """True for positive finite amounts, false for all else including NULL.

    The sign is judged before rounding to money.
    """
    positive = F.col(column).try_cast("double") > 0
    return F.coalesce(positive & parsed_amount(column).isNotNull(), F.lit(False))


def dq_duplicates(raw: DataFrame) -> DataFrame:
    """How many transaction ids occur more than once."""
    repeated = raw.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return repeated.agg(F.count(F.lit(1)).alias("affected_records")).select(
        F.lit(D.DUPLICATES).alias("anomaly_type"),
        "affected_records",
        F.lit(D.DUPLICATE_ADVICE).alias("recommended_action"),
    )


def dq_bank_aliases(raw: DataFrame) -> DataFrame:
    """Payer banks that are no bank id, with the advice for each spelling.

    A NULL bank is no alias and is left out.
    """
    advice = F.lit(D.UNKNOWN_ALIAS)
    for spelling, text in D.ALIAS_ADVICE.items():
        advice = F.when(F.col("payer_bank_id") == spelling, text).otherwise(advice)
    return (
        raw.filter(~F.col("payer_bank_id").like("BNK%"))
        .groupBy("payer_bank_id")
        .agg(F.count(F.lit(1)).alias("transaction_count"))
        .withColumn("data_quality_status", advice)
    )


def dq_invalid_amounts(raw: DataFrame) -> DataFrame:
    """Count and range of the finite amounts that are zero or negative, as given:
    like :func:`valid_amount`, before any rounding to money."""
    return (
        raw.select(F.col("amount").try_cast("double").alias("amount"))
        .filter((F.col("amount") <= 0) & (F.col("amount") > float("-inf")))
        .agg(
            F.count(F.lit(1)).alias("invalid_amount_records"),
            F.min("amount").alias("min_amount_found"),
            F.max("amount").alias("max_amount_found"),
        )
        .withColumn("cleaning_rule", F.lit(D.AMOUNT_ADVICE))
    )


def dq_missing(raw: DataFrame) -> DataFrame:
    """NULL or blank values per core field; NULL counts on empty input."""
    fields = {
        "missing_users": "user_id",
        "missing_payer_banks": "payer_bank_id",
        "missing_payee_banks": "payee_bank_id",
        "missing_networks": "network_type",
        "missing_statuses": "final_status",
    }
    return raw.agg(
        *[F.sum(F.when(flags.blank(column), 1).otherwise(0)).alias(name) for name, column in fields.items()]
    )


def dq_audit_summary(
    raw: DataFrame,
    seq_col: str = "ingest_seq",
    alias_map: dict[str, str] = D.BANK_ALIASES,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """The six counters of the cleaning job, as one row.

    The first valid row of an id, by ``seq_col``, is accepted. Every later row of
    that id is a duplicate, whatever its amount; rows of invalid amount that
    come before it (or that have no valid row) are invalid. So:
    raw = duplicates + invalid + processed. All rows of the ids in ``earlier``
    (transaction_id), accepted before this input, are duplicates.

    Rows shrink to one row per id with map-side partial results. Only the rows of
    invalid amount are joined back, with the ids that have such; a hot id among
    them is split by the adaptive skew join.
    """
    spelled = F.upper(stripped(F.col("payer_bank_id"))).isin(list(alias_map))
    rows = raw.select(
        "transaction_id",
        F.col(seq_col).alias("seq"),
        valid_amount().alias("is_valid"),
        # Both marks of a row in one number, so that the aggregate below keeps
        # fixed-width state: 1 for an alias, 2 for a blank network.
        (
            F.when(spelled, 1).otherwise(0) + F.when(flags.blank("network_type"), 2).otherwise(0)
        ).alias("marks"),
    )
    kinds = F.when(F.col("is_valid"), 0).otherwise(INVALID).alias("kinds")
    seen = rows.select("transaction_id", F.when(F.col("is_valid"), F.col("seq")).alias("seq"), "marks", kinds)
    if earlier is not None:  # met in the aggregate, so that no row of the input is joined with them
        none = F.lit(None).cast(rows.schema["seq"].dataType).alias("seq")
        seen = seen.unionByName(earlier.select("transaction_id", none, F.lit(0).alias("marks"), F.lit(EARLIER).alias("kinds")))
    by_id = (
        seen.groupBy("transaction_id")
        .agg(
            F.min("seq").alias("accepted_seq"),
            F.min_by("marks", "seq").alias("marks"),
            F.count_if(F.col("kinds") == 0).alias("valid_rows"),
            F.bit_or("kinds").alias("kinds"),
        )
        # Always true. Both uses below thereby need all four columns, and the
        # planner shuffles the ids once and reuses the exchange.
        .filter((F.col("valid_rows") > 0) | (F.col("marks") > 0) | F.col("accepted_seq").isNotNull() | (F.col("kinds") > 0))
    )
    is_earlier = F.col("kinds").bitwiseAND(EARLIER) > 0
    accepted = by_id.withColumn("is_new", F.when(is_earlier | (F.col("valid_rows") == 0), 0).otherwise(1))
    # Ids without invalid rows, mostly nearly all, need not meet these.
    first = by_id.filter(F.col("kinds").bitwiseAND(INVALID) > 0).select(
        F.col("transaction_id").alias("accepted_id"), "accepted_seq", is_earlier.alias("is_earlier")
    )
    invalid = rows.filter(~F.col("is_valid")).select("transaction_id", "seq")
    before = F.col("accepted_seq").isNull() | (F.col("seq") < F.col("accepted_seq"))
    before = before & ~F.col("is_earlier")
    invalid_counts = invalid.join(
        first, F.col("transaction_id").eqNullSafe(F.col("accepted_id")), "left"
    ).select(
        F.lit(1).alias("raw_rows"),
        F.lit(0).alias("processed"),
        F.lit(0).alias("aliases"),
        F.lit(0).alias("imputed"),
        F.when(before, 1).otherwise(0).alias("invalid"),
    )
    accepted_counts = accepted.select(
        F.col("valid_rows").alias("raw_rows"),
        F.col("is_new").alias("processed"),
        (F.col("marks").bitwiseAND(1) * F.col("is_new")).alias("aliases"),
        (F.shiftright(F.col("marks"), 1) * F.col("is_new")).alias("imputed"),
        F.lit(0).alias("invalid"),
    )

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("long")

    return (
        accepted_counts.unionByName(invalid_counts)
        .agg(*[total(c).alias(c) for c in ("raw_rows", "processed", "aliases", "imputed", "invalid")])
        .select(
            F.col("raw_rows").alias("raw_transaction_count"),
            (F.col("raw_rows") - F.col("invalid") - F.col("processed")).alias("duplicate_transactions_removed"),
            F.col("aliases").alias("inconsistent_bank_names_standardized"),
            F.col("invalid").alias("invalid_amounts_dropped"),
            F.col("imputed").alias("missing_values_imputed"),
            F.col("processed").alias("processed_transaction_count"),
        )
    )
