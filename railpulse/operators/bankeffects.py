"""What payer and payee banks each add to technical declines.

The rate of a bank alone mixes its own declines with those of the banks it deals with. Here
the rate of a pair is the overall rate plus an effect of the payer plus one of the payee,
fitted by least squares over pairs weighted by attempts. The fit alternates: payers
explain what payees leave, then payees what payers leave. Attempts are reduced to pairs
first, so a round is two windows over at most (number of banks) squared rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railpulse.functions import flags
from railpulse.functions.numbers import percent, rounded
from railpulse.operators.tallies import outcome_cells, with_codes
from railpulse.session import work_folder

ROUNDS = 8


def alternate(cells: DataFrame, row: str, column: str, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (row, column, weight, total) with ``overall``, ``row_effect``,
    ``column_effect`` and ``change``, the largest move of an effect of the cell in the last
    round. Effects that the cells hold already are taken up from there.

    Effects have a weighted mean of zero. Where the pairs fall into parts without a
    common bank, effects are comparable within a part only.
    """
    whole, by_row, by_column = Window.partitionBy(), Window.partitionBy(row), Window.partitionBy(column)
    fit = cells
    if "row_effect" not in cells.columns:
        overall = F.sum("total").over(whole).cast("double") / F.sum("weight").over(whole)
        fit = cells.withColumns({"overall": overall, "row_effect": F.lit(0.0), "column_effect": F.lit(0.0)})
    for _ in range(rounds):
        for mine, other, group in (("row_effect", "column_effect", by_row), ("column_effect", "row_effect", by_column)):
            left = F.sum(F.col("total") - F.col("weight") * (F.col("overall") + F.col(other))).over(group)
            fit = fit.withColumn(f"_{mine}", F.col(mine)).withColumn(mine, left / F.sum("weight").over(group))
    moves = [F.abs(F.col(c) - F.col(f"_{c}")) for c in ("row_effect", "column_effect")]
    return fit.withColumn("change", F.greatest(*moves)).drop("_row_effect", "_column_effect")


def alternate_until(
    cells: DataFrame, row: str, column: str, tolerance: float = 1e-9, rounds: int = ROUNDS, most_rounds: int = 2_000
) -> DataFrame:
    """:func:`alternate` until no effect moves by more than ``tolerance`` in a round. Every
    ``rounds`` rounds the pairs are written to the shared folder, which keeps plans short."""
    spark, fit = cells.sparkSession, cells
    for _ in range(-(-most_rounds // rounds)):
        path = work_folder(spark, "bank-effects")
        alternate(fit.drop("change"), row, column, rounds).write.parquet(path)
        fit = spark.read.parquet(path)
        if (fit.agg(F.max("change")).first()[0] or 0.0) <= tolerance:
            return fit
    raise ValueError(f"effects still move by more than {tolerance} after {most_rounds} rounds")


def bank_effects(
    tx: DataFrame, banks: DataFrame, error_codes: DataFrame, rounds: int = ROUNDS, tolerance: float | None = None
) -> DataFrame:
    """Per role and bank: volume, technical declines, the bank's own rate against the overall
    one (``raw_points``), its effect with the other side's taken out (``effect_points``),
    the declines that come with the effect, and the role's share of the spread that the
    effects of both roles make over the attempts.

    ``rounds`` rounds are fitted, or as many as ``tolerance`` (in shares, not points) needs.
    Banks without a name and unknown ones keep their rows. ``tx`` are attempts or hourly cells.
    """
    pairs = (
        with_codes(outcome_cells(tx, "payer_bank_id", "payee_bank_id"), error_codes)
        .groupBy("payer_bank_id", "payee_bank_id")
        .agg(
            F.sum("cell_txns").alias("weight"),
            F.sum(F.when(flags.technical_by_type(), F.col("cell_txns")).otherwise(0)).alias("total"),
        )
    )
    sides = ("payer_bank_id", "payee_bank_id")
    fit = alternate(pairs, *sides, rounds) if tolerance is None else alternate_until(pairs, *sides, tolerance, rounds)
    roles = F.array(
        *[
            F.struct(F.lit(role).alias("bank_role"), F.col(f"{role}_bank_id").alias("role_bank_id"), F.col(effect).alias("effect"))
            for role, effect in (("payer", "row_effect"), ("payee", "column_effect"))
        ]
    )
    t = fit.select(F.inline(roles), "weight", "total", "overall").groupBy("bank_role", "role_bank_id").agg(
        F.sum("weight").alias("total_volume"),
        F.sum("total").alias("technical_declines"),
        F.max("effect").alias("effect"),
        F.max("overall").alias("overall"),
    )
    spread = "sum(effect * effect * total_volume)"
    return t.join(banks, F.col("role_bank_id") == F.col("bank_id"), "left").select(
        "bank_role",
        F.col("role_bank_id").alias("bank_id"),
        "bank_name",
        "total_volume",
        "technical_declines",
        rounded("100D * (technical_declines / total_volume - overall)", 4).alias("raw_points"),
        rounded("100D * effect", 4).alias("effect_points"),
        rounded("effect * total_volume", 2).alias("declines_from_effect"),
        percent(f"{spread} over (partition by bank_role)", f"{spread} over ()").alias("role_spread_pct"),
    )
