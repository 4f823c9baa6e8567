"""Exact discrete percentiles without a sort of all values in one place."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Width of a bin, in units of the value. It bounds the distinct values one task
# orders; the number of bins is the value range over this width.
BIN = 10_000_000


def exact_percentiles(
    rows: DataFrame, keys: list[str], value: str, points: dict[str, float], bin_width: int = BIN
) -> DataFrame:
    """Per group, the smallest value that at least the given share of the rows do
    not exceed, one column per name in ``points``; and ``row_count`` and
    ``value_sum`` of the group.

    ``value`` is a whole number, never NULL, and the groups are few (they are
    broadcast). Equal values are counted first. The counts per bin tell which bin
    holds the wanted rank, and only the values of that bin are put in order.
    """
    counts = (
        rows.groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bin", F.floor(F.col(value) / F.lit(bin_width)))
    )
    bins = counts.groupBy(*keys, "_bin").agg(
        F.sum("_n").alias("_n"), F.sum(F.col(value).cast("decimal(20,0)") * F.col("_n").cast("decimal(18,0)")).alias("_sum")
    )

    group = Window.partitionBy(*keys)
    upto = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.array(*[F.struct(F.lit(n).alias("_point"), F.lit(p).alias("_share")) for n, p in points.items()])
    targets = (
        bins.select(
            *keys,
            "_bin",
            "_n",
            F.sum("_n").over(upto).alias("_upto"),
            F.sum("_n").over(group).alias("row_count"),
            F.sum("_sum").over(group).alias("value_sum"),
        )
        .select("*", F.inline(wanted))
        .withColumn("_rank", F.greatest(F.ceil(F.col("_share") * F.col("row_count")), F.lit(1)))
        .filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
        .select(
            *[F.col(k).alias(f"_target_{k}") for k in [*keys, "_bin"]],
            "_point",
            (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank_in_bin"),
            "row_count",
            "value_sum",
        )
    )
    # Null-safe equality infers no filter on one side, so both uses of the counts
    # stay the same plan and share one exchange.
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_target_{k}")) for k in [*keys, "_bin"]])
    within = (
        Window.partitionBy(*keys, "_point").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        counts.join(F.broadcast(targets), same)
        .withColumn("_place", F.sum("_n").over(within))
        .filter(F.col("_place") >= F.col("_rank_in_bin"))
    )
    return found.groupBy(*keys, "row_count", "value_sum").agg(
        *[F.min(F.when(F.col("_point") == name, F.col(value))).alias(name) for name in points]
    )
