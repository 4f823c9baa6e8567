"""Next and previous attempt of the same key, safe for hot keys.

A window function puts all rows of a key into one task. That is right for
ordinary keys and wrong for one key holding a large part of the table. So keys
of more than ``hot_rows`` rows are cut along time: each minute of such a key is
its own group, and where a minute is still too large each second of it, and then each
microsecond. Every group gets one extra row, the edge of the nearest other group.
Within a group the plain window then finds the same neighbour as over the whole key.

Groups that are too large are found in one pass over a sample of the rows chosen
by hash, so looking for them shuffles little. Which groups are cut does not affect
the result, only how evenly the work is spread. Without hot keys the broadcast
lists are empty and the edge branch is dropped at run time; what remains is the
plain window.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 5_000_000
# A group at the limit has about this many rows in the sample. Every listed group has
# more, so a broadcast list has at most one entry per ``hot_rows`` rows of the table.
SAMPLED_ROWS = 10_000
# Microseconds of the slices: a minute, a second, a microsecond.
WIDTHS = (60_000_000, 1_000_000, 1)
# The slice of rows without a time, which sort first.
NO_TIME = -(1 << 63)


def with_next(
    df: DataFrame,
    keys: list[str],
    time_col: str,
    tie_break: str,
    columns: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``next_<c>`` for each of ``columns``, taken from the following row of
    the key in order of time and tie-break; NULL at the end."""
    return _with_neighbour(df, keys, time_col, tie_break, columns, hot_rows, forward=True)


def with_previous(
    df: DataFrame,
    keys: list[str],
    time_col: str,
    tie_break: str,
    columns: list[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``previous_<c>`` for each of ``columns``; NULL at the beginning."""
    return _with_neighbour(df, keys, time_col, tie_break, columns, hot_rows, forward=False)


def with_island(
    df: DataFrame,
    keys: list[str],
    time_col: str,
    tie_break: str,
    columns: list[str],
    starts: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``previous_<c>`` for each of ``columns``, and ``island``: time and tie-break of
    the row that begins the row's island, the last one up to it for which ``starts`` holds.

    ``starts`` speaks of the row and its ``previous_<c>``. Rows ahead of a key's first start
    have no island. Rows without one of the keys are left out. A slice of a hot key takes
    the island it opens with from the slices before it, of which one row each is looked at.
    """
    found = _sliced_neighbours(df.dropna(subset=keys), keys, time_col, tie_break, columns, hot_rows, forward=False)
    start = F.struct(F.col(time_col).alias("at"), F.col(tie_break).alias("id"))
    upto = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(time_col, tie_break)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = found.withColumn("_start", F.when(starts, start)).withColumn(
        "_island", F.last("_start", ignorenulls=True).over(upto)
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        local.filter(F.col("_slice").isNotNull())
        .groupBy(*keys, "_slice")
        .agg(F.max("_start").alias("_end"))
        .select(
            *[F.col(c).alias(f"_carried_{c}") for c in [*keys, "_slice"]],
            F.last("_end", ignorenulls=True).over(before).alias("_carried"),
        )
    )
    # Plain equality keeps the partitioning of the window; ordinary keys have no slice.
    same = reduce(and_, [F.col(c) == F.col(f"_carried_{c}") for c in [*keys, "_slice"]])
    return local.join(carried, same, "left").select(
        *[F.col(c) for c in found.columns if c != "_slice"], F.coalesce("_island", "_carried").alias("island")
    )


def _with_neighbour(df, keys, time_col, tie_break, columns, hot_rows, forward):
    return _sliced_neighbours(df, keys, time_col, tie_break, columns, hot_rows, forward).drop("_slice")


def _sliced_neighbours(df, keys, time_col, tie_break, columns, hot_rows, forward):
    prefix, shift = ("next_", F.lead) if forward else ("previous_", F.lag)
    sliced = _cut_hot_groups(df, keys, time_col, tie_break, hot_rows)
    edges = _edges(sliced, keys, time_col, tie_break, columns, forward)
    rows = sliced.withColumn("_edge", F.lit(False)).unionByName(edges, allowMissingColumns=True)
    group = Window.partitionBy(*keys, "_slice").orderBy(time_col, tie_break)
    return (
        rows.withColumns({f"{prefix}{c}": shift(c).over(group) for c in columns})
        .filter(~F.col("_edge"))
        .drop("_edge")
    )


def _cut_hot_groups(df: DataFrame, keys: list[str], time_col: str, tie_break: str, hot_rows: int) -> DataFrame:
    """Add ``_slice``: NULL for ordinary keys, else the start of the row's time
    slice in microseconds. Slices of one key are ordered as their rows."""
    one_in = max(1, hot_rows // SAMPLED_ROWS)
    sampled = F.pmod(F.xxhash64(time_col, tie_break), F.lit(one_in)) == 0
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    starts = {
        f"_start{i}": F.coalesce(micros - F.pmod(micros, F.lit(width)), F.lit(NO_TIME))
        for i, width in enumerate(WIDTHS)
    }
    *coarse, finest = starts  # slices of the finest width are never cut
    counts = df.filter(sampled).select(*keys, *[starts[c].alias(c) for c in coarse], F.lit(1).alias("_rows"))
    cut = df.withColumns(starts)
    place = F.col(finest)
    # From seconds up to whole keys, each count made from the one before.
    for level in range(len(coarse), -1, -1):
        names, mark = [*keys, *coarse[:level]], f"_large{level}"
        counts = counts.groupBy(*names).agg(F.sum("_rows").alias("_rows"))
        large = counts.filter(F.col("_rows") > hot_rows / one_in).select(
            *[F.col(c).alias(f"{mark}_{c}") for c in names], F.lit(True).alias(mark)
        )
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{mark}_{c}")) for c in names])
        cut = cut.join(F.broadcast(large), same, "left")
        whole = F.col(coarse[level - 1]) if level else F.lit(None).cast("long")
        place = F.when(F.col(mark), place).otherwise(whole)
    return cut.select(*df.columns, place.alias("_slice"))


def _edges(sliced, keys, time_col, tie_break, columns, forward):
    """For each slice of a hot key, the nearest row outside it, as a row of the
    slice. The window sees one row per slice."""
    pick = F.min if forward else F.max
    wanted = list(dict.fromkeys([time_col, tie_break, *columns]))
    row = F.struct(*[F.col(c) for c in wanted if c not in keys])
    ends = (
        sliced.filter(F.col("_slice").isNotNull())
        .groupBy(*keys, "_slice")
        .agg(pick(row).alias("_end"))
    )
    along = Window.partitionBy(*keys).orderBy("_slice")
    nearest = (F.lead if forward else F.lag)("_end").over(along)
    return (
        ends.withColumn("_end", nearest)
        .filter(F.col("_end").isNotNull())
        .select(*keys, "_slice", "_end.*")
        .withColumn("_edge", F.lit(True))
    )
