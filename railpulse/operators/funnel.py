"""The payment journey: volume, drop-off and latency of its stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railpulse import dimensions as D
from railpulse.functions import flags
from railpulse.functions.numbers import percent, rounded
from railpulse.operators.percentiles import exact_percentiles

# Stages that fit the bits of one number.
MOST_STAGES = 63


def _ids(stage_names: DataFrame) -> list[int]:
    """Ids of the named stages, in order: a small table, at most one bit each below."""
    ids = sorted(r[0] for r in stage_names.select("stage_id").distinct().collect() if r[0] is not None)
    if len(ids) > MOST_STAGES:
        raise ValueError(f"at most {MOST_STAGES} named stages, not {len(ids)}")
    return ids


def _per_stage(stages: DataFrame, ids: list[int], failures: bool = False) -> DataFrame:
    """Distinct transactions per named stage that occurs and, if asked for, its failed rows.

    A transaction's stages fit in the bits of one number, so the exact distinct
    count shuffles one row per transaction instead of one per stage. Failed rows are
    summed on the way, so the stages are read once.
    """
    here = [F.col("stage_id") == i for i in ids]
    bit = F.coalesce(*[F.when(at, F.lit(1 << place).cast("long")) for place, at in enumerate(here)])
    failed = F.col("stage_status") == D.FAILED
    lost = [flags.count_where(at & failed).alias(f"lost{i}") for i, at in zip(ids, here)] if failures else []
    known = stages.filter(F.col("stage_id").isin(ids))
    journeys = known.groupBy("transaction_id").agg(F.bit_or(bit).alias("visited"), *lost)
    per_stage = []
    for place, i in enumerate(ids):
        seen = F.shiftright("visited", place).bitwiseAND(F.lit(1))
        # COUNT(DISTINCT id) does not count a NULL id.
        entering = F.sum(F.when(F.col("transaction_id").isNotNull(), seen).otherwise(0))
        fields = [F.lit(i).alias("entered_stage"), F.max(seen).alias("occurs"), entering.alias("entering")]
        fields += [F.sum(f"lost{i}").alias("stage_failures")] if failures else []
        per_stage.append(F.struct(*fields))
    counts = journeys.agg(F.array(*per_stage).alias("per_stage")).select(F.inline("per_stage"))
    return counts.filter("occurs = 1").drop("occurs")


def funnel(stages: DataFrame, tx: DataFrame, stage_names: DataFrame, unique_ids: bool = False) -> DataFrame:
    """Per stage: distinct transactions entering, failed rows, conversion from
    all transactions, drop-off rate and loss against the stage before.

    ``unique_ids`` says that ``tx`` holds each id once, as cleaned data does;
    its distinct count is then a plain count.
    """
    ids = F.count("transaction_id") if unique_ids else F.count_distinct("transaction_id")
    initiated = tx.agg(ids.alias("n")).scalar()
    entering = F.col("entering")
    by_stage = Window.orderBy("stage_id")  # at most one row per named stage
    return (
        _per_stage(stages, _ids(stage_names), failures=True)
        .join(stage_names, F.col("entered_stage") == F.col("stage_id"))
        .withColumn("initiated", initiated)
        .select(
            "stage_name",
            "stage_id",
            entering.alias("transactions_entering_stage"),
            "stage_failures",
            percent("entering", "initiated").alias("overall_conversion_pct"),
            percent("stage_failures", "entering").alias("stage_dropoff_rate_pct"),
            (F.lag(entering).over(by_stage) - entering).alias("absolute_dropoff_volume"),
        )
        .orderBy("stage_id")
    )


def funnel_volume(stages: DataFrame, stage_names: DataFrame) -> DataFrame:
    """Distinct transactions per named stage that occurs."""
    return (
        _per_stage(stages, _ids(stage_names))
        .filter(F.col("entering") > 0)
        .join(stage_names, F.col("entered_stage") == F.col("stage_id"))
        .orderBy("stage_id")
        .select("stage_name", F.col("entering").alias("volume"))
    )


def _stage_times(stages: DataFrame, ids: list[int]) -> DataFrame:
    """One row per transaction with the first time of each stage as a column.

    One shuffle of partial minima; no sort and no window, and a transaction with
    very many stage rows is reduced before the shuffle.
    """
    first_time = [
        F.min(F.when(F.col("stage_id") == i, F.col("event_timestamp"))).alias(f"t{i}") for i in ids
    ]
    return stages.filter(F.col("stage_id").isin(ids)).groupBy("transaction_id").agg(*first_time)


def _latency(stage: int, ids: list[int]) -> Column:
    """Microseconds since the nearest earlier stage that the transaction reached."""
    earlier = [F.col(f"t{i}") for i in reversed(ids) if i < stage]
    return flags.micros_between(F.coalesce(*earlier), F.col(f"t{stage}"))


def stage_latency(stages: DataFrame, stage_names: DataFrame) -> DataFrame:
    """Seconds from the stage before, per stage: mean, exact median, exact 95th
    percentile, and rank by mean, the slowest stage first."""
    ids = _ids(stage_names)
    steps = F.array(
        *[F.struct(F.lit(i).alias("reached_stage"), _latency(i, ids).alias("micros")) for i in ids if i > min(ids)]
    )
    rows = _stage_times(stages, ids).select(F.inline(steps)).filter(F.col("micros").isNotNull())
    points = exact_percentiles(rows, ["reached_stage"], "micros", {"p50": 0.5, "p95": 0.95})
    second = F.lit(1e6)
    slowest_first = Window.orderBy(F.desc("mean_seconds"), "stage_id")  # one row per stage
    return (
        points.join(stage_names, F.col("reached_stage") == F.col("stage_id"))
        .select(
            "stage_id",
            "stage_name",
            F.col("row_count").alias("steps"),
            rounded("cast(value_sum as double) / row_count / 1e6D", 3).alias("mean_seconds"),
            (F.col("p50").cast("double") / second).alias("p50_seconds"),
            (F.col("p95").cast("double") / second).alias("p95_seconds"),
        )
        .withColumn("slowness_rank", F.row_number().over(slowest_first))
    )


# Size of a latency sketch. A quantile's rank is off by less than 0.35 % of the rows, at
# 99 % confidence; :data:`SKETCH_ERROR` has room for what chance leaves beyond that.
SKETCH_K, SKETCH_ERROR = 800, 0.01


def stage_steps(stages: DataFrame, stage_names: DataFrame) -> DataFrame:
    """Every step of a payment: the stage it reached, the microseconds since the stage
    before, and the day on which the payment began."""
    ids = _ids(stage_names)
    steps = F.array(
        *[F.struct(F.lit(i).alias("reached_stage"), _latency(i, ids).alias("micros")) for i in ids if i > min(ids)]
    )
    begun = F.to_date(F.array_min(F.array(*[F.col(f"t{i}") for i in ids]))).alias("day")
    return _stage_times(stages, ids).select(begun, F.inline(steps)).filter(F.col("micros").isNotNull())


def latency_sketches(stages: DataFrame, stage_names: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One row per day and stage: number and sum of its steps, and a KLL sketch of them.

    A day is that on which payments begin, so one batch holds all events of the payments begun
    that day, and its rows never change later. Store them by day: reports on
    any period merge the rows of its days and read no events.
    """
    return (
        stage_steps(stages, stage_names)
        .groupBy("day", "reached_stage")
        .agg(
            F.count(F.lit(1)).alias("steps"),
            F.sum(F.col("micros").cast("decimal(28,0)")).alias("micros"),
            F.kll_sketch_agg_bigint("micros", F.lit(k)).alias("sketch"),
        )
    )


def latency_from_sketches(
    sketches: DataFrame,
    stage_names: DataFrame,
    first_day: str | None = None,
    last_day: str | None = None,
    points: dict[str, float] | None = None,
    k: int = SKETCH_K,
) -> DataFrame:
    """Days, steps, exact mean and estimated percentiles per stage, in seconds, from the
    stored rows of the days asked for. ``points`` names the shares, by default the median
    and the 95th percentile. Merging keeps the bound on the rank that one sketch of
    all steps would have."""
    points = points or {"p50": 0.5, "p95": 0.95}
    rows = sketches
    if first_day is not None:
        rows = rows.filter(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        rows = rows.filter(F.col("day") <= F.lit(last_day).cast("date"))
    merged = rows.groupBy("reached_stage").agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("steps").alias("steps"),
        F.sum("micros").alias("micros"),
        F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"),
    )
    return merged.join(stage_names, F.col("reached_stage") == F.col("stage_id")).select(
        "stage_id",
        "stage_name",
        "days",
        "steps",
        rounded("cast(micros as double) / steps / 1e6D", 3).alias("mean_seconds"),
        *[
            (F.kll_sketch_get_quantile_bigint("sketch", F.lit(share)).cast("double") / F.lit(1e6)).alias(f"{name}_seconds")
            for name, share in points.items()
        ],
    )


def sketch_errors(steps: DataFrame, estimates: DataFrame, points: dict[str, float] | None = None) -> DataFrame:
    """Per stage and point, how far an estimate's rank among the given steps is from the
    wanted share: zero if the share lies within the ranks of the values equal to it."""
    points = points or {"p50": 0.5, "p95": 0.95}
    named = F.array(
        *[F.struct(F.lit(n).alias("point"), F.lit(p).alias("share"), F.col(f"{n}_seconds").alias("estimate")) for n, p in points.items()]
    )
    # A row per stage and point.
    wanted = F.broadcast(estimates.select("stage_id", F.inline(named)))
    seconds = F.col("micros").cast("double") / F.lit(1e6)
    t = steps.join(wanted, F.col("reached_stage") == F.col("stage_id")).groupBy("stage_id", "point", "share").agg(
        F.count(F.lit(1)).alias("n"),
        flags.count_where(seconds < F.col("estimate")).alias("below"),
        flags.count_where(seconds <= F.col("estimate")).alias("upto"),
    )
    off = F.greatest(F.expr("below / n - share"), F.expr("share - upto / n"), F.lit(0.0))
    return t.select("stage_id", "point", off.alias("rank_error"))


def completion_time(stages: DataFrame, stage_names: DataFrame) -> DataFrame:
    """One row: transactions with a successful last stage, and their mean, shortest
    and longest time from the first recorded stage to its first success, in seconds.
    The last stage is that of the named ones; without any nothing is completed."""
    stage_ids = _ids(stage_names) or [-1]
    at_end = (F.col("stage_id") == max(stage_ids)) & (F.col("stage_status") == D.SUCCESS)
    times = stages.filter(F.col("stage_id").isin(stage_ids)).groupBy("transaction_id").agg(
        F.min("event_timestamp").alias("start"), F.min(F.when(at_end, F.col("event_timestamp"))).alias("done")
    )
    micros = flags.micros_between(F.col("start"), F.col("done"))
    done = times.filter(F.col("done").isNotNull()).select(micros.alias("micros"))
    seconds = F.lit(1e6)
    return done.agg(
        F.count(F.lit(1)).alias("completed_transactions"),
        rounded("cast(sum(cast(micros as decimal(28,0))) as double) / nullif(count(*), 0) / 1e6D", 3).alias(
            "mean_seconds"
        ),
        (F.min("micros").cast("double") / seconds).alias("min_seconds"),
        (F.max("micros").cast("double") / seconds).alias("max_seconds"),
    )
