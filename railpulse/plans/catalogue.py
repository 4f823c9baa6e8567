"""Every query by name: operators applied to the payment tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from railpulse import dimensions as D
from railpulse import schemas as S
from railpulse.operators import (
    abandonment,
    bankeffects,
    bankhealth,
    banks,
    cleaning,
    duplicates,
    experiment,
    failures,
    funnel,
    kpis,
    quality,
    retries,
    segments,
    timeprofile,
    users,
)
from railpulse.functions.numbers import rounded
from railpulse.session import work_folder
from railpulse.sources import tables
from railpulse.sources.star import StarTables, with_repeats
from railpulse.streaming import cleaning as store_cleaning
from railpulse.streaming import followups, keyed_locks, locks, runs

DAY = 86_400
# Keys with repeats in the test tables; the lock key proper hardly repeats there.
COARSE_KEY = ["user_id", "payee_bank_id"]
STREAM_DELAY = "10 minutes"
# Most attempts in a file of a batch.
FILE_ROWS = 1 << 19

Query = Callable[[SparkSession, str], DataFrame]


def _plain_amount(df: DataFrame) -> DataFrame:
    """Money as double, the common ground of result comparisons."""
    return df.withColumn("amount", F.col("amount").cast("double"))


def _published(spark: SparkSession, s: StarTables) -> DataFrame:
    """Static tables written as CSV, published and read back, each row as text."""
    raw, out = work_folder(spark, "static-raw"), work_folder(spark, "static-out")
    frames = {"banks": s.banks(), "error_codes": s.error_codes(), "devices": s.devices(), "users": s.users()}
    for name, schema in S.STATIC_TABLES.items():
        frame = frames[name]
        tables.write_csv(frame.select([F.col(f.name).cast(f.dataType) for f in schema]), raw, name)
    paths = tables.publish_dims(spark, raw, out)
    published = [
        spark.read.schema(schema).parquet(paths[name]).select(
            F.lit(name).alias("table_name"),
            F.col(schema.fieldNames()[0]).cast("string").alias("row_key"),
            F.concat_ws("|", *[F.col(c).cast("string") for c in schema.fieldNames()]).alias("row_text"),
        )
        for name, schema in S.STATIC_TABLES.items()
    ]
    return reduce(DataFrame.unionByName, published)


def _cleaned_by_batches(spark: SparkSession, s: StarTables) -> tuple[DataFrame, DataFrame]:
    """The raw attempts, cleaned in five batches of consecutive ingest order; the third is
    replayed when the fifth is done. Cleaned attempts and audit. The attempts are written
    by batch, as days of files are, so that each batch reads its own."""
    raw = s.raw_transactions()
    store = store_cleaning.CleanStore(spark, work_folder(spark, "clean-store"), "bigint", buckets=8, words=1 << 16).create(raw)
    share = F.col("ingest_seq").cast("double") / raw.agg(F.max("ingest_seq")).scalar()
    days = work_folder(spark, "clean-days")
    numbered = raw.withColumn("_batch", F.least(F.floor(share * 5), F.lit(4)).cast("int"))
    # Where the input is in ingest order, a few tasks write a batch: no file is too much for one reader.
    numbered.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("_batch").parquet(days)
    batches = spark.read.schema(StructType([*raw.schema, StructField("_batch", IntegerType())])).parquet(days)
    for batch in (0, 1, 2, 3, 4, 2):
        store.add(batches.filter(F.col("_batch") == batch).drop("_batch"), batch)
    schema = ", ".join(f"{c} {t}" for c, t in cleaning.clean_transactions(raw).dtypes)
    return store.transactions(schema).drop("batch"), store.audit()


def _funnel(s: StarTables) -> DataFrame:
    """The first stage has no loss. As double, that NULL looks the same to every
    client library; as whole number it does not."""
    df = funnel.funnel(s.stage_events(), s.initiated(), s.stage_names())
    return df.withColumn("absolute_dropoff_volume", F.col("absolute_dropoff_volume").cast("double"))


def _limit_breaches(s: StarTables) -> DataFrame:
    rate = duplicates.duplicate_payment_rate(s.transactions())
    return kpis.limit_breaches(kpis.kill_switch_metrics(kpis.core_kpis(s.transactions(), s.error_codes()), rate))


def _return_curve(s: StarTables) -> DataFrame:
    steps = abandonment.failure_steps(s.transactions(), "failure_code", horizon_s=7 * DAY, grid_s=3_600)
    return abandonment.return_curve(steps, ["failure_code"], 3_600).select(
        "failure_code", "seconds", "at_risk", "returned", "censored",
        rounded("away", 6).alias("away"), rounded("standard_error", 6).alias("standard_error"),
    )


def _rollback_triggers(s: StarTables) -> DataFrame:
    attempts = with_repeats(s.transactions())
    metrics = abandonment.rollback_metrics(
        duplicates.duplicate_payment_rate(attempts), abandonment.abandonment_by_variant(attempts)
    )
    return kpis.limit_breaches(metrics, D.ROLLBACK_LIMITS)


def _sketched_latency(spark: SparkSession, s: StarTables) -> DataFrame:
    """Two years from stored daily sketches, and whether the percentiles hold their bound
    against all steps of that time."""
    period = ("1996-01-01", "1997-12-31")
    path = tables.write_table(funnel.latency_sketches(s.stage_events(), s.stage_names()), work_folder(spark, "sketches"), "latency")
    report = funnel.latency_from_sketches(spark.read.parquet(path), s.stage_names(), *period)
    steps = funnel.stage_steps(s.stage_events(), s.stage_names()).filter(F.col("day").between(*period))
    bounds = funnel.sketch_errors(steps, report).groupBy("stage_id").agg(
        (F.max("rank_error") <= funnel.SKETCH_ERROR).alias("within_bound")
    )
    return report.join(bounds, "stage_id").select("stage_id", "stage_name", "days", "steps", "mean_seconds", "within_bound")


def _health_stream(spark: SparkSession, s: StarTables) -> DataFrame:
    stream = bankhealth.rolling_bank_health(s.transaction_stream(), watermark=STREAM_DELAY)
    return runs.drain_to_parquet(spark, stream, "bank-health")


def _incident_stream(spark: SparkSession, s: StarTables) -> DataFrame:
    stream = bankhealth.bank_incidents(s.transaction_stream(), watermark=STREAM_DELAY)
    return runs.drain_to_parquet(spark, stream, "bank-incidents")


def _follow_up_stream(spark: SparkSession, s: StarTables) -> DataFrame:
    stream = followups.timeout_follow_ups(with_repeats(s.transaction_stream()), watermark=STREAM_DELAY)
    return runs.drain_to_parquet(spark, stream, "follow-ups")


def _lock_window_stream(spark: SparkSession, s: StarTables) -> DataFrame:
    stream = duplicates.lock_windows(s.transaction_stream(), "1 day", COARSE_KEY, STREAM_DELAY)
    return runs.drain_to_parquet(spark, stream, "lock-windows")


def _lock_stream(spark: SparkSession, s: StarTables) -> DataFrame:
    stream = locks.lock_stream(
        s.transaction_stream(max_bytes_per_trigger=1 << 30), window_s=DAY, keys=COARSE_KEY, watermark=STREAM_DELAY
    )
    rows = runs.drain_to_parquet(spark, stream, "locks")
    return rows.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


def _repeated_lock_window_stream(spark: SparkSession, s: StarTables) -> DataFrame:
    stream = duplicates.lock_windows(with_repeats(s.transaction_stream()), watermark=STREAM_DELAY)
    return _plain_amount(runs.drain_to_parquet(spark, stream, "lock-windows"))


def _repeated_lock_stream(spark: SparkSession, s: StarTables) -> DataFrame:
    """The lock at its stated rule: user, payee and amount within 180 seconds."""
    attempts = with_repeats(s.transaction_stream(max_bytes_per_trigger=1 << 30))
    rows = runs.drain_to_parquet(spark, locks.lock_stream(attempts, watermark=STREAM_DELAY), "locks")
    return _plain_amount(rows).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


def _keyed_lock_stream(spark: SparkSession, s: StarTables) -> DataFrame:
    attempts = s.transaction_stream(max_bytes_per_trigger=1 << 30)
    stream = keyed_locks.keyed_lock_stream(attempts, DAY, COARSE_KEY, STREAM_DELAY)
    rows = runs.drain_to_parquet(spark, stream, "keyed-locks", keyed_locks.STATE_SETTINGS)
    return rows.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


def _repeated_keyed_lock_stream(spark: SparkSession, s: StarTables) -> DataFrame:
    attempts = with_repeats(s.transaction_stream(max_bytes_per_trigger=1 << 30))
    stream = keyed_locks.keyed_lock_stream(attempts, watermark=STREAM_DELAY)
    rows = runs.drain_to_parquet(spark, stream, "keyed-locks", keyed_locks.STATE_SETTINGS)
    return _plain_amount(rows).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


def all_queries() -> dict[str, Query]:
    def over(build: Callable[[StarTables], DataFrame]) -> Query:
        return lambda spark, folder: build(StarTables(spark, folder))

    def with_session(build: Callable[[SparkSession, StarTables], DataFrame]) -> Query:
        return lambda spark, folder: build(spark, StarTables(spark, folder))

    return {
        # Audit and cleaning
        "dq_duplicates": over(lambda s: quality.dq_duplicates(s.raw_transactions())),
        "dq_bank_aliases": over(lambda s: quality.dq_bank_aliases(s.raw_transactions())),
        "dq_invalid_amounts": over(lambda s: quality.dq_invalid_amounts(s.raw_transactions())),
        "dq_missing": over(lambda s: quality.dq_missing(s.raw_transactions())),
        "dq_audit_summary": over(lambda s: quality.dq_audit_summary(s.raw_transactions())),
        "clean_view": over(lambda s: _plain_amount(cleaning.clean_view(s.raw_transactions()))),
        "clean_transactions": over(lambda s: _plain_amount(cleaning.clean_transactions(s.raw_transactions()))),
        "clean_incremental": with_session(lambda spark, s: _plain_amount(_cleaned_by_batches(spark, s)[0])),
        "clean_incremental_audit": with_session(lambda spark, s: _cleaned_by_batches(spark, s)[1]),
        "clean_stage_events": over(
            lambda s: cleaning.clean_stage_events(s.raw_stage_events(), cleaning.accepted_ids(s.raw_transactions()))
        ),
        "publish_dims": with_session(_published),
        # Indicators and failures
        "core_kpis": over(lambda s: kpis.core_kpis(s.transactions(), s.error_codes())),
        "status_breakdown": over(lambda s: kpis.status_breakdown(s.transactions())),
        "recovery_scenarios": over(lambda s: kpis.recovery_scenarios(s.transactions(), s.error_codes())),
        "recovery_by_scenario": over(lambda s: kpis.recovery_by_scenario(s.transactions(), s.error_codes())),
        "limit_breaches": over(_limit_breaches),
        "failure_breakdown": over(lambda s: failures.failure_breakdown(s.transactions(), s.error_codes())),
        "failure_reasons": over(lambda s: failures.failure_reasons(s.transactions(), s.error_codes())),
        "failure_rollup": over(lambda s: failures.failure_rollup(s.transactions(), s.error_codes())),
        # Banks
        "payer_bank_ranking": over(
            lambda s: banks.payer_bank_ranking(s.transactions(), s.banks(), s.error_codes())
        ),
        "bank_psr_td": over(lambda s: banks.bank_psr_td(s.transactions(), s.banks(), s.error_codes())),
        "bank_pair_matrix": over(lambda s: banks.bank_pair_matrix(s.transactions(), s.banks())),
        "bank_pair_pivot": over(lambda s: banks.bank_pair_pivot(s.transactions(), s.banks())),
        "bank_type_peak": over(lambda s: banks.bank_type_peak(s.transactions(), s.banks(), s.error_codes())),
        "decline_by_bank_role": over(
            lambda s: banks.decline_by_bank_role(s.transactions(), s.banks(), s.error_codes())
        ),
        "bank_effects": over(lambda s: bankeffects.bank_effects(s.transactions(), s.banks(), s.error_codes())),
        # Time
        "hourly_profile": over(lambda s: timeprofile.hourly_profile(s.transactions())),
        "hourly_chart": over(lambda s: timeprofile.hourly_chart(s.transactions())),
        "peak_summary": over(lambda s: timeprofile.peak_summary(s.transactions())),
        "peak_multiplier": over(lambda s: timeprofile.peak_multiplier(s.transactions())),
        "weekday_profile": over(lambda s: timeprofile.weekday_profile(s.transactions())),
        "rolling_failure_rate": over(lambda s: timeprofile.rolling_failure_rate(s.transactions())),
        # Stages
        "funnel": over(_funnel),
        "funnel_volume": over(lambda s: funnel.funnel_volume(s.stage_events(), s.stage_names())),
        "stage_latency": over(lambda s: funnel.stage_latency(s.stage_events(), s.stage_names())),
        "completion_time": over(lambda s: funnel.completion_time(s.stage_events(), s.stage_names())),
        "stage_latency_sketched": with_session(_sketched_latency),
        # Users
        "segment_friction": over(lambda s: users.segment_friction(s.users(), s.transactions())),
        "severe_impact": over(lambda s: users.severe_impact(s.users(), s.transactions())),
        "impacted_power_users": over(lambda s: users.impacted_power_users(s.transactions(), s.users())),
        "age_group_friction": over(lambda s: users.age_group_friction(s.users(), s.transactions())),
        "tenure_friction": over(lambda s: users.tenure_friction(s.users(), s.transactions())),
        # Platform and amount
        "os_network": over(lambda s: segments.os_network(s.transactions(), s.devices(), s.error_codes())),
        "type_amount_matrix": over(lambda s: segments.type_amount_matrix(s.transactions())),
        "type_amount_contiguous": over(lambda s: segments.type_amount_matrix(s.transactions(), contiguous=True)),
        # Retries and duplicates
        "retry_policy": over(lambda s: retries.retry_policy(s.transactions(), s.error_codes())),
        "retry_policy_day": over(
            lambda s: retries.retry_policy(s.transactions(), s.error_codes(), window_s=DAY, tol=0.5)
        ),
        "retry_by_category": over(lambda s: retries.retry_by_category(s.transactions(), s.error_codes())),
        "retry_frequency": over(lambda s: retries.retry_frequency(s.transactions())),
        "retry_episodes_day": over(
            lambda s: retries.retry_episodes(s.transactions(), DAY).select(
                "*", (F.col("micros").cast("double") / F.lit(1e6)).alias("seconds")
            ).drop("micros")
        ),
        "retry_episodes_by_code_day": over(lambda s: retries.retry_episodes_by_code(s.transactions(), DAY)),
        "retry_episodes_by_code_repeated": over(lambda s: retries.retry_episodes_by_code(with_repeats(s.transactions()))),
        "attempts_after_timeout": over(lambda s: retries.attempts_after_timeout(s.transactions())),
        "attempts_after_timeout_day": over(lambda s: retries.attempts_after_timeout(s.transactions(), DAY)),
        "timeout_follow_ups_repeated": over(
            lambda s: followups.timeout_follow_ups(with_repeats(s.transactions()))
        ),
        "timeout_follow_ups_stream_repeated": with_session(_follow_up_stream),
        "duplicate_attempts": over(lambda s: _plain_amount(duplicates.duplicate_attempts(s.transactions()))),
        "duplicate_attempts_day": over(
            lambda s: duplicates.duplicate_attempts(s.transactions(), DAY, COARSE_KEY)
        ),
        "duplicate_payment_rate": over(lambda s: duplicates.duplicate_payment_rate(s.transactions())),
        "duplicate_payment_rate_day": over(
            lambda s: duplicates.duplicate_payment_rate(s.transactions(), DAY, COARSE_KEY)
        ),
        "duplicate_attempts_repeated": over(
            lambda s: _plain_amount(duplicates.duplicate_attempts(with_repeats(s.transactions())))
        ),
        "duplicate_payment_rate_repeated": over(
            lambda s: duplicates.duplicate_payment_rate(with_repeats(s.transactions()))
        ),
        "lock_windows": over(lambda s: duplicates.lock_windows(s.transactions(), "1 day", COARSE_KEY)),
        "lock_windows_stream": with_session(_lock_window_stream),
        "lock_windows_stream_repeated": with_session(_repeated_lock_window_stream),
        "lock_stream": with_session(_lock_stream),
        "lock_stream_repeated": with_session(_repeated_lock_stream),
        "keyed_lock_stream": with_session(_keyed_lock_stream),
        "keyed_lock_stream_repeated": with_session(_repeated_keyed_lock_stream),
        # Abandonment after a failure
        "abandonment_by_code": over(lambda s: abandonment.abandonment_by_code(s.transactions())),
        "abandonment_by_variant": over(lambda s: abandonment.abandonment_by_variant(s.transactions(), 3 * DAY)),
        "abandonment_curve": over(_return_curve),
        "rollback_triggers": over(_rollback_triggers),
        # Bank health and experiment
        "bank_health": over(lambda s: bankhealth.rolling_bank_health(s.transactions())),
        "bank_health_stream": with_session(_health_stream),
        "bank_incidents": over(lambda s: bankhealth.bank_incidents(s.transactions())),
        "bank_incidents_stream": with_session(_incident_stream),
        "assign_variants": over(lambda s: experiment.assign_variants(s.users())),
        "experiment_readout": over(lambda s: experiment.experiment_readout(s.transactions())),
        "experiment_retry_day": over(lambda s: experiment.retry_readout(s.transactions(), DAY, 0.5)),
        "experiment_duplicates_repeated": over(lambda s: experiment.duplicate_readout(with_repeats(s.transactions()))),
        "experiment_aa": over(lambda s: experiment.aa_readouts(s.transactions())),
    }
