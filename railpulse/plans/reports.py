"""Cleaning and reporting from raw files to report tables.

    python -m railpulse.plans.reports RAW_FOLDER CLEAN_FOLDER REPORT_FOLDER

Most reports share three intermediates: hourly cells, user totals and the attempt
chain; the sketched latency has daily sketches. Each is written to the report folder and read back, so that it is computed
once and survives the loss of executors. Reports on what these do not hold
(devices, contiguous buckets, duplicates, bank health, the experiment, the number
of payments) read the attempts themselves.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

from railpulse import dimensions as D
from railpulse.functions import flags
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
from railpulse.operators.tallies import hourly_cells
from railpulse.session import builder, work_folder
from railpulse.sources import tables


def clean_folder(spark: SparkSession, raw_folder: str, out_folder: str) -> None:
    """Audit and clean the raw CSV tables of a folder into Parquet tables.

    The raw attempts are written once with their place in the files, so that the
    audit, the raw reports and the cleaning all see one order.
    """
    raw = tables.read_raw(spark, raw_folder)
    numbered = _stored(spark, tables.with_file_order(raw["transactions"]), work_folder(spark, "raw"), "transactions")
    clean = _stored(spark, cleaning.clean_transactions(numbered), out_folder, "transactions")
    tables.write_table(cleaning.clean_stage_events(raw["stage_events"], clean), out_folder, "stage_events")
    tables.publish_dims(spark, raw_folder, out_folder)
    tables.write_summary(quality.dq_audit_summary(numbered), out_folder)
    for name, report in {
        "dq_duplicates": quality.dq_duplicates,
        "dq_bank_aliases": quality.dq_bank_aliases,
        "dq_invalid_amounts": quality.dq_invalid_amounts,
        "dq_missing": quality.dq_missing,
    }.items():
        tables.write_table(report(numbered), out_folder, name)


def _stored(spark: SparkSession, df: DataFrame, folder: str, name: str) -> DataFrame:
    return spark.read.schema(df.schema).parquet(tables.write_table(df, folder, name))


def reports(
    attempts: DataFrame,
    cells: DataFrame,
    totals: DataFrame,
    chain: DataFrame,
    dims: dict[str, DataFrame],
    stage_events: DataFrame,
    stage_names: DataFrame,
    sketches: DataFrame,
) -> dict[str, DataFrame]:
    """Every report over cleaned tables, by name.

    ``cells``, ``totals`` and ``chain`` are the shared intermediates of
    ``attempts``, which itself serves only what they cannot; ``sketches`` are the daily
    ones of ``stage_events``.
    """
    codes, bank, people = dims["error_codes"], dims["banks"], dims["users"]
    core, repeats = kpis.core_kpis(cells, codes), duplicates.duplicate_payment_rate(attempts)
    by_variant = abandonment.abandonment_by_variant(chain, watched=attempts)
    return {
        "core_kpis": core,
        "failure_breakdown": failures.failure_breakdown(cells, codes),
        "payer_bank_ranking": banks.payer_bank_ranking(cells, bank, codes),
        "bank_pair_matrix": banks.bank_pair_matrix(cells, bank),
        "hourly_profile": timeprofile.hourly_profile(cells),
        "peak_summary": timeprofile.peak_summary(cells),
        "funnel": funnel.funnel(stage_events, attempts, stage_names, unique_ids=True),
        "segment_friction": users.segment_friction(people, totals),
        "impacted_power_users": users.impacted_power_users(totals, people),
        "retry_policy": retries.retry_policy(chain, codes),
        "os_network": segments.os_network(attempts, dims["devices"], codes),
        "type_amount_matrix": segments.type_amount_matrix(cells),
        "recovery_scenarios": kpis.recovery_scenarios(cells, codes),
        "status_breakdown": kpis.status_breakdown(cells),
        "failure_reasons": failures.failure_reasons(cells, codes),
        "bank_psr_td": banks.bank_psr_td(cells, bank, codes),
        "bank_pair_pivot": banks.bank_pair_pivot(cells, bank),
        "hourly_chart": timeprofile.hourly_chart(cells),
        "funnel_volume": funnel.funnel_volume(stage_events, stage_names),
        "retry_by_category": retries.retry_by_category(chain, codes),
        "severe_impact": users.severe_impact(people, totals),
        "weekday_profile": timeprofile.weekday_profile(cells),
        "rolling_failure_rate": timeprofile.rolling_failure_rate(cells),
        "retry_frequency": retries.retry_frequency(chain),
        "attempts_after_timeout": retries.attempts_after_timeout(chain),
        "recovery_by_scenario": kpis.recovery_by_scenario(cells, codes),
        "failure_rollup": failures.failure_rollup(cells, codes),
        "bank_type_peak": banks.bank_type_peak(cells, bank, codes),
        "decline_by_bank_role": banks.decline_by_bank_role(cells, bank, codes),
        "bank_effects": bankeffects.bank_effects(cells, bank, codes),
        "peak_multiplier": timeprofile.peak_multiplier(cells),
        "stage_latency": funnel.stage_latency(stage_events, stage_names),
        "stage_latency_sketched": funnel.latency_from_sketches(sketches, stage_names),
        "completion_time": funnel.completion_time(stage_events, stage_names),
        "age_group_friction": users.age_group_friction(people, totals),
        "tenure_friction": users.tenure_friction(people, totals),
        "type_amount_contiguous": segments.type_amount_matrix(attempts, contiguous=True),
        "duplicate_attempts": duplicates.duplicate_attempts(attempts),
        "duplicate_payment_rate": repeats,
        "lock_windows": duplicates.lock_windows(attempts),
        "bank_health": bankhealth.rolling_bank_health(attempts),
        "limit_breaches": kpis.limit_breaches(kpis.kill_switch_metrics(core, repeats)),
        "bank_incidents": bankhealth.bank_incidents(attempts),
        "abandonment_by_code": abandonment.abandonment_by_code(chain, watched=attempts),
        "abandonment_by_variant": by_variant,
        "rollback_triggers": kpis.limit_breaches(abandonment.rollback_metrics(repeats, by_variant), D.ROLLBACK_LIMITS),
        "experiment_readout": experiment.experiment_readout(attempts),
        "experiment_retry_readout": experiment.retry_readout(chain),
        "experiment_duplicate_readout": experiment.duplicate_readout(attempts),
    }


def write_reports(spark: SparkSession, clean: str, out: str) -> list[str]:
    """Compute all reports over a cleaned folder and write each as a table."""
    t = tables.read_clean(spark, clean)
    attempts = t["transactions"]
    shared = os.path.join(out, "shared")
    ready = reports(
        attempts,
        _stored(spark, hourly_cells(attempts), shared, "hourly_cells"),
        _stored(spark, users.user_totals(attempts), shared, "user_totals"),
        # Retry reports look at failures only, a small part of the chain.
        _stored(spark, retries.attempt_chain(attempts).filter(flags.failed()), shared, "failed_attempts"),
        {name: t[name] for name in ("error_codes", "banks", "users", "devices")},
        t["stage_events"],
        D.stage_names(spark),
        _stored(spark, funnel.latency_sketches(t["stage_events"], D.stage_names(spark)), shared, "latency_sketches"),
    )
    for name, report in ready.items():
        tables.write_table(report, out, name)
    return sorted(ready)


def main(argv: list[str]) -> None:
    raw, clean, out = argv
    spark = builder("railpulse-reports").getOrCreate()
    clean_folder(spark, raw, clean)
    for name in write_reports(spark, clean, out):
        print(name)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
