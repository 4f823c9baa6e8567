"""Reports from shared intermediates equal reports from the attempts."""

import os

import pytest

from railpulse import dimensions as D
from railpulse.operators import abandonment, banks, failures, kpis, retries, segments, timeprofile, users
from railpulse.operators.tallies import hourly_cells
from railpulse.plans import reports
from railpulse.plans.catalogue import all_queries
from railpulse.sources import tables
from railpulse.sources.star import StarTables

SMALL = "/root/testdata/sf0.001"

FROM_CELLS = {
    "core_kpis": lambda t, d: kpis.core_kpis(t, d["codes"]),
    "status_breakdown": lambda t, d: kpis.status_breakdown(t),
    "recovery_scenarios": lambda t, d: kpis.recovery_scenarios(t, d["codes"]),
    "failure_breakdown": lambda t, d: failures.failure_breakdown(t, d["codes"]),
    "failure_rollup": lambda t, d: failures.failure_rollup(t, d["codes"]),
    "payer_bank_ranking": lambda t, d: banks.payer_bank_ranking(t, d["banks"], d["codes"], 10),
    "bank_pair_matrix": lambda t, d: banks.bank_pair_matrix(t, d["banks"], 10),
    "bank_type_peak": lambda t, d: banks.bank_type_peak(t, d["banks"], d["codes"]),
    "decline_by_bank_role": lambda t, d: banks.decline_by_bank_role(t, d["banks"], d["codes"]),
    "hourly_profile": lambda t, d: timeprofile.hourly_profile(t),
    "peak_summary": lambda t, d: timeprofile.peak_summary(t),
    "peak_multiplier": lambda t, d: timeprofile.peak_multiplier(t),
    "weekday_profile": lambda t, d: timeprofile.weekday_profile(t),
    "rolling_failure_rate": lambda t, d: timeprofile.rolling_failure_rate(t),
    "type_amount_matrix": lambda t, d: segments.type_amount_matrix(t),
}


@pytest.fixture(scope="module")
def star(spark):
    return StarTables(spark, SMALL)


@pytest.fixture(scope="module")
def cells(star):
    return hourly_cells(star.transactions()).persist()


@pytest.mark.parametrize("name", sorted(FROM_CELLS))
def test_from_hourly_cells(spark, star, cells, name):
    dims = {"codes": star.error_codes(), "banks": star.banks()}
    want = FROM_CELLS[name](star.transactions(), dims).collect()
    assert sorted(map(str, FROM_CELLS[name](cells, dims).collect())) == sorted(map(str, want))


def test_from_totals_and_chain(star):
    totals, chain = users.user_totals(star.transactions()), retries.attempt_chain(star.transactions())
    people, codes = star.users(), star.error_codes()
    assert users.segment_friction(people, totals).collect() == users.segment_friction(people, star.transactions()).collect()
    day = 86_400
    assert (
        retries.retry_policy(chain, codes, day, 0.5).collect()
        == retries.retry_policy(star.transactions(), codes, day, 0.5).collect()
    )


def test_raw_files_to_reports(spark, star, tmp_path):
    """The whole way: CSV tables, cleaning, reports, with known totals."""
    raw, clean, out = (str(tmp_path / n) for n in ("raw", "clean", "out"))
    tx = star.transactions()
    text = tx.select([tx[c].cast("string") for c in tx.columns])
    for name, df in {
        "transactions": text,
        "stage_events": star.stage_events(),
        "banks": star.banks(),
        "error_codes": star.error_codes(),
        "users": star.users(),
        "devices": star.devices(),
    }.items():
        tables.write_csv(df, raw, name)
    reports.clean_folder(spark, raw, clean)
    names = reports.write_reports(spark, clean, out)
    # Every registered report; the rest is audit, cleaning, other windows, streams and set-up.
    others = {"clean_view", "clean_transactions", "clean_stage_events", "publish_dims", "assign_variants"}
    registered = {n for n in all_queries() if not n.startswith("dq_") and not n.endswith(("_day", "_stream", "_repeated"))}
    others |= {"clean_incremental", "clean_incremental_audit", "abandonment_curve", "experiment_aa"}
    # Registered over wider windows or repeated attempts only.
    further = {"experiment_retry_readout", "experiment_duplicate_readout"}
    assert set(names) == registered - others | further
    lost = spark.read.parquet(os.path.join(out, "abandonment_by_code.parquet"))
    want = abandonment.abandonment_by_code(tx)
    assert sorted(map(str, lost.collect())) == sorted(map(str, want.collect())) and lost.count() > 0
    k = spark.read.parquet(os.path.join(out, "core_kpis.parquet")).first()
    assert k == kpis.core_kpis(tx, D.error_codes(spark)).first()
    retried = spark.read.parquet(os.path.join(out, "retry_by_category.parquet"))
    want = retries.retry_by_category(tx, D.error_codes(spark))
    assert sorted(map(str, retried.collect())) == sorted(map(str, want.collect()))
    audit = spark.read.json(os.path.join(clean, "data_quality_summary.json")).first()
    assert audit.processed_transaction_count == 1000 and audit.missing_values_imputed == 0
