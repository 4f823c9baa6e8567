"""Report rules at their edges, on small hand-made attempts."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from railpulse import dimensions as D
from railpulse.functions import flags
from railpulse.functions.numbers import percent, rounded
from railpulse.operators import (
    bankhealth,
    banks,
    duplicates,
    experiment,
    failures,
    funnel,
    kpis,
    percentiles,
    retries,
    segments,
    timeprofile,
    users,
)
from railpulse.schemas import TRANSACTIONS
from railpulse.sources.star import StarTables

NOON = datetime(2026, 8, 1, 12, 0, 0)
DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TRANSACTIONS).replace("decimal(18,2)", "string")


def attempt(tid, ts=NOON, user="U1", code="ERR_SUCCESS", amount="100", payer="BNK001", payee="BNK002", kind="P2P"):
    status = D.SUCCESS if code == "ERR_SUCCESS" else D.FAILED
    return (tid, user, payer, payee, str(amount), ts, kind, "D1", "4G", "APP1", status, code)


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL).withColumn("amount", F.col("amount").cast("decimal(18,2)"))


@pytest.fixture(scope="module")
def codes(spark):
    return D.error_codes(spark)


def after(seconds):
    return NOON + timedelta(seconds=seconds)


def test_rounding_follows_binary_values(spark):
    got = spark.range(1).select(
        rounded("1.005D"), rounded("0.125D"), rounded("-0.125D"), rounded("2.5D", 0),
        percent("1", "0"), percent("1", "3", 1),
    ).first()
    assert list(got) == [1.0, 0.13, -0.13, 3.0, None, 33.3]


def test_amount_buckets_leave_gaps_unless_closed(spark):
    amounts = [99.99, 100, 500, 500.5, 501, 2000, 2000.5, 2001, 10000, 10000.01]
    df = spark.createDataFrame([(float(a),) for a in amounts], "a double")
    open_, closed = (
        [r[0][0] for r in df.select(flags.amount_bucket(F.col("a"), c)).collect()] for c in (False, True)
    )
    assert "".join(open_) == "1225335445"
    assert "".join(closed) == "1223334445"


def test_hour_windows_include_both_ends(spark):
    df = spark.createDataFrame([(h,) for h in (0, 1, 5, 6, 11, 12, 14, 15, 18, 19, 21, 22)], "h int")
    got = [r[0][:3] for r in df.select(flags.hour_window(F.col("h"))).collect()]
    assert got == ["Nor", "Off", "Off", "Nor", "Nor", "Aft", "Aft", "Nor", "Nor", "Eve", "Eve", "Nor"]


def test_kpis_of_nothing(spark, codes):
    row = kpis.core_kpis(frame(spark, [attempt("T")]).limit(0), codes).first()
    assert row.total_transactions == 0
    assert row.psr_percentage is None and row.total_value_inr is None


def test_unknown_codes_and_timeouts(spark, codes):
    tx = frame(
        spark,
        [attempt("1"), attempt("2", code="ERR_NET_01"), attempt("3", code="ERR_TD_01"), attempt("4", code="WHAT", amount=40)],
    )
    k = kpis.core_kpis(tx, codes).first()
    # Network errors are technical by type, and the unknown code is in neither.
    assert (k.technical_decline_rate, k.timeout_decline_rate, k.business_decline_rate) == (50.0, 25.0, 0.0)
    unknown = {r.failure_code: r for r in failures.failure_breakdown(tx, codes).collect()}["WHAT"]
    assert (unknown.decline_type, unknown.error_category, unknown.error_description) == (
        "Other", "Unknown", "Unclassified Error",
    )
    assert unknown.failure_rank == 1
    assert ("Unknown", "WHAT", 1) in [tuple(r) for r in failures.failure_reasons(tx, codes).collect()]
    # Recoverable value leaves the unknown failure out of the denominator too.
    assert kpis.recovery_scenarios(tx, codes).first().total_transaction_value_at_risk_inr == 200.0


def test_ranks_share_ties(spark, codes):
    tx = frame(spark, [attempt(str(i), code=c) for i, c in enumerate(["ERR_TD_01"] * 3 + ["ERR_TD_02"] * 3 + ["ERR_BD_01"])])
    assert [r.failure_rank for r in failures.failure_breakdown(tx, codes).collect()] == [1, 1, 2]


def test_retry_window_and_tolerance_are_inclusive(spark, codes):
    def retried(gap, first, second):
        tx = frame(
            spark,
            [attempt("a", code="ERR_TD_01", amount=first), attempt("b", ts=after(gap), amount=second)],
        )
        return retries.retry_attempts(tx).count()

    assert retried(900, 100, 100) == 1
    assert retried(900.5, 100, 100) == 0
    assert retried(10, 100, 110) == 1
    assert retried(10, 100, "110.01") == 0
    assert retried(10, "0.30", "0.33") == 1  # exact decimals, no binary fuzz


def test_only_the_next_attempt_counts(spark, codes):
    tx = frame(
        spark,
        [
            attempt("a", code="ERR_TD_01"),
            attempt("b", ts=after(5), amount=999),
            attempt("c", ts=after(6)),
            attempt("d", ts=after(7), user="U2"),
        ],
    )
    assert retries.retry_attempts(tx).count() == 0


def test_policy_order(spark, codes):
    rows = []
    for user, code, ok in [("1", "ERR_TD_01", True), ("2", "ERR_TD_02", False), ("3", "ERR_BD_02", True), ("4", "ERR_BD_05", True)]:
        rows.append(attempt("f" + user, user=user, code=code))
        rows.append(attempt("r" + user, user=user, ts=after(9), code="ERR_SUCCESS" if ok else "ERR_TD_03"))
    got = {r.error_code: r.product_retry_policy for r in retries.retry_policy(frame(spark, rows), codes).collect()}
    assert got["ERR_TD_01"] == D.AUTO_RETRY
    assert got["ERR_TD_02"] == got["ERR_BD_05"] == D.MANUAL_RETRY
    assert got["ERR_BD_02"] == D.NO_RETRY


def test_retries_with_a_hot_user(spark, codes):
    rng = random.Random(3)
    rows = [
        attempt(f"T{i:04d}", user="hot" if i % 3 else f"U{i % 50}", ts=after(rng.randrange(30_000)),
                code=rng.choice(["ERR_SUCCESS", "ERR_TD_01", "ERR_NET_01"]))
        for i in range(1500)
    ]
    tx = frame(spark, rows)
    whole = retries.retry_policy(tx, codes).collect()
    assert whole and retries.retry_policy(tx, codes, hot_rows=20).collect() == whole


def test_duplicates(spark):
    tx = frame(
        spark,
        [attempt("a"), attempt("b", ts=after(180)), attempt("c", ts=after(361)), attempt("d", ts=after(5), amount=101)],
    )
    got = duplicates.duplicate_attempts(tx).collect()
    assert [(r.transaction_id, r.previous_transaction_id, r.gap_seconds) for r in got] == [("b", "a", 180.0)]
    rate = duplicates.duplicate_payment_rate(tx).first()
    assert (rate.completed_payments, rate.duplicate_payments, rate.duplicate_payment_rate) == (4, 1, 25.0)
    locked = duplicates.lock_windows(tx, "10 minutes").collect()
    assert [(r.attempts, r.locked_attempts, r.accepted_at) for r in locked] == [(3, 2, NOON)]


def test_funnel_counts_ids_entering_and_rows_failing(spark):
    stages = spark.createDataFrame(
        [("A", 1, "SUCCESS"), ("A", 1, "SUCCESS"), ("B", 1, "FAILED"), ("B", 1, "FAILED"), ("A", 3, "SUCCESS"), ("A", 9, "FAILED")],
        "transaction_id string, stage_id int, stage_status string",
    )
    tx = spark.createDataFrame([("A",), ("B",), ("B",), ("C",), ("D",)], "transaction_id string")
    names = D.stage_names(spark)
    got = [tuple(r) for r in funnel.funnel(stages, tx, names).collect()]
    assert got == [
        ("1. INITIATED", 1, 2, 2, 50.0, 100.0, None),
        ("3. AUTHENTICATION", 3, 1, 0, 25.0, 0.0, 1),
    ]
    assert funnel.funnel(stages, tx, names, unique_ids=True).first().overall_conversion_pct == 40.0
    assert [tuple(r) for r in funnel.funnel_volume(stages, names).collect()] == [("1. INITIATED", 2), ("3. AUTHENTICATION", 1)]


def test_stage_latency_and_completion(spark):
    rows = [("A", s, NOON + timedelta(milliseconds=250 * s * s), "SUCCESS") for s in range(1, 8)]
    rows += [("B", 1, NOON, "SUCCESS"), ("B", 2, after(4), "FAILED"), ("B", 2, after(9), "FAILED")]
    stages = spark.createDataFrame(
        rows, "transaction_id string, stage_id int, event_timestamp timestamp_ntz, stage_status string"
    )
    got = {r.stage_id: r for r in funnel.stage_latency(stages, D.stage_names(spark)).collect()}
    assert (got[2].steps, got[2].mean_seconds, got[2].p50_seconds, got[2].p95_seconds) == (2, 2.375, 0.75, 4.0)
    assert got[7].mean_seconds == 3.25 and got[7].slowness_rank == 1
    done = funnel.completion_time(stages, D.stage_names(spark)).first()
    assert (done.completed_transactions, done.mean_seconds, done.max_seconds) == (1, 12.0, 12.0)


@pytest.mark.parametrize("bin_width", [1, 7, 1000])
def test_percentiles_equal_a_full_sort(spark, bin_width):
    rng = random.Random(5)
    rows = [(g, int(rng.gauss(0, 50)) if rng.random() < 0.6 else 3) for g in "abc" for _ in range(331)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    points = {"low": 0.01, "mid": 0.5, "high": 0.95, "top": 1.0}
    got = {r.g: r for r in percentiles.exact_percentiles(df, ["g"], "v", points, bin_width).collect()}
    for g in "abc":
        values = sorted(v for k, v in rows if k == g)
        for name, p in points.items():
            place = -int(-p * len(values) // 1)
            assert got[g][name] == values[max(place, 1) - 1]


def test_top_k_is_settled_by_names(spark):
    rows = [attempt(f"{b}{i}", payee=b, code="ERR_TD_01") for b in ("BNK003", "BNK002", "BNK004") for i in range(2)]
    got = banks.bank_pair_matrix(frame(spark, rows), D.banks(spark), min_volume=2, k=2).collect()
    assert [r.payee_bank for r in got] == ["Axis Bank", "HDFC Bank"]


def test_ranking_follows_unrounded_rates(spark, codes):
    rows = [attempt(f"a{i}", code="ERR_TD_01" if i < 10 else "ERR_SUCCESS") for i in range(30)]
    rows += [attempt(f"b{i}", payer="BNK002", code="ERR_TD_01" if i < 10 else "ERR_SUCCESS") for i in range(30)]
    rows += [attempt("c", payer="BNK003", code="ERR_BD_01")]
    got = banks.payer_bank_ranking(frame(spark, rows), D.banks(spark), codes, min_volume=30).collect()
    assert [(r.payer_bank_name, r.reliability_rank_asc) for r in got] == [("HDFC Bank", 1), ("State Bank of India", 1)]


def test_users_without_attempts_are_not_counted(spark):
    people = spark.createDataFrame(
        [("U1", "New", "Delhi", "18-24", 10), ("U2", "New", "Delhi", "18-24", 400)],
        "user_id string, user_segment string, state string, age_group string, tenure_days int",
    )
    tx = frame(spark, [attempt(str(i), code="ERR_TD_01") for i in range(3)] + [attempt("x", user="ghost")])
    row = users.segment_friction(people, tx).first()
    assert (row.total_users_in_segment, row.segment_txn_volume, row.users_with_3plus_failures) == (1, 3, 1)
    assert users.impacted_power_users(tx, people, min_txn=3).count() == 1
    assert users.impacted_power_users(tx, people).count() == 0
    assert [r.tenure_band for r in users.tenure_friction(people, tx).collect()] == [0]


def test_rolling_rate_does_not_stretch_over_empty_hours(spark):
    tx = frame(spark, [attempt("a", code="ERR_TD_01"), attempt("b", ts=after(2 * 3600)), attempt("c", ts=after(3 * 3600))])
    got = [(r.rolling_txns, r.rolling_failures) for r in timeprofile.rolling_failure_rate(tx).collect()]
    assert got == [(1, 1), (2, 1), (2, 0)]


def test_limits(spark, codes):
    tx = frame(spark, [attempt(str(i)) for i in range(99)] + [attempt("x", code="ERR_TD_01")])
    core = kpis.core_kpis(tx, codes)
    metrics = kpis.kill_switch_metrics(core, duplicates.duplicate_payment_rate(tx))
    assert [r.metric for r in kpis.limit_breaches(metrics).collect()] == ["duplicate_payment_rate"]
    # A limit that cannot be checked is shown, not skipped.
    assert [tuple(r)[:2] for r in kpis.limit_breaches(core).collect()] == [("duplicate_payment_rate", None)]
    tx = tx.unionByName(frame(spark, [attempt("y", code="ERR_TD_01")]))
    assert kpis.limit_breaches(kpis.core_kpis(tx, codes)).first().metric == "technical_decline_rate"
    rate = duplicates.duplicate_payment_rate(frame(spark, [attempt("a"), attempt("b", ts=after(1))]))
    breaches = {r.metric: r.observed for r in kpis.limit_breaches(rate).collect()}
    assert breaches == {"technical_decline_rate": None, "duplicate_payment_rate": 50.0}


def test_variants_are_stable_and_even(spark):
    df = experiment.assign_variants(spark.range(4000).withColumnRenamed("id", "user_id"))
    n = df.filter(F.col("variant") == experiment.TREATMENT).count()
    assert 1850 < n < 2150
    other = experiment.assign_variants(spark.range(4000).withColumnRenamed("id", "user_id"), salt="other")
    assert df.join(other.withColumnRenamed("variant", "v2"), "user_id").filter("variant = v2").count() < 2300


def test_readout_of_one_variant_only(spark):
    row = experiment.experiment_readout(frame(spark, [attempt("a")])).first()
    assert row.z_value is None and row.significant_at_5pct is None


def test_alert_is_strictly_below(spark):
    rows = [attempt(str(i), code="ERR_TD_01" if i < 3 else "ERR_SUCCESS") for i in range(25)]
    health = bankhealth.rolling_bank_health(frame(spark, rows)).collect()
    assert len(health) == 5 and all(r.rolling_psr == 88.0 and not r.alert for r in health)


class TestInvariants:
    """Totals that must agree between reports over the shared tables."""

    @pytest.fixture(scope="class")
    def star(self, spark):
        return StarTables(spark, "/root/testdata/sf0.01")

    def test_rates_sum_to_one_hundred(self, star, codes):
        k = kpis.core_kpis(star.transactions(), codes).first()
        assert abs(k.psr_percentage + k.failure_rate_percentage - 100) <= 0.01
        assert k.total_transactions == 10_000

    def test_shares_sum_to_one_hundred(self, star, codes):
        rows = failures.failure_breakdown(star.transactions(), codes).collect()
        assert abs(sum(r.pct_contribution_to_failures for r in rows) - 100) < 0.1
        top = failures.failure_rollup(star.transactions(), codes).filter("grouping_level = 7").first()
        assert top.failure_count == sum(r.failure_count for r in rows) == 2_014

    def test_every_breakdown_has_all_attempts(self, star, codes):
        tx = star.transactions()
        assert segments.type_amount_matrix(tx).agg(F.sum("transaction_volume")).first()[0] == 10_000
        assert timeprofile.hourly_profile(tx).agg(F.sum("total_txns")).first()[0] == 10_000
        assert kpis.status_breakdown(tx).agg(F.sum("count")).first()[0] == 10_000

    def test_audit_adds_up(self, star):
        from railpulse.operators import cleaning, quality

        raw = star.raw_transactions()
        a = quality.dq_audit_summary(raw).first()
        assert a.raw_transaction_count == 60_000
        assert (
            a.duplicate_transactions_removed + a.invalid_amounts_dropped + a.processed_transaction_count
            == a.raw_transaction_count
        )
        clean = cleaning.clean_transactions(raw)
        assert clean.count() == clean.select("transaction_id").distinct().count() == a.processed_transaction_count

    def test_dimensions_are_broadcast_by_size(self, star, codes):
        plan = kpis.core_kpis(star.transactions(), codes)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan


def test_mean_amount_leaves_out_unknown_amounts(spark):
    rows = [(i, NOON, a, "SUCCESS", "ERR_SUCCESS") for i, a in enumerate([Decimal(10), None, Decimal(20)])]
    tx = spark.createDataFrame(
        rows, "transaction_id long, timestamp timestamp_ntz, amount decimal(18,2), final_status string, failure_code string"
    )
    assert kpis.core_kpis(tx, D.error_codes(spark)).first().avg_txn_amount_inr == 15.0


def test_completion_needs_a_success_and_sums_beyond_bigint(spark):
    stages = spark.range(40_000).selectExpr(
        "id as transaction_id", "explode(array(1, 7)) as stage_id", "id % 4 = 0 as bad"
    ).selectExpr(
        "transaction_id", "stage_id", "case when bad then 'FAILED' else 'SUCCESS' end as stage_status",
        "timestamp_ntz'1600-01-01' + case when stage_id = 7 then interval '400' year else interval '0' year end as event_timestamp",
    )
    done = funnel.completion_time(stages, D.stage_names(spark)).first()
    assert done.completed_transactions == 30_000 and done.mean_seconds == done.max_seconds > 1.2e10


def test_the_last_named_stage_completes(spark):
    rows = [("A", s, after(s), "SUCCESS") for s in (1, 7, 8)] + [("B", 1, NOON, "SUCCESS"), ("B", 7, after(9), "SUCCESS")]
    stages = spark.createDataFrame(rows, "transaction_id string, stage_id int, event_timestamp timestamp_ntz, stage_status string")
    names = D.stage_names(spark)
    assert funnel.completion_time(stages, names).first().completed_transactions == 2
    more = names.union(spark.createDataFrame([(8, "8. SETTLED")], names.schema))
    done = funnel.completion_time(stages, more).first()
    assert (done.completed_transactions, done.mean_seconds) == (1, 7.0)
    assert funnel.completion_time(stages, names.limit(0)).first().completed_transactions == 0
    many = spark.range(64).selectExpr("cast(id as int) as stage_id", "'s' as stage_name")
    with pytest.raises(ValueError):
        funnel.funnel_volume(stages, many)


def test_a_further_stage_and_bank_are_shown(spark):
    stages = spark.createDataFrame([(1, 8, "SUCCESS"), (2, 8, "FAILED")], "transaction_id long, stage_id int, stage_status string")
    names = spark.createDataFrame([(8, "8. REFUND")], "stage_id int, stage_name string")
    assert [tuple(r) for r in funnel.funnel_volume(stages, names).collect()] == [("8. REFUND", 2)]
