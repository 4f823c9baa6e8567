"""Retry episodes, payer and payee effects, stored latency sketches."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from railpulse import dimensions as D
from railpulse.operators import bankeffects, funnel, retries
from railpulse.operators.neighbours import with_island

START = datetime(2024, 5, 1)
SCHEMA = "user_id string, transaction_id string, timestamp timestamp_ntz, final_status string, failure_code string"


def attempt(user, tid, second, status="FAILED", code="ERR_TD_01"):
    return (user, tid, None if second is None else START + timedelta(seconds=second), status, code)


def episodes(spark, rows, **options):
    found = retries.retry_episodes(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()
    return {(r.user_id, r.first_transaction_id): (r.last_transaction_id, r.attempts, r.micros // 1_000_000, r.outcome) for r in found}


def test_episode_edges(spark):
    rows = [
        attempt("a", "1", 0), attempt("a", "2", 900), attempt("a", "3", 1_800, "SUCCESS"),  # exactly the window
        attempt("a", "4", 1_801, "SUCCESS"),  # no failure, no episode
        attempt("b", "1", 0), attempt("b", "2", 901, "SUCCESS"),  # a microsecond or more too late
        attempt("c", "1", 5), attempt("c", "2", 5, "SUCCESS"),  # ties go by id
        attempt("d", "1", 0), attempt("d", "2", 10, None), attempt("d", "3", 20),  # unknown status ends it
        attempt("e", "1", 9_500),  # the data end at 10,000
        attempt("f", "1", 9_100),
        attempt(None, "1", 0), attempt("g", "1", None),
        attempt("z", "1", 10_000, "SUCCESS"),
    ]
    assert episodes(spark, rows) == {
        ("a", "1"): ("3", 3, 1_800, "RECOVERED"),
        ("b", "1"): ("1", 1, 0, "ABANDONED"),
        ("c", "1"): ("2", 2, 0, "RECOVERED"),
        ("d", "1"): ("2", 2, 10, "UNKNOWN"),
        ("d", "3"): ("3", 1, 0, "ABANDONED"),
        ("e", "1"): ("1", 1, 0, "OPEN"),
        ("f", "1"): ("1", 1, 0, "ABANDONED"),
    }
    assert episodes(spark, []) == {}


def plain_episodes(rows, window_s):
    """Walking each user's attempts in order."""
    end, found = max(r[2] for r in rows), {}
    window = timedelta(seconds=window_s)
    by_user = {}
    for row in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[2], r[1])):
        by_user.setdefault(row[0], []).append(row)
    for user, mine in by_user.items():
        current = []
        for row in [*mine, None]:
            goes_on = row is not None and current and current[-1][3] == "FAILED" and row[2] - current[-1][2] <= window
            if not goes_on:
                if current and current[0][3] == "FAILED":
                    last = current[-1]
                    outcome = "RECOVERED" if last[3] == "SUCCESS" else "UNKNOWN" if last[3] is None else "ABANDONED" if end - last[2] >= window else "OPEN"
                    found[user, current[0][1]] = (last[1], len(current), int((last[2] - current[0][2]).total_seconds()), outcome)
                current = []
            if row is not None:
                current.append(row)
    return found


@pytest.mark.parametrize("hot_rows", [3, 20, 10**9])
def test_episodes_of_hot_users_cross_slices(spark, hot_rows):
    """One user holds a third of all attempts, nearly all failed, in episodes over many minutes."""
    rng = random.Random(5)
    rows = []
    for i in range(700):
        hot = rng.random() < 0.35
        user = "hot" if hot else rng.choice([f"u{j}" for j in range(40)] + [None])
        second = rng.randrange(20_000) if hot else rng.randrange(30_000)
        status = rng.choices(["FAILED", "SUCCESS", None], [0.9, 0.09, 0.01] if hot else [0.6, 0.35, 0.05])[0]
        rows.append(attempt(user, f"T{i:04d}", second, status))
    want = plain_episodes(rows, 300)
    assert max(n for (u, _), (_, n, _, _) in want.items() if u == "hot") > 20
    assert episodes(spark, rows, window_s=300, hot_rows=hot_rows) == want


@pytest.mark.parametrize("hot_rows", [4, 10**9])
def test_islands_equal_one_window(spark, hot_rows):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "x", "y", None]), i, START + timedelta(seconds=rng.randrange(900)), rng.randrange(30)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id int, t timestamp_ntz, v int")
    got = with_island(df, ["k"], "t", "id", ["v"], F.col("v") == 0, hot_rows)
    upto = Window.partitionBy("k").orderBy("t", "id")
    start = F.when(F.col("v") == 0, F.struct(F.col("t").alias("at"), "id"))
    want = df.filter("k is not null").withColumn("previous_v", F.lag("v").over(upto)).withColumn(
        "island", F.last(start, ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    )
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_episodes_without_hot_users_are_one_shuffle_of_attempts(spark):
    rows = [attempt(f"u{i % 50}", f"T{i:04d}", i * 7, "FAILED" if i % 3 else "SUCCESS") for i in range(500)]
    df = retries.retry_episodes(spark.createDataFrame(rows, SCHEMA), watched=spark.createDataFrame(rows[-1:], SCHEMA))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().executedPlan().toString()  # as it was run
    assert "Union" not in plan and "Join" not in plan
    assert plan.count("Window [") == 2 and plan.count("Exchange hashpartitioning") == 2


def pair_attempts(spark, payer_points, payee_points, each=4_000):
    """Attempts of pairs, each payer mostly with the payee of its own number."""
    cells = []
    for p, a in enumerate(payer_points):
        for q, b in enumerate(payee_points):
            n = each * (8 if p == q else 1)
            cells.append((f"BNK00{p + 1}", f"BNK00{q + 1}", n, round(n * (0.05 + a + b))))
    df = spark.createDataFrame(cells, "payer_bank_id string, payee_bank_id string, n int, bad int")
    rows = df.select("payer_bank_id", "payee_bank_id", F.explode(F.expr("sequence(1, n)")).alias("i"), "bad")
    is_bad = F.col("i") <= F.col("bad")
    return rows.select(
        "payer_bank_id", "payee_bank_id", F.lit(1).cast("decimal(18,2)").alias("amount"),
        F.when(is_bad, "ERR_TD_01").otherwise("ERR_SUCCESS").alias("failure_code"),
        F.when(is_bad, D.FAILED).otherwise(D.SUCCESS).alias("final_status"),
    )


def test_planted_payer_effects_leave_payees_at_zero(spark):
    """Payees that deal mostly with a bad payer look bad by their own rate; the fit clears them."""
    payers = [0.06, 0.0, -0.02, 0.01]
    tx = pair_attempts(spark, payers, [0.0] * 4)
    rows = bankeffects.bank_effects(tx, D.banks(spark), D.error_codes(spark), tolerance=1e-8).collect()
    mean = np.mean(payers)  # every payer has as many attempts
    for r in rows:
        i = int(r.bank_id[-1]) - 1
        if r.bank_role == "payer":
            assert r.effect_points == pytest.approx(100 * (payers[i] - mean), abs=0.02)
            assert r.declines_from_effect == pytest.approx(r.total_volume * (payers[i] - mean), abs=10)
        else:
            assert r.effect_points == pytest.approx(0, abs=0.02)
    assert max(abs(r.raw_points) for r in rows if r.bank_role == "payee") > 2
    assert {r.bank_role: round(r.role_spread_pct) for r in rows} == {"payer": 100, "payee": 0}


def test_both_roles_equal_weighted_least_squares(spark):
    rng = np.random.default_rng(3)
    cells = [(f"p{i}", f"q{j}", int(rng.integers(1, 200)), 0) for i in range(5) for j in range(4) if (i + j) % 4]
    cells = [(p, q, n, int(rng.integers(0, n + 1))) for p, q, n, _ in cells]
    fit = bankeffects.alternate_until(
        spark.createDataFrame(cells, "p string, q string, weight int, total int"), "p", "q", 1e-12, rounds=10
    ).collect()
    n, d = (np.array([c[k] for c in cells], dtype=float) for k in (2, 3))
    overall = d.sum() / n.sum()
    design = np.array([[c[0] == f"p{i}" for i in range(5)] + [c[1] == f"q{j}" for j in range(4)] for c in cells], dtype=float)
    root = np.sqrt(n)[:, None]
    best = np.linalg.lstsq(design * root, (d / n - overall) * root[:, 0], rcond=None)[0]
    predicted = dict(zip([(c[0], c[1]) for c in cells], design @ best))
    for r in fit:
        assert r.row_effect + r.column_effect == pytest.approx(predicted[r.p, r.q], abs=1e-8)
    seen = {r.p: (r.row_effect, sum(c[2] for c in cells if c[0] == r.p)) for r in fit}
    assert sum(e * w for e, w in seen.values()) == pytest.approx(0, abs=1e-6)


def test_effects_of_nothing_and_of_unknown_banks(spark):
    banks, codes = D.banks(spark), D.error_codes(spark)
    tx = pair_attempts(spark, [0.0], [0.0], each=20)
    assert bankeffects.bank_effects(tx.limit(0), banks, codes).collect() == []
    unknown = tx.withColumn("payee_bank_id", F.lit(None).cast("string"))
    rows = bankeffects.bank_effects(unknown, banks, codes).collect()
    assert sorted((r.bank_role, r.bank_id, r.bank_name, r.effect_points) for r in rows if r.bank_role == "payee") == [("payee", None, None, 0.0)]


def test_too_few_rounds_are_told(spark):
    cells = spark.createDataFrame([("a", "x", 9, 1), ("a", "y", 1, 1), ("b", "x", 1, 0), ("b", "y", 9, 9)], "p string, q string, weight int, total int")
    with pytest.raises(ValueError, match="still move"):
        bankeffects.alternate_until(cells, "p", "q", 1e-12, rounds=1, most_rounds=1)


def stage_rows(spark, payments=6_000):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(payments):
        at = START + timedelta(seconds=float(rng.uniform(0, 10 * 86_400)))
        for stage in (1, 2, 3):
            rows.append((i, stage, at))
            at += timedelta(microseconds=int(rng.exponential(2e6) if stage == 1 else rng.choice([5, 7, 40]) * 1_000_000))
    return spark.createDataFrame(rows, "transaction_id int, stage_id int, event_timestamp timestamp_ntz").withColumn("stage_status", F.lit("SUCCESS"))


def test_merged_sketches_hold_their_bound(spark, tmp_path):
    stages, names = stage_rows(spark), D.stage_names(spark)
    points = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    path = str(tmp_path / "sketches")
    funnel.latency_sketches(stages, names).write.parquet(path)
    stored = spark.read.parquet(path)
    whole = funnel.latency_from_sketches(stored, names, points=points)
    steps = funnel.stage_steps(stages, names)
    errors = funnel.sketch_errors(steps, whole, points).collect()
    assert len(errors) == 2 * 4 and max(r.rank_error for r in errors) <= funnel.SKETCH_ERROR
    exact = {r.stage_id: r for r in funnel.stage_latency(stages, names).collect()}
    for r in whole.collect():
        assert (r.steps, r.mean_seconds) == (exact[r.stage_id].steps, exact[r.stage_id].mean_seconds)
    # Any period, from the stored rows alone.
    first, last = "2024-05-03", "2024-05-05"
    part = funnel.latency_from_sketches(stored, names, first, last)
    assert "sketches" in part._jdf.queryExecution().executedPlan().toString()
    inside = steps.filter(F.col("day").between(first, last))
    assert {r.stage_id: r.steps for r in part.collect()} == {r.reached_stage: r["count"] for r in inside.groupBy("reached_stage").count().collect()}
    assert all(r.days == 3 for r in part.collect())
    assert max(r.rank_error for r in funnel.sketch_errors(inside, part).collect()) <= funnel.SKETCH_ERROR


def test_sketches_of_nothing(spark):
    names = D.stage_names(spark)
    none = funnel.latency_sketches(stage_rows(spark, 3).limit(0), names)
    assert none.collect() == [] and funnel.latency_from_sketches(none, names).collect() == []
