"""Experiment readouts with users as units, and abandonment with censoring, against plain versions."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from railpulse import dimensions as D
from railpulse.operators import abandonment, experiment, kpis

START = datetime(2024, 3, 1)
SCHEMA = (
    "transaction_id string, user_id string, payee_bank_id string, amount string, timestamp timestamp_ntz, "
    "final_status string, failure_code string"
)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("amount", F.col("amount").cast("decimal(18,2)")).repartition(3)


def attempt(tid, user, second, ok=True, code="ERR_TD_01", amount="10"):
    return (tid, user, "P", amount, START + timedelta(seconds=second), "SUCCESS" if ok else "FAILED", "ERR_SUCCESS" if ok else code)


def all_or_nothing(spark, users, seed):
    """Users of whom each succeeds always or never, with 1 to 40 attempts."""
    rng = random.Random(seed)
    rows = [(f"u{u}", rng.randint(1, 40), rng.random() < 0.8) for u in range(users)]
    df = spark.createDataFrame(rows, "user_id string, n int, ok boolean")
    return df.select("user_id", F.explode(F.expr("sequence(1, n)")), F.when(F.col("ok"), D.SUCCESS).otherwise(D.FAILED).alias("final_status"))


@pytest.mark.parametrize("users", [40, 2_000])
def test_no_effect_is_seldom_significant(spark, users):
    rows = experiment.aa_readouts(all_or_nothing(spark, users, users)).collect()
    assert len(rows) == 200
    assert sum(r.significant_at_5pct for r in rows) / 200 <= (0.07 if users > 1_000 else 0.12)
    assert all(r.design_effect > 5 for r in rows)  # attempts are far from independent
    assert np.std([r.z_value for r in rows]) == pytest.approx(1.0, abs=0.1 if users > 1_000 else 0.3)


def test_readout_equals_the_delta_method(spark):
    rng = random.Random(2)
    rows = [attempt(f"t{i}", rng.choice([*"abcdefghijklmnopq", None]), i, rng.random() < 0.7) for i in range(300)]
    got = experiment.experiment_readout(frame(spark, rows)).first()
    users = {}
    for _, u, _, _, _, status, _ in rows:
        if u is not None:
            n, ok = users.get(u, (0, 0))
            users[u] = (n + 1, ok + (status == "SUCCESS"))
    variant = {r.user_id: r.variant for r in experiment.assign_variants(spark.createDataFrame([(u,) for u in users], "user_id string")).collect()}
    rate, var = {}, {}
    for v in ("control", "treatment"):
        mine = np.array([users[u] for u in users if variant[u] == v], dtype=float)
        rate[v] = mine[:, 1].sum() / mine[:, 0].sum()
        left = mine[:, 1] - rate[v] * mine[:, 0]
        var[v] = len(mine) / (len(mine) - 1) * (left**2).sum() / mine[:, 0].sum() ** 2
        assert got[f"{v}_users"] == len(mine) and got[f"{v}_txns"] == mine[:, 0].sum()
    error = math.sqrt(var["control"] + var["treatment"])
    lift = rate["treatment"] - rate["control"]
    assert got.z_value == pytest.approx(lift / error, abs=1e-4)
    assert got.low_points == pytest.approx(100 * (lift - 1.959964 * error), abs=1e-3)
    assert got.detectable_points == pytest.approx(100 * 2.801585 * error, abs=1e-3)
    assert got.significant_at_5pct == (abs(lift / error) > 1.959964)


def test_readouts_without_enough_users(spark):
    none = frame(spark, []).limit(0)
    for df in (experiment.experiment_readout(none), experiment.retry_readout(none), experiment.duplicate_readout(none)):
        row = df.first()
        assert row.control_users == row.treatment_users == 0 and row.z_value is None and row.significant_at_5pct is None
    one = experiment.experiment_readout(frame(spark, [attempt("a", "u", 0), attempt("b", None, 0)])).first()
    assert one.control_txns + one.treatment_txns == 1 and one.standard_error_points is None
    assert experiment.aa_readouts(none).count() == 0


def test_a_planted_effect_is_found(spark):
    users = [f"u{i}" for i in range(3_000)]
    variant = {r.user_id: r.variant for r in experiment.assign_variants(spark.createDataFrame([(u,) for u in users], "user_id string")).collect()}
    rng = random.Random(5)
    rows = [attempt(f"{u}-{k}", u, k, rng.random() < (0.85 if variant[u] == "treatment" else 0.80)) for u in users for k in range(3)]
    got = experiment.experiment_readout(frame(spark, rows)).first()
    assert got.significant_at_5pct and got.low_points < 5 < got.high_points and got.detectable_points < 5


def brute_curve(times, last):
    """Kaplan-Meier over (step, returned) pairs, and Greenwood's error."""
    away, spread, out = 1.0, 0.0, {}
    for step in sorted({s for s, _ in times}):
        n = sum(s >= step for s, _ in times)
        d = sum(s == step and back for s, back in times)
        away *= 1 - d / n
        spread += d / (n * (n - d)) if d < n else 0.0
        out[step] = (n, d, away, away * math.sqrt(spread))
    return out


@pytest.mark.parametrize("hot_rows", [5_000_000, 20])
def test_abandonment_equals_kaplan_meier(spark, hot_rows):
    rng = random.Random(8)
    rows = []
    for u in range(60):
        t = rng.uniform(0, 12_000)
        for k in range(rng.randint(1, 12)):
            t += rng.expovariate(1 / rng.choice([20, 300, 5_000]))
            if t > 12_000:  # the data end
                break
            rows.append(attempt(f"{u}-{k}", f"u{u}" if u % 9 else "hot", t, rng.random() < 0.4, rng.choice(["ERR_TD_01", "ERR_BD_01"])))
    rows.append((*attempt("x", "u1", 0, False)[:4], None, "FAILED", "ERR_TD_01"))
    rows.append(attempt("y", None, 100, False))
    end = max(r[4] for r in rows if r[4])
    horizon, grid = 3_600, 30
    last, times = horizon // grid, {}
    by_user = {}
    for r in sorted((r for r in rows if r[4] and r[1]), key=lambda r: (r[4], r[0])):
        by_user.setdefault(r[1], []).append(r)
    for mine in by_user.values():
        for r, following in zip(mine, [*mine[1:], None]):
            if r[5] == "FAILED":
                gap = math.ceil((following[4] - r[4]) / timedelta(seconds=grid)) if following else None
                back = gap is not None and gap <= last
                step = gap if back else min((end - r[4]) // timedelta(seconds=grid), last)
                times.setdefault(r[6], []).append((step, back))
    d = frame(spark, rows)
    steps = abandonment.failure_steps(d, "failure_code", horizon_s=horizon, grid_s=grid, hot_rows=hot_rows)
    got = {(r.failure_code, r.step): r for r in abandonment.return_curve(steps, ["failure_code"], grid).collect()}
    want = {(code, step): v for code, t in times.items() for step, v in brute_curve(t, last).items()}
    assert got.keys() == want.keys()
    for key, (n, back, away, error) in want.items():
        r = got[key]
        assert (r.at_risk, r.returned) == (n, back) and r.away == pytest.approx(away) and r.standard_error == pytest.approx(error)
    for r in abandonment.abandonment_by_code(d, horizon, grid, hot_rows).collect():
        mine = times[r.failure_code]
        assert r.failures == len(mine) and r.watched_less == sum(not b and s < last for s, b in mine) > 0
        assert r.abandonment_pct == pytest.approx(100 * brute_curve(mine, last)[max(s for s, _ in mine)][2], abs=1e-4)
        assert r.unadjusted_pct == pytest.approx(100 * sum(not b for _, b in mine) / len(mine), abs=1e-4)


def test_failures_at_the_end_are_not_taken_for_lost(spark):
    """Everyone comes back after 100 s; nobody had the time to after the last failure."""
    rows = [attempt(f"a{u}", f"u{u}", 10 * u, False) for u in range(50)] + [attempt(f"b{u}", f"u{u}", 10 * u + 100) for u in range(45)]
    row = abandonment.abandonment_by_code(frame(spark, rows), 3_600, 10).first()
    assert (row.failures, row.returned, row.watched_less) == (50, 45, 5)
    assert row.abandonment_pct == 0.0 and row.unadjusted_pct == 10.0 and row.median_return_seconds == 100.0


def test_rollback_triggers(spark):
    users = [r.user_id for r in experiment.assign_variants(spark.range(400).selectExpr("cast(id as string) as user_id")).filter("variant = 'treatment'").collect()]
    others = [str(i) for i in range(400) if str(i) not in set(users)]
    rows = [attempt(f"f{u}", u, i, False) for i, u in enumerate(users + others)]
    rows += [attempt(f"r{u}", u, 500 + i) for i, u in enumerate(others)] + [attempt("z", "z", 200_000)]
    by_variant = abandonment.abandonment_by_variant(frame(spark, rows))
    rate = spark.createDataFrame([(0.0,)], "duplicate_payment_rate double")
    got = kpis.limit_breaches(abandonment.rollback_metrics(rate, by_variant), D.ROLLBACK_LIMITS).collect()
    assert [(r.metric, r.observed) for r in got] == [("dropoff_increase", 100.0)]
    empty = abandonment.abandonment_by_variant(frame(spark, []).limit(0))
    assert empty.count() == 0 and abandonment.dropoff_increase(empty).first()[0] is None
