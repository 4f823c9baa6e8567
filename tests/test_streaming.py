"""Streams against their batch forms and against brute force."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from railpulse.operators import bankhealth, duplicates
from railpulse.streaming import followups, keyed_locks, locks, runs

START = datetime(2024, 1, 1)
SCHEMA = (
    "transaction_id string, user_id string, payer_bank_id string, payee_bank_id string, amount decimal(10,2), "
    "timestamp timestamp_ntz, final_status string"
)


def make_rows(n=400, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if rng.random() < 0.4 else f"u{rng.randrange(6)}"
        ts = START + timedelta(seconds=rng.randrange(6000), microseconds=rng.randrange(3) * 333_333)
        rows.append((f"T{i:04d}", user, f"BNK00{1 + i % 3}", "P", rng.choice(["1.00", "2.00"]), ts,
                     rng.choice(["SUCCESS", "FAILED"])))
    return rows


def as_frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("decimal(10,2)", "string")).withColumn(
        "amount", F.col("amount").cast("decimal(10,2)")
    )


@pytest.fixture
def attempts(spark, tmp_path):
    """The rows as one frame and as a stream of four micro-batches in time order."""
    rows = sorted(make_rows(), key=lambda r: r[5])
    folder = str(tmp_path / "in")
    for part in range(4):
        as_frame(spark, rows[part * 100 : part * 100 + 100]).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return rows, as_frame(spark, rows), stream


def test_bank_health_stream_equals_batch_on_closed_windows(spark, attempts):
    rows, batch, stream = attempts
    delay = timedelta(minutes=10)
    got = runs.drain_to_parquet(
        spark, bankhealth.rolling_bank_health(stream, watermark="10 minutes"), "test-health"
    )
    horizon = max(r[5] for r in rows) - delay
    horizon = horizon.replace(microsecond=horizon.microsecond // 1000 * 1000)
    want = bankhealth.rolling_bank_health(batch).filter(F.col("window_end") <= F.lit(horizon).cast("timestamp_ntz"))
    assert got.exceptAll(want).count() == 0
    assert want.exceptAll(got).count() == 0 and got.count() > 100


def test_lock_windows_stream_equals_batch_on_closed_windows(spark, attempts):
    rows, batch, stream = attempts
    got = runs.drain_to_parquet(spark, duplicates.lock_windows(stream, watermark="1 minute"), "test-windows")
    want = duplicates.lock_windows(batch)
    assert got.exceptAll(want).count() == 0
    last = max(r[5] for r in rows)
    closed = want.filter(F.col("lock_start") < F.lit(last - timedelta(minutes=5)).cast("timestamp_ntz"))
    assert closed.exceptAll(got).count() == 0 and got.count() > 5


def brute_force(rows, window_s):
    held, accepted = {}, {}
    for tid, user, _, payee, amount, ts, _ in sorted(rows, key=lambda r: (r[5], r[0])):
        last = held.get((user, payee, amount))
        accepted[tid] = last is None or ts > last + timedelta(seconds=window_s)
        if accepted[tid]:
            held[(user, payee, amount)] = ts
    return accepted


def test_lock_stream_over_micro_batches(spark, attempts):
    rows, _, stream = attempts
    got = runs.drain_to_parquet(spark, locks.lock_stream(stream, watermark="1 minute"), "test-locks").collect()
    assert_final_marks(got, rows, timedelta(minutes=1))


def assert_final_marks(got, rows, delay):
    """The marks of all attempts that the watermark has passed, and no others."""
    last = max(r[5] for r in rows)
    passed = last.replace(microsecond=last.microsecond // 1000 * 1000) - delay - timedelta(milliseconds=1)
    times = {r[0]: r[5] for r in rows if r[5] <= passed}
    marks = brute_force(rows, 180)
    assert len(got) == len(times) > 0
    assert {r.transaction_id: r.accepted for r in got} == {t: marks[t] for t in times}
    assert all(r.event_time == times[r.transaction_id] for r in got)


@pytest.mark.parametrize("parts", [1, 4])
def test_lock_stream_does_not_depend_on_micro_batches(spark, tmp_path, parts):
    """Attempts that arrive out of order, within the delay, in any batches."""
    rng = random.Random(parts)
    rows = sorted(make_rows(160, seed=9), key=lambda r: r[5] + timedelta(seconds=rng.randrange(590)))
    folder = str(tmp_path / "in")
    for part in range(parts):
        as_frame(spark, rows[part * 160 // parts : (part + 1) * 160 // parts]).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = runs.drain_to_parquet(spark, locks.lock_stream(stream, watermark="10 minutes"), "test-order").collect()
    assert_final_marks(got, rows, timedelta(minutes=10))


def test_earlier_attempt_in_a_later_batch_takes_the_lock(spark, tmp_path):
    folder = str(tmp_path / "in")
    at = [("A", 300), ("B", 150), ("Z", 3600)]  # B comes later and lies before A; Z moves the watermark
    for tid, second in at:
        user = "z" if tid == "Z" else "u"
        row = (tid, user, "BNK001", "P", "1.00", START + timedelta(seconds=second), "SUCCESS")
        as_frame(spark, [row]).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = runs.drain_to_parquet(spark, locks.lock_stream(stream), "test-late").collect()
    assert {r.transaction_id: r.accepted for r in got} == {"A": False, "B": True}


def test_lock_stream_with_null_keys_and_times(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("A", None, "B", "P", None, START, "SUCCESS"), ("B", None, "B", "P", None, START, "SUCCESS"),
            ("C", "u", "B", "P", "1.00", None, "SUCCESS"),
            ("Z", "z", "B", "P", "1.00", START + timedelta(hours=1), "SUCCESS")]
    as_frame(spark, rows).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    got = runs.drain_to_parquet(spark, locks.lock_stream(stream), "test-nulls").collect()
    assert {r.transaction_id: r.accepted for r in got} == {"A": True, "B": False}


def drain_keyed(spark, stream, **options):
    options.setdefault("watermark", "10 minutes")
    marked = keyed_locks.keyed_lock_stream(stream, buckets=16, **options)
    return runs.drain_to_parquet(spark, marked, "test-keyed", keyed_locks.STATE_SETTINGS)


@pytest.mark.parametrize("parts", [1, 4])
def test_keyed_lock_stream_does_not_depend_on_micro_batches(spark, tmp_path, parts):
    """One row order per ``parts``, out of order within the delay; marks as by brute force."""
    rng = random.Random(parts)
    rows = sorted(make_rows(200, seed=9), key=lambda r: r[5] + timedelta(seconds=rng.randrange(590)))
    folder = str(tmp_path / "in")
    for part in range(parts):
        mine = rows[part * 200 // parts : (part + 1) * 200 // parts]
        as_frame(spark, mine).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    assert_final_marks(drain_keyed(spark, stream).collect(), rows, timedelta(minutes=10))


def test_keyed_lock_stream_edges(spark, tmp_path):
    """NULL keys are a key, attempts without a time are left out, an earlier attempt in a later
    batch takes the lock, and the end of the window is within it."""
    folder = str(tmp_path / "in")
    batches = [
        [("A", None, 0), ("B", None, 0), ("C", "u", None), ("L", "v", 300), ("W", "w", 0), ("X", "w", 180)],
        [("E", "v", 150), ("Y", "w", 180.000001)],
        [("Z", "z", 7200)],
    ]
    for batch in batches:
        rows = [
            (tid, user, "B", "P", None if user is None else "1.00", None if at is None else START + timedelta(seconds=at), "SUCCESS")
            for tid, user, at in batch
        ]
        as_frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {r.transaction_id: r.accepted for r in drain_keyed(spark, stream).collect()}
    assert got == {"A": True, "B": False, "E": True, "L": False, "W": True, "X": False, "Y": True}


def test_keyed_lock_stream_of_nothing(spark, tmp_path):
    as_frame(spark, []).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert drain_keyed(spark, stream).collect() == []


def test_keyed_lock_stream_writes_what_a_batch_touches(spark, tmp_path):
    """Long locks of 20,000 keys are held; the small batches after them write little."""
    folder = str(tmp_path / "in")
    big = spark.range(20_000).selectExpr(
        "concat('T', id) as transaction_id", "concat('u', id) as user_id", "'B' as payer_bank_id", "'P' as payee_bank_id",
        "cast(1 as decimal(10,2)) as amount", "timestamp_ntz'2024-01-01 00:00:00' as timestamp", "'SUCCESS' as final_status",
    )
    big.coalesce(1).write.parquet(folder)
    for i in range(1, 5):
        rows = [(f"S{i}{j}", f"u{j}", "B", "P", "1.00", START + timedelta(minutes=20 * i, seconds=j), "SUCCESS") for j in range(10)]
        as_frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    marked = keyed_locks.keyed_lock_stream(stream, window_s=86_400, buckets=16)
    got = runs.drain_to_parquet(spark, marked, "test-bytes", keyed_locks.STATE_SETTINGS)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    counts = {r.accepted: r["count"] for r in got.groupBy("accepted").count().collect()}
    assert counts[True] == 20_000 and counts[False] >= 20
    root = os.path.join(os.path.dirname(got.inputFiles()[0].removeprefix("file:").replace("///", "/")), "..", "checkpoint", "state")
    written = {}
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".changelog") and not name.startswith("."):
                version = int(name.split(".")[0].split("_")[0])
                written[version] = written.get(version, 0) + os.path.getsize(os.path.join(folder, name))
    assert len(written) >= 4
    assert sum(written[v] for v in sorted(written)[-2:]) / 2 < 0.05 * max(written.values())


def brute_follow_ups(rows, window_s):
    found = {}
    for tid, user, *_, ts, status in rows:
        if status == "FAILED" and user is not None and ts is not None:
            later = [r[5] for r in rows if r[1] == user and r[5] is not None and (r[5], r[0]) > (ts, tid) and r[5] - ts <= timedelta(seconds=window_s)]
            found[tid] = (ts, len(later), (min(later) - ts).total_seconds() if later else None)
    return found


@pytest.mark.parametrize("parts", [1, 5])
def test_follow_ups_do_not_depend_on_micro_batches(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = sorted(make_rows(300, seed=3), key=lambda r: r[5] + timedelta(seconds=rng.randrange(590)))
    rows += [("N1", None, "BNK001", "P", "1.00", START, "FAILED"), ("N2", "hot", "BNK001", "P", "1.00", None, "FAILED")]
    folder = str(tmp_path / "in")
    for part in range(parts):
        mine = rows[part * len(rows) // parts : (part + 1) * len(rows) // parts]
        as_frame(spark, mine).coalesce(1).write.mode("append").parquet(folder)
    code = F.when(F.col("final_status") == "FAILED", "ERR_NET_01").otherwise("ERR_SUCCESS")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("failure_code", code)
    made = followups.timeout_follow_ups(stream, 180, watermark="10 minutes", period="5 minutes")
    got = runs.drain_to_parquet(spark, made, "test-follow-ups").collect()
    want = brute_follow_ups(rows, 180)
    assert all((r.failed_at, r.following_attempts, r.first_gap_seconds) == want[r.transaction_id] for r in got)
    closed = max(r[5] for r in rows if r[5]) - timedelta(seconds=600 + 180 + 300 + 1)
    assert {t for t, (ts, *_) in want.items() if ts < closed} <= {r.transaction_id for r in got} and len(got) == len({r.transaction_id for r in got}) > 50
    batch = as_frame(spark, rows).withColumn("failure_code", code)
    every = followups.timeout_follow_ups(batch, 180).collect()
    assert {r.transaction_id: (r.failed_at, r.following_attempts, r.first_gap_seconds) for r in every} == want


def test_incident_stream_equals_batch_on_closed_time(spark, attempts):
    rows, batch, stream = attempts
    got = runs.drain_to_parquet(spark, bankhealth.bank_incidents(stream, alert_below=40, release_at=50, watermark="10 minutes"), "test-incidents")
    horizon = max(r[5] for r in rows) - timedelta(minutes=12)
    horizon = horizon.replace(microsecond=horizon.microsecond // 1000 * 1000)
    want = bankhealth.bank_incidents(batch, alert_below=40, release_at=50).filter(F.col("ended") <= F.lit(horizon).cast("timestamp_ntz"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() >= 3


def test_an_incident_lasts_until_the_rate_is_back(spark):
    """Per minute 100 attempts; one-minute windows with the given numbers of successes."""
    def minutes(good):
        return [
            (f"T{m}-{k}", "u", "BNK001", "P", "1.00", START + timedelta(minutes=m, milliseconds=k), "SUCCESS" if k < ok else "FAILED")
            for m, ok in enumerate(good) if ok is not None
            for k in range(100)
        ]

    def incidents(good):
        d = bankhealth.bank_incidents(as_frame(spark, minutes(good)), window="1 minute", slide="1 minute")
        at = lambda ts: int((ts - START).total_seconds() // 60)
        return sorted((at(r.started), at(r.ended), r.windows, r.alert_windows, r.worst_psr) for r in d.collect())

    # 89 is under the release bound only: it prolongs an incident and makes none.
    assert incidents([95, 87, 89, 86, 91, 95, 95, 89, 95]) == [(1, 4, 3, 2, 86.0)]
    assert incidents([87, 95, 95, 95, 80]) == [(0, 1, 1, 1, 87.0), (4, 5, 1, 1, 80.0)]
    # A minute without attempts does not end it, two do.
    assert incidents([87, None, 88, None, None, 50]) == [(0, 3, 2, 1, 87.0), (5, 6, 1, 1, 50.0)]
    assert incidents([88, 89, 90]) == []
