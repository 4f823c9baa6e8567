"""Cleaning in batches against cleaning at once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from railpulse import dimensions as D
from railpulse.operators.cleaning import accepted_ids, clean_stage_events, clean_transactions
from railpulse.operators.quality import dq_audit_summary
from railpulse.plans.catalogue import all_queries
from railpulse.schemas import RAW_TRANSACTIONS
from railpulse.sources.star import SCHEMAS, StarTables
from railpulse.streaming.cleaning import CleanStore, clean_stream

RAW = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_TRANSACTIONS) + ", ingest_seq long"


@pytest.fixture(scope="module")
def raw(spark):
    """Ids that recur within and across batches, valid and not, NULL among them."""
    rng = random.Random(6)
    rows = []
    for seq in range(900):
        tid = rng.choice([None, "hot", *[f"T{k}" for k in range(400)]])
        amount = rng.choice(["10.5", "3", "-4", "0", "abc", None, "NaN"])
        bank = rng.choice(["SBI", " hdfc bank ", "BNK003", None, "AXIS"])
        ts = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(10_000))
        rows.append((tid, f"U{seq % 9}", bank, "BNK002", amount, ts, "P2P", "D1", rng.choice(["4G", "", None]), "APP1", "SUCCESS", "ERR_SUCCESS", seq))
    return spark.createDataFrame(rows, RAW).repartition(4)


def day(raw, k, days):
    return raw.filter(F.floor(F.col("ingest_seq") * days / 900) == k)


def assert_same(store, raw):
    want = clean_transactions(raw)
    schema = ", ".join(f"{c} {t}" for c, t in want.dtypes)
    got = store.transactions(schema).drop("batch")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 150
    assert store.audit().first() == dq_audit_summary(raw).first()


@pytest.mark.parametrize("words", [16, 1 << 12])  # full filters, which let all through, and good ones
def test_days_one_by_one_with_replays(spark, raw, tmp_path, words):
    store = CleanStore(spark, str(tmp_path / "store"), buckets=4, words=words).create(raw)
    for k in (0, 0, 1, 2, 3, 1, 3, 0):
        store.add(day(raw, k, 4), k)
    assert_same(store, raw)


def test_a_batch_that_broke_off_is_not_read(spark, raw, tmp_path):
    store = CleanStore(spark, str(tmp_path / "store"), buckets=4, words=256).create(raw)
    store.add(day(raw, 0, 2), 0)
    before = store.audit().first()
    with pytest.MonkeyPatch.context() as m:
        m.setattr("railpulse.streaming.cleaning.dq_audit_summary", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.add(day(raw, 1, 2), 1)
    schema = ", ".join(f"{c} {t}" for c, t in clean_transactions(raw).dtypes)
    assert store.audit().first() == before
    assert {r.batch for r in store.transactions(schema).select("batch").distinct().collect()} == {0}
    store.add(day(raw, 1, 2), 1)
    assert_same(store, raw)


def test_empty_batches(spark, raw, tmp_path):
    store = CleanStore(spark, str(tmp_path / "store"), buckets=4, words=256).create(raw)
    assert store.audit().first()[0] == 0
    store.add(raw.limit(0), 0)
    store.add(raw, 1)
    store.add(raw.limit(0), 2)
    assert_same(store, raw)


def test_stream_of_files(spark, raw, tmp_path):
    folder = str(tmp_path / "in")
    for k in range(3):
        day(raw, k, 3).coalesce(1).write.mode("append").parquet(folder)
    store = CleanStore(spark, str(tmp_path / "store"), buckets=4, words=1 << 12).create(raw)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for _ in range(2):  # the second run finds nothing new
        clean_stream(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert_same(store, raw)


def test_filters_keep_strange_ids_from_the_store(spark, raw, tmp_path):
    store = CleanStore(spark, str(tmp_path / "store"), buckets=4, words=1 << 12).create(raw)
    store.add(raw, 0)
    held = {r.transaction_id for r in clean_transactions(raw).select("transaction_id").collect()}
    probe = spark.createDataFrame([(f"X{i}",) for i in range(500)] + [(t,) for t in held], "transaction_id string")
    assert {r[0] for r in store.accepted_before(probe, 1).collect()} == held
    assert store.accepted_before(probe, 0).count() == 0
    plan = store.accepted_before(probe.filter("transaction_id = 'X1'"), 1)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_filters_grow_with_their_batches(spark, raw, tmp_path):
    store = CleanStore(spark, str(tmp_path / "store"), buckets=4, words=4).create(raw)
    for k in range(2):
        store.add(day(raw, k, 2), k)
    filters = spark.read.parquet(str(tmp_path / "store" / "filters"))
    # At most six ids a word on average, each of four bits; words that are full let all ids through.
    words = filters.groupBy("batch", "level").agg(F.sum(F.bit_count("bits")).alias("n")).collect()
    assert {r.batch for r in words} == {0, 1} and all(r.level > 0 and r.n <= 24 * 4 * 2**r.level for r in words)
    strange = spark.range(400).select(F.concat(F.lit("X"), "id").alias("transaction_id"))
    assert store.accepted_before(strange, 2).count() == 0
    assert_same(store, raw)


def test_batches_read_their_own_files(spark, tmp_path, monkeypatch):
    rows = [(k, k * 7 % 50, k % 9, 1, float(k % 50), 5.0 + k, 0.01 * (k % 4), 0.01 * (k % 3), "A", "O", datetime(2024, 1, 1)) for k in range(200)]
    spark.createDataFrame(rows, SCHEMAS["lineitem"]).write.parquet(str(tmp_path / "lineitem.parquet"))
    read, add = [], CleanStore.add
    monkeypatch.setattr(CleanStore, "add", lambda self, raw, batch: (read.append((batch, raw.inputFiles())), add(self, raw, batch)))
    audit = all_queries()["clean_incremental_audit"](spark, str(tmp_path)).first()
    assert [batch for batch, _ in read] == [0, 1, 2, 3, 4, 2]
    assert all(files and not any("lineitem" in f for f in files) for _, files in read)
    assert audit == dq_audit_summary(StarTables(spark, str(tmp_path)).raw_transactions()).first() and audit[0] == 200


@pytest.mark.parametrize("known", [[], ["hot", "T1", "T2", "T300"], [None, "T3", "none"]])
def test_audit_beside_ids_accepted_earlier(spark, raw, known):
    """As the audit of the other rows, those of the known ids being duplicates; no row of the input is joined with them."""
    earlier = spark.createDataFrame([(t,) for t in known], "transaction_id string")
    again = F.coalesce("transaction_id", F.lit("NULL")).isin([t or "NULL" for t in known])
    rest, n = dq_audit_summary(raw.filter(~again)).first().asDict(), raw.filter(again).count()
    want = rest | {c: rest[c] + n for c in ("raw_transaction_count", "duplicate_transactions_removed")}
    got = dq_audit_summary(raw, "ingest_seq", D.BANK_ALIASES, earlier)
    assert got.first().asDict() == want and want["invalid_amounts_dropped"] > 20
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # of the invalid rows with the ids that have such


def test_repeated_ids_meet_the_filters_ungrouped_and_are_found_once(spark, raw, tmp_path, monkeypatch):
    store = CleanStore(spark, str(tmp_path / "store"), buckets=4, words=16).create(raw)
    given, find = [], CleanStore.accepted_before
    monkeypatch.setattr(CleanStore, "accepted_before", lambda self, ids, batch: (given.append(ids), find(self, ids, batch))[1])
    store.add(day(raw, 0, 2), 0)
    held = {r.transaction_id for r in clean_transactions(day(raw, 0, 2)).select("transaction_id").collect()}
    got = [r[0] for r in store.accepted_before(raw.union(raw).select("transaction_id"), 1).collect()]
    assert set(got) == held and len(got) == len(held) and None in held
    assert "Aggregate" not in given[0]._jdf.queryExecution().optimizedPlan().toString()


def test_stages_by_ids_alone(spark, raw):
    stages = spark.createDataFrame([(t, 1) for t in ("hot", "T1", "T2", "none", None)], "transaction_id string, stage_id int")
    by_rows = clean_stage_events(stages, clean_transactions(raw))
    by_ids = clean_stage_events(stages, accepted_ids(raw))
    assert sorted(map(tuple, by_ids.collect())) == sorted(map(tuple, by_rows.collect())) and by_ids.count() >= 2
    assert "Window" not in by_ids._jdf.queryExecution().executedPlan().toString()
