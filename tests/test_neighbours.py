"""The skew-safe neighbour search against plain windows over whole keys."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from railpulse.operators.neighbours import with_next, with_previous

START = datetime(2024, 1, 1)


def attempts(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        kind = rng.random()
        if kind < 0.35:  # one user holds a third of all rows, spread over time
            user, ts = "hot", START + timedelta(microseconds=rng.randrange(3 * 10**9))
        elif kind < 0.5:  # another has most rows within one minute
            user, ts = "burst", START + timedelta(seconds=120, microseconds=rng.randrange(40))
        elif kind < 0.6:  # rows without a user form a group too
            user, ts = None, START + timedelta(seconds=rng.randrange(4000))
        else:
            user, ts = f"u{rng.randrange(60)}", START + timedelta(seconds=rng.randrange(4000))
        rows.append((user, f"T{i:05d}", ts, rng.randrange(1000), rng.choice(["SUCCESS", "FAILED", None])))
    schema = "user_id string, transaction_id string, timestamp timestamp_ntz, amount int, final_status string"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("hot_rows", [5, 40, 10**9])
@pytest.mark.parametrize("forward", [True, False])
def test_same_as_plain_window(spark, hot_rows, forward):
    df = attempts(spark)
    columns = ["transaction_id", "timestamp", "amount", "final_status"]
    search, shift, prefix = (with_next, F.lead, "next_") if forward else (with_previous, F.lag, "previous_")
    got = search(df, ["user_id"], "timestamp", "transaction_id", columns, hot_rows)
    whole = Window.partitionBy("user_id").orderBy("timestamp", "transaction_id")
    want = df.withColumns({f"{prefix}{c}": shift(c).over(whole) for c in columns})
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0
    assert want.exceptAll(got).count() == 0


def test_several_keys(spark):
    df = attempts(spark, seed=2).withColumn("bucket", F.col("amount") % 2)
    got = with_next(df, ["user_id", "bucket"], "timestamp", "transaction_id", ["amount"], hot_rows=10)
    whole = Window.partitionBy("user_id", "bucket").orderBy("timestamp", "transaction_id")
    want = df.withColumn("next_amount", F.lead("amount").over(whole))
    assert got.exceptAll(want).count() == 0 and got.count() == 900


@pytest.mark.parametrize("forward", [True, False])
def test_rows_without_a_time_come_first(spark, forward):
    df = attempts(spark, seed=3).withColumn(
        "timestamp", F.when(F.col("amount") % 10 > 0, F.col("timestamp"))
    )
    search, shift, name = (with_next, F.lead, "next_amount") if forward else (with_previous, F.lag, "previous_amount")
    got = search(df, ["user_id"], "timestamp", "transaction_id", ["amount"], hot_rows=10)
    whole = Window.partitionBy("user_id").orderBy("timestamp", "transaction_id")
    want = df.withColumn(name, shift("amount").over(whole))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_key_is_spread(spark):
    """No group the window sees is as large as the hot key."""
    from railpulse.operators.neighbours import _cut_hot_groups

    cut = _cut_hot_groups(attempts(spark), ["user_id"], "timestamp", "transaction_id", 20)
    largest = cut.groupBy("user_id", "_slice").count().agg(F.max("count")).first()[0]
    assert largest <= 25


def test_dense_seconds_are_cut_and_sparse_ones_stay_whole(spark):
    """A busy second falls into microseconds, a busy minute into seconds, others stay minutes."""
    from railpulse.operators.neighbours import _cut_hot_groups

    at = [i * 10 for i in range(100)] + [60_000_000 + i * 500_000 for i in range(100)] + [180_000_000 + i for i in range(15)]
    rows = [(key, i, START + timedelta(microseconds=t)) for key in range(40) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "k int, id int, t timestamp_ntz")
    cut = _cut_hot_groups(df, ["k"], "t", "id", 20).groupBy("k", "_slice").count()
    assert cut.agg(F.max("count")).first()[0] <= 20
    assert cut.groupBy("k").count().select("count").distinct().collect()[0][0] == 100 + 50 + 1


def test_no_hot_keys_leaves_a_plain_window(spark):
    df = with_next(attempts(spark), ["user_id"], "timestamp", "transaction_id", ["amount"])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Union" not in plan and "BroadcastHashJoin" not in plan
