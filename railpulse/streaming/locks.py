"""Duplicate lock on a stream of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from railpulse.operators.duplicates import LOCK_KEY


# Buckets of keys for each partition of the state.
BUCKETS = 16


def lock_stream(
    tx: DataFrame,
    window_s: int = 180,
    keys: list[str] = LOCK_KEY,
    watermark: str = "10 minutes",
    buckets: int | None = None,
) -> DataFrame:
    """Mark every attempt of a stream as accepted or locked.

    An attempt is locked when it comes within ``window_s`` of the last accepted
    one of its key; a locked attempt does not extend the lock. Attempts of the
    same time are taken in order of their id.

    An attempt waits in the state until the watermark has passed its time; then no
    earlier one can come, and its mark is final. So the marks follow event time alone
    and do not depend on where micro-batches end. Keys share states by hash, so one
    Python call serves many keys (as JSON text, which keeps numbers and strings);
    ``buckets`` is their number, by default in proportion to the shuffle partitions of
    the session. A state is its keys' waiting attempts and the times of their locks; a
    lock is dropped once the watermark has passed its end. A task holds the attempts of
    a bucket that came in a micro-batch and in the delay: give the source a limit per
    trigger. Attempts without a time are left out; those later than the watermark allows
    are dropped, as in every stream.
    :func:`railpulse.operators.duplicates.lock_windows` keeps one row per lock and
    needs no Python.
    """
    if buckets is None:
        buckets = BUCKETS * int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = {f.name: f.dataType for f in tx.select(*keys, "transaction_id").schema}
    id_type = types["transaction_id"]
    stream = (
        tx.select(
            F.to_json(F.struct(*keys)).alias("key"),
            "transaction_id",
            F.col("timestamp").cast("timestamp").alias("event_time"),
        )
        .filter(F.col("event_time").isNotNull())
        .withWatermark("event_time", watermark)
        .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    )
    output = T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("transaction_id", id_type),
            T.StructField("event_time", T.TimestampType()),
            T.StructField("accepted", T.BooleanType()),
        ]
    )
    state = T.StructType(
        [
            T.StructField("locked_keys", T.ArrayType(T.StringType())),
            T.StructField("locked_at", T.ArrayType(T.LongType())),
            T.StructField("keys", T.ArrayType(T.StringType())),
            T.StructField("times", T.ArrayType(T.LongType())),
            T.StructField("ids", T.ArrayType(id_type)),
        ]
    )
    window = window_s * 1_000_000

    def mark(_: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        locked_keys, locked_at, names, times, ids = kept.get if kept.exists else ([], [], [], [], [])
        locks = dict(zip(locked_keys, locked_at))
        names, times, ids = list(names), [np.array(times, "int64")], list(ids)
        if not kept.hasTimedOut:
            for rows in batches:
                names += rows["key"].tolist()
                times.append(rows["event_time"].to_numpy("datetime64[us]").astype("int64"))
                ids += rows["transaction_id"].tolist()
        rows = pd.DataFrame({"key": names, "time": np.concatenate(times), "id": pd.Series(ids, dtype=object)})
        passed = kept.getCurrentWatermarkMs()
        # In whole milliseconds, rounded up, as the timeout below.
        is_final = -(-rows["time"] // 1000) < passed
        done = rows[is_final].sort_values(["key", "time", "id"], ignore_index=True)
        waiting = rows[~is_final]
        made_at, names = done["time"].to_numpy("int64"), done["key"].tolist()
        accepted = np.zeros(len(done), dtype=bool)
        for i, (name, time) in enumerate(zip(names, made_at.tolist())):
            last = locks.get(name)
            if last is None or time > last + window:
                accepted[i] = True
                locks[name] = time
        locks = {name: last for name, last in locks.items() if last + window > (passed - 1) * 1000}
        if len(waiting) or locks:
            kept.update((list(locks), list(locks.values()), *(waiting[c].tolist() for c in ("key", "time", "id"))))
            wake = int(waiting["time"].min()) if len(waiting) else max(locks.values()) + window
            kept.setTimeoutTimestamp(max(-(-wake // 1000), passed + 1))
        elif kept.exists:
            kept.remove()
        if len(done):
            marks = {"transaction_id": done["id"].tolist(), "event_time": made_at.astype("datetime64[us]")}
            yield pd.DataFrame({"key": names, **marks, "accepted": accepted})

    marked = stream.groupBy("bucket").applyInPandasWithState(
        mark, output, state, "append", GroupStateTimeout.EventTimeTimeout
    )
    key_type = T.StructType([T.StructField(k, types[k]) for k in keys])
    return marked.withColumn("key", F.from_json("key", key_type)).select(
        "key.*", "transaction_id", "event_time", "accepted"
    )
