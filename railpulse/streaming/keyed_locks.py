"""Duplicate lock on a stream, its state kept per key in a changelog.

:func:`railpulse.streaming.locks.lock_stream` holds all keys of a bucket in one value, which is
written anew whenever one of them is touched. Here each lock is an entry of a map and
each micro-batch adds one entry of waiting attempts, so what a batch writes grows with the
batch and not with the keys that are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from railpulse.operators.duplicates import LOCK_KEY
from railpulse.streaming.locks import BUCKETS

# What a query over this stream must be started with (see runs.drain_to_parquet).
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class _Locks(StatefulProcessor):
    """The locks and waiting attempts of a bucket of keys.

    ``waiting`` maps (earliest time, serial) to the attempts of one micro-batch, ``locks`` a
    key to the time of its last accepted attempt, and ``course`` holds the next serial and
    when locks are next looked through for ended ones. All times are microseconds.
    """

    def __init__(self, window: int, id_type: T.DataType):
        self.window, self.id_type = window, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        entry = T.StructType(
            [
                T.StructField("keys", T.ArrayType(T.StringType())),
                T.StructField("times", T.ArrayType(T.LongType())),
                T.StructField("ids", T.ArrayType(self.id_type)),
            ]
        )
        self.waiting = handle.getMapState("waiting", "first bigint, serial bigint", entry)
        self.locks = handle.getMapState("locks", "key string", "at bigint")
        self.course = handle.getValueState("course", "serial bigint, sweep bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, times, ids = [], [], []
        for part in rows:
            names += part["key"].tolist()
            times += part["event_time"].to_numpy("datetime64[us]").astype("int64").tolist()
            ids += part["transaction_id"].tolist()
        self._wait(names, times, ids, timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        parts = []
        for first, serial in list(self.waiting.keys()):
            if -(-first // 1000) < passed:
                parts.append(self.waiting.getValue((first, serial)))
                self.waiting.removeKey((first, serial))
        if parts:
            found = {
                "key": np.concatenate([np.array(p[0], dtype=object) for p in parts]),
                "time": np.concatenate([np.array(p[1], dtype="int64") for p in parts]),
                "id": [i for p in parts for i in p[2]],
            }
            attempts = pd.DataFrame(found)
            # In whole milliseconds, rounded up, as timers are.
            is_final = -(-attempts["time"] // 1000) < passed
            left = attempts[~is_final]
            if len(left):
                self._wait(left["key"].tolist(), left["time"].tolist(), left["id"].tolist(), timerValues)
            done = attempts[is_final].sort_values(["key", "time", "id"], ignore_index=True)
            yield self._decided(done, (passed - 1) * 1000)
        self._sweep((passed - 1) * 1000)

    def _wait(self, names: list, times: list, ids: list, timerValues) -> None:
        serial, sweep = self._course()
        first = min(times)
        self.waiting.updateValue((first, serial), (names, times, ids))
        self.course.update((serial + 1, sweep))
        self.handle.registerTimer(max(-(-first // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def _course(self) -> tuple[int, int | None]:
        return tuple(self.course.get()) if self.course.exists() else (0, None)

    def _decided(self, done: pd.DataFrame, now: int) -> pd.DataFrame:
        """Marks in order of key, time and id. A key's lock is read once, if any is held, and
        written only if it outlasts ``now``: no attempt still to be decided is that early."""
        serial, sweep = self._course()
        names, times = done["key"].tolist(), done["time"].tolist()
        accepted = np.zeros(len(done), dtype=bool)
        ends, last, held = [], None, None
        for i, (name, time) in enumerate(zip(names, times)):
            if i == 0 or name != names[i - 1]:
                found = None if sweep is None else self.locks.getValue((name,))
                held = last = None if found is None else found[0]
            if last is None or time > last + self.window:
                accepted[i], last = True, time
            if (i + 1 == len(names) or names[i + 1] != name) and last != held:
                if last + self.window > now:
                    self.locks.updateValue((name,), (last,))
                    ends.append(last + self.window)
                elif held is not None:
                    self.locks.removeKey((name,))
        if ends and sweep is None:
            self._plan(serial, max(ends))
        marks = {"transaction_id": done["id"].tolist(), "event_time": np.array(times, "int64").astype("datetime64[us]")}
        return pd.DataFrame({"key": names, **marks, "accepted": accepted})

    def _plan(self, serial: int, sweep: int) -> None:
        self.course.update((serial, sweep))
        self.handle.registerTimer(sweep // 1000 + 2)

    def _sweep(self, now: int) -> None:
        """Drop ended locks, at most once in the length of a lock. Without a sweep to come
        no lock is held."""
        serial, sweep = self._course()
        if sweep is None or now < sweep:
            return
        held = list(self.locks.iterator())
        open_ends = [at + self.window for _, (at,) in held if at + self.window > now]
        for name, (at,) in held:
            if at + self.window <= now:
                self.locks.removeKey(tuple(name))
        if open_ends:
            self._plan(serial, max(*open_ends, now + self.window))
        else:
            self.course.update((serial, None))

    def close(self) -> None:
        pass


def keyed_lock_stream(
    tx: DataFrame,
    window_s: int = 180,
    keys: list[str] = LOCK_KEY,
    watermark: str = "10 minutes",
    buckets: int | None = None,
) -> DataFrame:
    """Mark every attempt of a stream as accepted or locked, by the rule and with the columns of
    :func:`railpulse.streaming.locks.lock_stream`, and final in the same way.

    Keys are grouped by hash into ``buckets``, since a Python call per key costs about a
    millisecond. A timer wakes a bucket when the watermark has passed its earliest waiting
    attempt. Then the locks of the keys that have final attempts are read, and written if they
    are not over, one entry each. Ended locks are looked for once in the length of a lock.

    Start the query with :data:`STATE_SETTINGS`. With changelog checkpoints a micro-batch
    writes the entries it changed; the whole state is written now and then, aside from the
    batch. A task holds the attempts of a bucket that become final at once.
    """
    if buckets is None:
        buckets = BUCKETS * int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = {f.name: f.dataType for f in tx.select(*keys, "transaction_id").schema}
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
            T.StructField("transaction_id", types["transaction_id"]),
            T.StructField("event_time", T.TimestampType()),
            T.StructField("accepted", T.BooleanType()),
        ]
    )
    marked = stream.groupBy("bucket").transformWithStateInPandas(
        _Locks(window_s * 1_000_000, types["transaction_id"]), output, "Append", "EventTime"
    )
    key_type = T.StructType([T.StructField(k, types[k]) for k in keys])
    return marked.withColumn("key", F.from_json("key", key_type)).select(
        "key.*", "transaction_id", "event_time", "accepted"
    )
