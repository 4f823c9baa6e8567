"""Cleaning day by day: every batch against the ids that earlier ones accepted.

The store is a folder of Parquet tables, each with a partition per batch:

* ``transactions``: cleaned attempts, and ``audit``: the six counters of the batch;
* ``ids``: accepted ids, in hash buckets;
* ``filters``: for each 64-bit word of a Bloom filter over a batch's ids, its bits. Partitions
  are by level, too: large batches double the number of words as often as they need.

A batch reads only partitions of earlier batches and replaces its own, so replaying one,
or the whole series, leaves the store as it was. The audit is written last; a batch
without one is not finished and is left out by the readers.
"""

from __future__ import annotations

import math
import os
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from railpulse import dimensions as D
from railpulse.operators.cleaning import clean_transactions
from railpulse.operators.quality import dq_audit_summary
from railpulse.session import work_folder

# Buckets of accepted ids, least words of a batch's filter, and bits that an id sets in its
# word. About six ids a word let through one strange id in twenty.
BUCKETS, WORDS, BITS, FULL = 64, 1 << 22, 4, 6
COUNTERS = [
    "raw_transaction_count",
    "duplicate_transactions_removed",
    "inconsistent_bank_names_standardized",
    "invalid_amounts_dropped",
    "missing_values_imputed",
    "processed_transaction_count",
]
AUDIT_SCHEMA = ", ".join(f"{c} bigint" for c in COUNTERS) + ", batch bigint"


def _hashed(ids: DataFrame) -> DataFrame:
    """Transaction ids and a hash, from which their places follow; NULL is an id like others."""
    return ids.select("transaction_id", F.xxhash64("transaction_id").alias("_hash"))


def _bucket(buckets: int) -> Column:
    return F.expr(f"cast(pmod(_hash, {buckets}) as int)").alias("bucket")


def _mask() -> Column:
    """The bits that an id sets in its filter word, six bits of the hash for each."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.expr(f"shiftleft(1L, cast(shiftright(_hash, {6 * i}) & 63 as int))") for i in range(BITS)])


def _read(spark: SparkSession, folder: str, table: str, schema: str, before: int | None = None) -> DataFrame:
    rows = spark.read.schema(schema).parquet(os.path.join(folder, table))
    rows = rows.filter("batch >= 0")  # the empty partition of a new store
    return rows if before is None else rows.filter(F.col("batch") < before)


def _replace(rows: DataFrame, folder: str, table: str, batch: int, by: str | None = None) -> None:
    writer = rows.write.mode("overwrite")
    writer = writer.partitionBy(by) if by else writer
    writer.parquet(os.path.join(folder, table, f"batch={batch}"))


class CleanStore:
    """A store of cleaned attempts that grows by batches.

    ``id_type`` is the type of transaction ids. ``buckets`` and ``words`` hold for the
    life of a store; take about a sixth of a small batch's ids as ``words``. The filter of a
    larger batch has this number doubled until no word has more than six ids on average.
    """

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "string", buckets: int = BUCKETS, words: int = WORDS):
        self.spark, self.folder, self.buckets, self.words = spark, folder, buckets, words
        self._seen = f"_accepted {id_type}"
        self._ids = f"transaction_id {id_type}, batch bigint, bucket int"
        self._filters = "word bigint, bits bigint, batch bigint, level int"

    def create(self, raw: DataFrame, seq_col: str = "ingest_seq") -> CleanStore:
        """Empty tables, for attempts such as ``raw``."""
        none = raw.limit(0)
        ids = none.select("transaction_id")
        _replace(clean_transactions(none, seq_col), self.folder, "transactions", -1)
        _replace(ids.withColumn("bucket", F.lit(0)), self.folder, "ids", -1, "bucket")
        empty = ids.select(*[F.lit(0).cast("long").alias(c) for c in ("word", "bits")], F.lit(0).alias("level"))
        _replace(empty, self.folder, "filters", -1, "level")
        _replace(dq_audit_summary(none, seq_col), self.folder, "audit", -1)
        return self

    def _word(self, level: str) -> Column:
        """The filter word of a hashed id at a level, from bits of the hash that the mask leaves."""
        return F.expr(f"pmod(shiftright(_hash, {6 * BITS}), shiftleft({self.words}L, {level}))")

    def accepted_before(self, ids: DataFrame, batch: int) -> DataFrame:
        """Those of the ``ids`` that a batch before ``batch`` accepted, each once.

        The filters, a few bits per id, tell which bucket of which batch may hold an id;
        only those partitions of the ids are read. Repeated ids meet the filters as they
        are; those that pass, which are fewer, are reduced to one each.
        """
        filters = _read(self.spark, self.folder, "filters", self._filters, batch)
        # At most one per doubling of the words; they are names of partitions.
        levels = F.broadcast(filters.select(F.col("level").alias("_level")).distinct())
        filters = filters.select("word", "bits", "level", F.col("batch").alias("_batch"))
        # Only ids and their hashes are shuffled; word and mask follow from them on either side.
        held_bits = F.col("bits").bitwiseAND(_mask()) == _mask()
        at = (self._word("_level") == F.col("word")) & (F.col("_level") == F.col("level"))
        maybe = _hashed(ids).crossJoin(levels).join(filters, at & held_bits)
        maybe = maybe.select(F.col("transaction_id").alias("_id"), _bucket(self.buckets).alias("_bucket"), "_batch").distinct()
        held = _read(self.spark, self.folder, "ids", self._ids, batch)
        # The id first: rows are sorted by it, and few have the same one.
        same = F.col("transaction_id").eqNullSafe(F.col("_id")) & (F.col("batch") == F.col("_batch")) & (F.col("bucket") == F.col("_bucket"))
        return held.join(maybe, same, "left_semi").select(F.col("transaction_id").alias("_accepted"))

    def add(self, raw: DataFrame, batch: int, seq_col: str = "ingest_seq") -> None:
        """Clean one batch. Batches come in ingest order, numbered from 0.

        Rows of an id that an earlier batch accepted are duplicates, whatever their
        amount; the others are cleaned and counted as by themselves. The batch is read
        several times, so give written rows. It is counted while it is cleaned.
        """
        spark, work = self.spark, work_folder(self.spark, "clean-batch")
        self.accepted_before(raw.select("transaction_id"), batch).write.parquet(work)
        seen = spark.read.schema(self._seen).parquet(work)
        # Cleaning deals rows by id, and plain equality lets the join use that; one row at most has no id.
        nulls = seen.agg(F.count_if(F.col("_accepted").isNull())).scalar()
        clean = clean_transactions(raw, seq_col)
        new = clean.join(seen, F.col("transaction_id") == F.col("_accepted"), "left_anti")

        @inheritable_thread_target(spark)
        def counted() -> DataFrame:
            rows = dq_audit_summary(raw, seq_col, D.BANK_ALIASES, seen.withColumnRenamed("_accepted", "transaction_id"))
            return spark.createDataFrame(rows.collect(), rows.schema)

        with ThreadPoolExecutor() as beside:
            counts = beside.submit(counted)
            _replace(new.filter(F.col("transaction_id").isNotNull() | (nulls == 0)), self.folder, "transactions", batch)
            done = spark.read.schema(clean.schema).parquet(os.path.join(self.folder, "transactions", f"batch={batch}"))
            ids = _hashed(done)
            # A file per bucket, or several where it is large.
            dealt = ids.select("transaction_id", _bucket(self.buckets)).hint("rebalance", "bucket")
            written = beside.submit(inheritable_thread_target(spark)(_replace), dealt, self.folder, "ids", batch, "bucket")
            level = max(0, math.ceil(math.log2(max(1, done.count()) / (FULL * self.words))))
            words = ids.withColumn("level", F.lit(level)).groupBy(self._word("level").alias("word"), "level").agg(F.bit_or(_mask()).alias("bits"))
            _replace(words, self.folder, "filters", batch, "level")
            written.result()
            _replace(counts.result().coalesce(1), self.folder, "audit", batch)

    def audit(self) -> DataFrame:
        """The six counters over all finished batches, as one row."""
        rows = _read(self.spark, self.folder, "audit", AUDIT_SCHEMA)
        return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS])

    def transactions(self, schema: str) -> DataFrame:
        """The cleaned attempts of all finished batches, with their ``batch``."""
        done = _read(self.spark, self.folder, "audit", AUDIT_SCHEMA).select(F.col("batch").alias("_done"))
        rows = _read(self.spark, self.folder, "transactions", f"{schema}, batch bigint")
        return rows.join(done, F.col("batch") == F.col("_done"), "left_semi")


def clean_stream(raw: DataFrame, store: CleanStore, checkpoint: str, seq_col: str = "ingest_seq") -> StreamingQuery:
    """Clean everything a stream of raw attempts has, a micro-batch at a time.

    A micro-batch that is run again after a failure replaces what it had written. Its rows
    are taken from the source once.
    """

    def add(rows: DataFrame, batch: int) -> None:
        work = work_folder(store.spark, "clean-batch")
        rows.write.parquet(work)
        store.add(store.spark.read.schema(rows.schema).parquet(work), batch, seq_col)

    writer = raw.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
