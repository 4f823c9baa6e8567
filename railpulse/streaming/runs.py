"""Running a stream over all data that is there, into files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from railpulse.session import work_folder


def drain_to_parquet(
    spark: SparkSession, stream: DataFrame, purpose: str, settings: dict[str, str] | None = None
) -> DataFrame:
    """Process everything available, in append mode, and return what was written.

    Results and checkpoint go to the shared folder, so a lost executor is
    recovered from there and no row passes through the driver. ``settings`` hold for the
    query alone, which takes them along when it starts.
    """
    folder = work_folder(spark, purpose)
    out = os.path.join(folder, "rows")
    before = {name: spark.conf.get(name, None) for name in settings or {}}
    for name, value in (settings or {}).items():
        spark.conf.set(name, value)
    try:
        query = _started(stream, out, os.path.join(folder, "checkpoint"))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _started(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
