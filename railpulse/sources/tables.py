"""Reading and writing the payment tables as files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railpulse import schemas as S
from railpulse.operators.cleaning import clean_view

RAW_SCHEMAS = {
    **S.STATIC_TABLES,
    "transactions": S.RAW_TRANSACTIONS,
    "stage_events": S.STAGE_EVENTS,
}
# More paths than this are joined without a broadcast hint.
BROADCAST_PATHS = 100_000
CLEAN_SCHEMAS = {**RAW_SCHEMAS, "transactions": S.TRANSACTIONS}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file or folder with a header, under a declared schema.

    Columns are matched by position, and the header is checked against the
    schema. Unreadable values become NULL; the cleaning rules deal with them.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )


def read_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The raw tables of a folder holding ``<table>.csv`` files or folders."""
    return {
        name: read_csv(spark, os.path.join(folder, f"{name}.csv"), schema)
        for name, schema in RAW_SCHEMAS.items()
    }


def read_clean(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables as written by :func:`write_table`."""
    return {
        name: spark.read.schema(schema).parquet(os.path.join(folder, f"{name}.parquet"))
        for name, schema in CLEAN_SCHEMAS.items()
    }


def with_file_order(raw: DataFrame, column: str = "ingest_seq") -> DataFrame:
    """Add the place of each row in the files it was read from, as one whole number.

    The place is (file by path, start of the file split, row of the split), packed
    into a decimal, which sorts and aggregates at a fixed width. Splits are packed into
    tasks in any order, so a row number alone would not do. Apply it directly to the
    frame returned by a file reader. The paths, which Spark lists to plan the scan
    anyway, become numbers by a join with their list; a single file needs none.
    """
    paths = sorted(raw.inputFiles())
    # Numbers of rows within a partition take 33 bits of the id, splits start below 2 ** 42.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("decimal(11,0)")
    start = F.col("_metadata.file_block_start").cast("decimal(13,0)")
    within = start * F.lit(str(1 << 33)).cast("decimal(10,0)") + row
    if len(paths) < 2:
        return raw.withColumn(column, within.cast("decimal(38,0)"))
    files = raw.sparkSession.createDataFrame(list(enumerate(paths)), "_file_number long, _file_path string")
    files = F.broadcast(files) if len(paths) <= BROADCAST_PATHS else files
    number = F.coalesce("_file_number", F.raise_error(F.concat(F.lit("file not listed: "), "_path")).cast("long"))
    first = number.cast("decimal(8,0)") * F.lit(str(1 << 75)).cast("decimal(23,0)")
    placed = raw.withColumns({"_path": F.input_file_name(), "_within": within})
    return placed.join(files, F.col("_path") == F.col("_file_path"), "left").select(
        *raw.columns, (first + F.col("_within")).cast("decimal(38,0)").alias(column)
    )


def write_table(df: DataFrame, folder: str, name: str, partition_by: str | None = None) -> str:
    """Write one table as Parquet, optionally partitioned by a column such as a
    date, so that later reads by that column skip the other files."""
    path = os.path.join(folder, f"{name}.parquet")
    writer = df.write.mode("overwrite")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return path


def write_csv(df: DataFrame, folder: str, name: str) -> str:
    """Write one table as CSV part files with a header."""
    path = os.path.join(folder, f"{name}.csv")
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_summary(audit: DataFrame, folder: str, name: str = "data_quality_summary") -> str:
    """Write a one-row summary as JSON."""
    path = os.path.join(folder, f"{name}.json")
    audit.coalesce(1).write.mode("overwrite").json(path)
    return path


def publish_dims(spark: SparkSession, raw_folder: str, out_folder: str) -> dict[str, str]:
    """Read the four static tables under their schemas and write them as Parquet."""
    return {
        name: write_table(read_csv(spark, os.path.join(raw_folder, f"{name}.csv"), schema), out_folder, name)
        for name, schema in S.STATIC_TABLES.items()
    }


def register_views(tables: dict[str, DataFrame]) -> None:
    """Make tables usable from SQL under their names; the cleaned attempts are
    known as ``clean_transactions`` too, and raw attempts also give the view
    ``clean_transactions_view``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    if "transactions" in tables:
        tables["transactions"].createOrReplaceTempView("clean_transactions")
    if "raw_transactions" in tables:
        clean_view(tables["raw_transactions"]).createOrReplaceTempView("clean_transactions_view")
