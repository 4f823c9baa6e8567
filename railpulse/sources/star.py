"""Payment tables derived from the shared star-schema test tables.

Only projections: every payment column is arithmetic on one row of its source
table (users also look up the nation), so column pruning and filters reach the
Parquet scan and no attempt is shuffled to make the input.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse import dimensions as D

APPS = ["APP1", "APP2", "APP3", "APP4", "APP5"]

# Schemas of the test tables, so that no job is spent on reading them from files.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def _pick(index: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{value}'" for i, value in enumerate(values))
    return f"CASE {index} {arms} END"


def _bank_id(number: str) -> str:
    return f"concat('BNK', lpad(cast({number} as string), 3, '0'))"


def _failure_code(is_failed: str, number: str) -> str:
    """Code 0 is not among the known error codes, on purpose."""
    codes = ["ERR_UNMAPPED"] + [code for code, *_ in D.ERROR_CODES if code != "ERR_SUCCESS"]
    return f"CASE WHEN {is_failed} THEN {_pick(f'{number} % 11', codes)} ELSE 'ERR_SUCCESS' END"


def transactions_from(events: DataFrame) -> DataFrame:
    """Payment attempts from an events frame, batch or stream."""
    is_failed = "event_type = 'error'"
    return events.selectExpr("*", "cast(get_json_object(props, '$.k') as int) as k").selectExpr(
        "event_id as transaction_id",
        "user_id",
        f"{_bank_id('1 + k % 10')} as payer_bank_id",
        f"{_bank_id('1 + (k div 10) % 4')} as payee_bank_id",
        "cast(value * 40 as decimal(18,2)) as amount",
        "ts as timestamp",
        "CASE WHEN k % 20 < 9 THEN 'P2P' ELSE 'P2M' END as transaction_type",
        "event_id % 200 as device_id",
        f"{_pick('event_id % 4', D.NETWORKS)} as network_type",
        f"{_pick('event_id % 5', APPS)} as payment_app",
        f"CASE WHEN {is_failed} THEN 'FAILED' ELSE 'SUCCESS' END as final_status",
        f"{_failure_code(is_failed, 'event_id')} as failure_code",
    )


def with_repeats(attempts: DataFrame) -> DataFrame:
    """Every seventh attempt made again, by the same user to the same payee over the
    same amount, 1 to 400 seconds later. Ids are doubled; those of repeats are odd."""
    later = "CASE WHEN transaction_id % 7 = 0 THEN array(0, 1 + cast(transaction_id % 400 as int)) ELSE array(0) END"
    return attempts.withColumn("later", F.explode(F.expr(later))).select(
        *[
            F.expr("transaction_id * 2 + if(later > 0, 1, 0)").alias(c) if c == "transaction_id"
            else F.expr("timestamp + make_dt_interval(0, 0, 0, later)").alias(c) if c == "timestamp"
            else F.col(c)
            for c in attempts.columns
        ]
    )


@dataclass(frozen=True)
class StarTables:
    """The payment tables over one folder of test tables."""

    spark: SparkSession
    folder: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(os.path.join(self.folder, f"{name}.parquet"))

    def transactions(self) -> DataFrame:
        return transactions_from(self._read("events"))

    def transaction_stream(self, max_bytes_per_trigger: int | None = None) -> DataFrame:
        # A stream source wants folders or a pattern. This pattern names the table
        # whether it is one file or a folder of files.
        path = os.path.join(self.folder, "events.parque[t]")
        reader = self.spark.readStream.schema(SCHEMAS["events"])
        if max_bytes_per_trigger is not None:
            reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
        return transactions_from(reader.parquet(path))

    def raw_transactions(self) -> DataFrame:
        """Attempts before cleaning: repeated ids, spelled-out banks, invalid and
        unreadable amounts, blank fields, and an ingest order."""
        is_failed = "l_tax >= 0.07D"
        return self._read("lineitem").selectExpr(
            "l_orderkey * 10 + l_linenumber as transaction_id",
            """CASE WHEN l_quantity = 50 THEN ''
                    WHEN l_quantity < 49 THEN concat('USR', cast(l_orderkey % 150 as string)) END as user_id""",
            f"""CASE l_suppkey % 10 WHEN 0 THEN 'SBI' WHEN 1 THEN 'hdfc bank' WHEN 2 THEN ' ICICI_BANK '
                    WHEN 3 THEN 'AXIS' ELSE {_bank_id("l_suppkey % 10 + 1")} END as payer_bank_id""",
            f"CASE WHEN l_partkey % 97 <> 0 THEN {_bank_id('1 + l_partkey % 10')} END as payee_bank_id",
            """CASE WHEN l_discount = 0 AND l_tax = 0 THEN cast(-l_extendedprice as string)
                    WHEN l_discount = 0 AND l_tax = 0.01D THEN 'n/a'
                    ELSE cast(l_extendedprice as string) END as amount""",
            "l_shipdate as timestamp",
            "CASE WHEN l_partkey % 20 < 9 THEN 'P2P' ELSE 'P2M' END as transaction_type",
            "concat('DEV', cast(l_partkey % 200 as string)) as device_id",
            """CASE WHEN l_returnflag = 'A' THEN '4G' WHEN l_returnflag = 'R' THEN '5G'
                    WHEN l_linestatus = 'O' THEN '' END as network_type""",
            f"{_pick('l_partkey % 5', APPS)} as payment_app",
            f"""CASE WHEN l_quantity = 13 THEN '' WHEN {is_failed} THEN 'FAILED' ELSE 'SUCCESS' END
                    as final_status""",
            f"{_failure_code(is_failed, 'l_partkey')} as failure_code",
            # Any fixed order will do; this one differs from order of time.
            "l_partkey * 100000000 + l_suppkey * 100 + cast(l_quantity as bigint) as ingest_seq",
        )

    def stage_events(self) -> DataFrame:
        return self._read("lineitem").selectExpr(
            "l_orderkey as transaction_id",
            "l_linenumber as stage_id",
            "l_shipdate as event_timestamp",
            "CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'SUCCESS' END as stage_status",
            "cast(null as string) as error_code",
        )

    def raw_stage_events(self) -> DataFrame:
        """Stages of the raw attempts, one to seven for each of their rows."""
        rows = self.raw_transactions().select("transaction_id", "timestamp", "final_status")
        return rows.selectExpr(
            "transaction_id",
            "explode(sequence(1, 1 + cast(transaction_id % 7 as int))) as stage_id",
            "timestamp as event_timestamp",
            "CASE WHEN final_status = 'FAILED' THEN 'FAILED' ELSE 'SUCCESS' END as stage_status",
            "cast(null as string) as error_code",
        )

    def initiated(self) -> DataFrame:
        """The ids of all payments that have stages: one row per order."""
        return self._read("orders").selectExpr("o_orderkey as transaction_id")

    def users(self) -> DataFrame:
        nation = self._read("nation")
        joined = self._read("customer").join(nation, F.expr("c_nationkey = n_nationkey"))
        return joined.selectExpr(
            "c_custkey as user_id",
            "date_add(date'2023-01-01', cast(c_custkey * 37 % 1200 as int)) as signup_date",
            "c_mktsegment as user_segment",
            "n_name as state",
            f"{_pick('c_custkey % 5', D.AGE_GROUPS)} as age_group",
            "cast(1335 - c_custkey * 37 % 1200 as int) as tenure_days",
        )

    def devices(self) -> DataFrame:
        return self._read("part").selectExpr(
            "p_partkey as device_id",
            "p_type as operating_system",
            "cast(p_size as string) as os_version",
            "p_brand as device_category",
        )

    def banks(self) -> DataFrame:
        return D.banks(self.spark)

    def error_codes(self) -> DataFrame:
        return D.error_codes(self.spark)

    def stage_names(self) -> DataFrame:
        return D.stage_names(self.spark)
