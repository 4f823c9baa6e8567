"""Queries against their oracles where one key holds a third of all rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from railpulse.operators import neighbours
from tests.comparing import TABLES, differences, oracle_connection

SOURCE = "/root/testdata/sf0.001"
NAMES = [
    "dq_duplicates",
    "dq_audit_summary",
    "clean_view",
    "clean_transactions",
    "clean_stage_events",
    "bank_pair_matrix",
    "failure_breakdown",
    "funnel",
    "stage_latency",
    "segment_friction",
    "impacted_power_users",
    "os_network",
    "retry_policy_day",
    "retry_frequency",
    "duplicate_attempts_day",
    "duplicate_payment_rate",
    "duplicate_payment_rate_day",
    "lock_windows",
    "bank_health",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = str(tmp_path_factory.mktemp("skewed"))
    con = duckdb.connect()
    for table in TABLES:
        path = os.path.join(SOURCE, f"{table}.parquet")
        query = f"select * from '{path}'"
        if table == "events":
            query = f"""select * replace (case when event_id % 3 = 0 then 7 else user_id end as user_id,
                case when event_id % 3 = 0 then '{{"k": 12}}' else props end as props) from '{path}'"""
        if table == "lineitem":
            # Part, supplier and quantity give the ingest order, so they stay unique.
            query = f"""select * replace (case when l_partkey % 3 = 0 then 17 else l_orderkey end as l_orderkey,
                cast(case when l_partkey % 3 = 0 then 2 else l_linenumber end as integer) as l_linenumber)
                from (select distinct on (l_partkey, l_suppkey, l_quantity) * from '{path}')"""
        con.execute(f"copy ({query}) to '{os.path.join(out, table)}.parquet' (format parquet)")
    return out


@pytest.fixture(scope="module")
def oracle(folder):
    return oracle_connection(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, oracle, name, monkeypatch):
    search = neighbours._with_neighbour

    def with_low_limit(df, keys, time_col, tie_break, columns, hot_rows, forward):
        return search(df, keys, time_col, tie_break, columns, 30, forward)

    monkeypatch.setattr(neighbours, "_with_neighbour", with_low_limit)
    df = entry_point.queries()[name](spark, folder)
    assert differences(df, oracle, entry_point.oracle_sql()[name]) == []
