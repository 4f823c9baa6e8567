"""Cleaning rules on small hand-made inputs."""

import json
import os
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from railpulse.operators import cleaning, quality
from railpulse.schemas import RAW_TRANSACTIONS
from railpulse.sources import tables

NOON = datetime(2026, 8, 1, 12, 0, 0)


def row(tid, bank="BNK004", amount="10.00", network="5G", ts=NOON, user="U1", status="SUCCESS"):
    code = "ERR_SUCCESS" if status == "SUCCESS" else "ERR_TD_01"
    return (tid, user, bank, "BNK002", amount, ts, "P2P", "D1", network, "APP1", status, code)


ROWS = [
    row("T1", bank="SBI"),
    row("T1", bank="SBI"),  # exact copy: a duplicate
    row("T2", bank=" state bank of india "),
    row("T3", bank="hdfc"),
    row("T4", bank="ICICI_BANK", network=""),
    row("T5", bank=" Unknown Bank "),
    row("T6", amount="-5"),  # invalid, before a valid row of its id
    row("T6", amount="7.50", network=None),
    row("T6", amount="0"),  # invalid amount after an accepted row: a duplicate
    row("T7", amount="abc"),
    row("T8", amount=None),
    row("T9", amount="NaN"),
    row("T10", amount=" 12.5 "),
    row("T11", amount="1e3", bank=None),
]


@pytest.fixture(scope="module")
def raw(spark):
    numbered = [(*r, i) for i, r in enumerate(ROWS)]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_TRANSACTIONS) + ", ingest_seq bigint"
    return spark.createDataFrame(numbered, ddl).repartition(5)


def test_clean_transactions(raw):
    got = {r.transaction_id: r for r in cleaning.clean_transactions(raw).collect()}
    assert sorted(got) == ["T1", "T10", "T11", "T2", "T3", "T4", "T5", "T6"]
    banks = {t: got[t].payer_bank_id for t in got}
    assert banks["T1"] == banks["T2"] == "BNK001"
    assert banks["T3"] == "BNK002" and banks["T4"] == "BNK003"
    assert banks["T5"] == "Unknown Bank" and banks["T11"] is None
    assert got["T4"].network_type == got["T6"].network_type == "4G"
    assert got["T6"].amount == Decimal("7.50")
    assert got["T10"].amount == Decimal("12.50") and got["T11"].amount == Decimal("1000.00")


def test_clean_view_keeps_unknown_banks_untrimmed(raw):
    got = {r.transaction_id: r for r in cleaning.clean_view(raw).collect()}
    assert got["T5"].payer_bank_id == " Unknown Bank "
    assert got["T2"].payer_bank_id == "BNK001"


def test_audit(raw):
    a = quality.dq_audit_summary(raw).first().asDict()
    assert a == {
        "raw_transaction_count": 14,
        "duplicate_transactions_removed": 2,
        "inconsistent_bank_names_standardized": 4,
        "invalid_amounts_dropped": 4,
        "missing_values_imputed": 2,
        "processed_transaction_count": 8,
    }


def test_audit_of_nothing(raw):
    a = quality.dq_audit_summary(raw.limit(0)).first()
    assert list(a) == [0, 0, 0, 0, 0, 0]


def test_dedup_limits_groups_before_the_shuffle(raw):
    plan = cleaning.clean_view(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_amounts_are_judged_before_rounding(spark):
    texts = ["0.004", "0", "-0.01", "9999999999999999.99", "10000000000000000", "Infinity", "", "1,5", "+3"]
    df = spark.createDataFrame([(t,) for t in texts], "amount string")
    got = [tuple(r) for r in df.select(quality.valid_amount(), quality.parsed_amount()).collect()]
    assert [valid for valid, _ in got] == [True, False, False, True, False, False, False, False, True]
    assert got[0][1] == Decimal("0.00") and got[3][1] == Decimal("9999999999999999.99") and got[4][1] is None


def test_earliest_by_time_wins(spark, raw):
    late, early = row("A", amount="1", ts=datetime(2026, 8, 2)), row("A", amount="2", ts=NOON)
    df = spark.createDataFrame([(*late, 0), (*early, 1)], raw.schema)
    assert cleaning.clean_view(df).first().amount == Decimal("2.00")
    assert cleaning.clean_transactions(df).first().amount == Decimal("1.00")


def test_missing_counts_blank_and_null(raw):
    m = quality.dq_missing(raw).first()
    assert (m.missing_networks, m.missing_payer_banks, m.missing_users) == (2, 1, 0)


def test_aliases_are_case_sensitive_in_the_audit(raw):
    got = {r.payer_bank_id: r.data_quality_status for r in quality.dq_bank_aliases(raw).collect()}
    assert got["SBI"].startswith("Map to BNK001")
    assert got["hdfc"] == "Unknown Bank Alias"
    assert None not in got


def test_stage_events_of_dropped_payments_go(spark, raw):
    stages = spark.createDataFrame([("T1", 1), ("T1", 1), ("T7", 1), ("T99", 2)], "transaction_id string, stage_id int")
    kept = cleaning.clean_stage_events(stages, cleaning.clean_transactions(raw))
    assert [r.transaction_id for r in kept.collect()] == ["T1", "T1"]


def _write_raw_csv(folder):
    def save(name, lines):
        with open(os.path.join(folder, f"{name}.csv"), "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")

    save("banks", ["bank_id,bank_name,bank_type", "BNK001,First,PSU"])
    save("error_codes", ["error_code,error_category,error_description,technical_or_business_decline", "E,C,D,T"])
    save("devices", ["device_id,operating_system,os_version,device_category", "D1,Android,11,Budget", "D2,iOS,16.5,Premium"])
    save("users", ["user_id,signup_date,user_segment,state,age_group,tenure_days", "U1,2024-01-31,New,Delhi,18-24,200"])
    head = "transaction_id,user_id,payer_bank_id,payee_bank_id,amount,timestamp,transaction_type,device_id,network_type,payment_app,final_status,failure_code"
    save(
        "transactions",
        [
            head,
            "T1,U1,SBI,BNK002,10.50,2026-08-01 12:00:00,P2P,D1,,APP1,SUCCESS,ERR_SUCCESS",
            "T1,U1,BNK009,BNK002,10.50,2026-08-01 12:00:00,P2P,D1,,APP1,SUCCESS,ERR_SUCCESS",
            "T2,U1,BNK003,BNK002,oops,2026-08-01 12:00:00,P2P,D1,4G,APP1,SUCCESS,ERR_SUCCESS",
        ],
    )
    save(
        "stage_events",
        [
            "transaction_id,stage_id,event_timestamp,stage_status,error_code",
            "T1,1,2026-08-01 12:00:00.250,SUCCESS,",
            "T2,1,2026-08-01 12:00:00.250,SUCCESS,",
        ],
    )


def test_files_end_to_end(spark, tmp_path):
    raw_dir, out = str(tmp_path / "raw"), str(tmp_path / "clean")
    os.makedirs(raw_dir)
    _write_raw_csv(raw_dir)
    raw = tables.read_raw(spark, raw_dir)
    tx = tables.with_file_order(raw["transactions"])
    clean = cleaning.clean_transactions(tx)
    tables.write_table(clean, out, "transactions")
    tables.write_table(cleaning.clean_stage_events(raw["stage_events"], clean), out, "stage_events")
    tables.publish_dims(spark, raw_dir, out)
    summary = tables.write_summary(quality.dq_audit_summary(tx), out)

    read = tables.read_clean(spark, out)
    first = read["transactions"].first()
    assert read["transactions"].count() == 1
    assert (first.payer_bank_id, first.network_type, first.timestamp) == ("BNK001", "4G", NOON)
    assert read["stage_events"].first().event_timestamp == datetime(2026, 8, 1, 12, 0, 0, 250_000)
    assert [r.os_version for r in read["devices"].orderBy("device_id").collect()] == ["11", "16.5"]
    part = next(p for p in os.listdir(summary) if p.endswith(".json"))
    with open(os.path.join(summary, part), encoding="utf-8") as f:
        assert json.load(f)["duplicate_transactions_removed"] == 1

    tables.register_views({**read, "raw_transactions": raw["transactions"]})
    assert spark.sql("select payer_bank_id from clean_transactions_view").count() == 1
    assert spark.sql("select count(*) from clean_transactions").first()[0] == 1


def test_order_over_several_files(spark, tmp_path):
    folder = tmp_path / "raw files"  # a path that is written differently in addresses
    folder.mkdir()
    for part in range(3):
        lines = [f"P{part}-{line},{'x' * 50}" for line in range(40)]
        (folder / f"part-{part}.csv").write_text("\n".join(["id,filler", *lines, ""]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = tables.with_file_order(spark.read.csv(str(folder), header=True))
        got = [r.id for r in df.orderBy("ingest_seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"P{part}-{line}" for part in range(3) for line in range(40)]


def test_audit_in_file_order_needs_no_sort(spark, tmp_path):
    raw_dir = str(tmp_path / "raw")
    os.makedirs(raw_dir)
    _write_raw_csv(raw_dir)
    audit = quality.dq_audit_summary(tables.with_file_order(tables.read_raw(spark, raw_dir)["transactions"]))
    assert "SortAggregate" not in audit._jdf.queryExecution().executedPlan().toString()


def test_wrong_header_is_refused(spark, tmp_path):
    path = tmp_path / "banks.csv"
    path.write_text("bank_id,bank_type,bank_name\nB,PSU,First\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_csv(spark, str(path), tables.CLEAN_SCHEMAS["banks"]).select(F.col("*")).collect()
