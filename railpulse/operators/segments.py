"""Reliability by platform, network, payment type and amount."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railpulse.functions import flags
from railpulse.functions.numbers import percent
from railpulse.operators.tallies import is_rolled_up, outcome_cells, tally, txns_where, weighted, with_codes


def os_network(tx: DataFrame, devices: DataFrame, error_codes: DataFrame) -> DataFrame:
    """Volume, success, timeout and wide technical rate per operating system and
    network type.

    Attempts are reduced to one row per device, network and outcome before codes
    are joined, and to one per device and network before devices are, so neither a
    hot code nor a hot device is a hot join key.
    """
    cells = with_codes(outcome_cells(tx, "device_id", "network_type"), error_codes)
    per_device = cells.groupBy("device_id", "network_type").agg(
        F.sum("cell_txns").alias("n"),
        txns_where(flags.succeeded()).alias("ok"),
        txns_where(flags.timed_out()).alias("timeout"),
        txns_where(flags.technical_by_type()).alias("td"),
    )
    t = (
        per_device.join(devices, "device_id")
        .groupBy("operating_system", "network_type")
        .agg(*[F.sum(c).alias(c) for c in ("n", "ok", "timeout", "td")])
    )
    return t.select(
        "operating_system",
        "network_type",
        F.col("n").alias("total_volume"),
        percent("ok", "n").alias("psr_percentage"),
        percent("timeout", "n").alias("network_timeout_rate"),
        percent("td", "n").alias("technical_decline_rate"),
    ).orderBy("operating_system", F.desc("total_volume"), "network_type")


def type_amount_matrix(tx: DataFrame, contiguous: bool = False) -> DataFrame:
    """Volume, success and value at risk per payment type and amount bucket.

    Hourly cells carry the published buckets, so ``contiguous`` needs attempts.
    """
    if is_rolled_up(tx) and not contiguous:
        bucket = F.col("amount_bucket")
    else:
        bucket = flags.amount_bucket(F.col("amount"), contiguous).alias("amount_bucket")
    t = tally(weighted(tx), "transaction_type", bucket)
    return t.select(
        "transaction_type",
        "amount_bucket",
        F.col("total").alias("transaction_volume"),
        F.col("success").alias("successful_volume"),
        percent("success", "total").alias("psr_percentage"),
        F.col("failed_value").cast("double").alias("value_at_risk_inr"),
    ).orderBy("transaction_type", "amount_bucket")
