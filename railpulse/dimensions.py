"""Fixed reference data: small dimension tables, labels and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values ------------------------------------------------------------
# Codes, names and labels below are part of the data model; results must carry
# exactly these values.

BANKS = [
    ("BNK001", "State Bank of India", "PSU"),
    ("BNK002", "HDFC Bank", "Private"),
    ("BNK003", "ICICI Bank", "Private"),
    ("BNK004", "Axis Bank", "Private"),
    ("BNK005", "Bank of Baroda", "PSU"),
    ("BNK006", "Punjab National Bank", "PSU"),
    ("BNK007", "Paytm Payments Bank", "Payments Bank"),
    ("BNK008", "Airtel Payments Bank", "Payments Bank"),
    ("BNK009", "Canara Bank", "PSU"),
    ("BNK010", "Kotak Mahindra Bank", "Private"),
]

ERROR_CODES = [
    ("ERR_SUCCESS", "Success", "Transaction completed successfully", "N/A"),
    ("ERR_TD_01", "Technical Decline", "Core Banking Server (CBS) Timeout / Unresponsive", "Technical Decline"),
    ("ERR_TD_02", "Technical Decline", "NPCI Switch Timeout", "Technical Decline"),
    ("ERR_TD_03", "Technical Decline", "Bank CBS Connection Failure", "Technical Decline"),
    ("ERR_BD_01", "Business Decline", "Insufficient Balance in Account", "Business Decline"),
    ("ERR_BD_02", "Business Decline", "Invalid UPI PIN / Incorrect MPIN", "Business Decline"),
    ("ERR_BD_03", "Business Decline", "Daily Transaction Amount Limit Exceeded", "Business Decline"),
    ("ERR_BD_04", "Business Decline", "Daily Transaction Count Limit Exceeded", "Business Decline"),
    ("ERR_BD_05", "Business Decline", "Account Inactive / Frozen", "Business Decline"),
    ("ERR_NET_01", "Timeout/Network", "Network Connectivity Interrupted / Gateway Timeout", "Technical Decline"),
    ("ERR_NET_02", "Timeout/Network", "Client Payment App Request Timeout", "Technical Decline"),
]

STAGES = [
    (1, "1. INITIATED"),
    (2, "2. REQUEST_SENT"),
    (3, "3. AUTHENTICATION"),
    (4, "4. BANK_PROCESSING"),
    (5, "5. AUTHORIZATION"),
    (6, "6. CONFIRMATION"),
    (7, "7. COMPLETED"),
]

# Spellings of a payer bank, upper-cased and trimmed, and the id they stand for.
BANK_ALIASES = {
    "SBI": "BNK001",
    "STATE BANK OF INDIA": "BNK001",
    "HDFC BANK": "BNK002",
    "HDFC": "BNK002",
    "ICICI_BANK": "BNK003",
    "ICICI": "BNK003",
}

# What the audit says about a spelling, matched case-sensitively.
ALIAS_ADVICE = {
    "SBI": "Map to BNK001 (State Bank of India)",
    "State Bank Of India": "Map to BNK001 (State Bank of India)",
    "HDFC BANK": "Map to BNK002 (HDFC Bank)",
    "hdfc bank": "Map to BNK002 (HDFC Bank)",
    "ICICI_BANK": "Map to BNK003 (ICICI Bank)",
}
UNKNOWN_ALIAS = "Unknown Bank Alias"
DUPLICATES = "Duplicate Transactions"
DUPLICATE_ADVICE = "De-duplicate by taking FIRST_VALUE by timestamp"
AMOUNT_ADVICE = "Filter out amount <= 0"

DEFAULT_NETWORK = "4G"

SUCCESS, FAILED = "SUCCESS", "FAILED"
TECHNICAL, BUSINESS, TIMEOUT = "Technical Decline", "Business Decline", "Timeout/Network"
TD_CODES, BD_CODES = "ERR_TD%", "ERR_BD%"

# Evening peak hours, both ends included.
PEAK_HOURS = (19, 21)
HOUR_WINDOWS = [
    (19, 21, "Evening Peak (19:00-21:00)"),
    (12, 14, "Afternoon Peak (12:00-14:00)"),
    (1, 5, "Off-Peak Night"),
]
OTHER_HOURS = "Normal Hours"
PEAK_LABEL, OFF_PEAK_LABEL = "Evening Peak Hours (7 PM - 9 PM)", "Non-Peak Hours"

# Amount buckets: closed intervals as published. They leave gaps (500.50 is in
# none), and whatever no interval holds goes to the last label.
MICRO_LIMIT, MICRO_LABEL = 100, "1. Micro (< Rs 100)"
AMOUNT_BUCKETS = [
    (100, 500, "2. Small (Rs 100 - 500)"),
    (501, 2000, "3. Medium (Rs 501 - 2000)"),
    (2001, 10000, "4. High (Rs 2001 - 10000)"),
]
LARGE_LABEL = "5. Very High (> Rs 10000)"

# Age groups and networks of the data model.
AGE_GROUPS = ["18-24", "25-34", "35-44", "45-59", "60+"]
NETWORKS = ["4G", "5G", "WiFi", "3G"]

# Retry policy.
AUTO_RETRY = "RECOMMENDED FOR AUTO-RETRY / SMART RETRY"
NO_RETRY = "DO NOT AUTO-RETRY (Hard Business Decline / Security / Balance)"
MANUAL_RETRY = "MANUAL RETRY ONLY"
NO_RETRY_CODES = ["ERR_BD_01", "ERR_BD_02", "ERR_BD_03"]

# Soft business decline: a mistyped PIN can be re-entered.
SOFT_DECLINE_CODES = ["ERR_BD_02"]

# Recovery scenarios: name, recovered share of technical, of soft business value.
SCENARIOS = [
    ("conservative", 0.15, 0.10),
    ("base_case", 0.35, 0.25),
    ("optimistic", 0.60, 0.45),
]

# Status chart labels; their percentages are part of the published label text.
STATUS_LABELS = {
    "success": "Success (90.42%)",
    "technical": "Technical Decline (4.68%)",
    "business": "Business Decline (3.82%)",
    "network": "Network Timeout (1.08%)",
}

# Upper limits for the KPI checks, in percent.
KPI_LIMITS = [
    ("technical_decline_rate", 1.0),
    ("duplicate_payment_rate", 0.01),
]
# Rollback triggers of the experiment: duplicate rate in percent, and points by which
# the treatment's drop-off exceeds the control's.
DUPLICATE_RATE = "duplicate_payment_rate"
ROLLBACK_LIMITS = [
    (DUPLICATE_RATE, 0.01),
    ("dropoff_increase", 0.5),
]
# --- End of fixed values -----------------------------------------------------

BANK_NAMES = [name for _, name, _ in BANKS]


def sql_literal(value) -> str:
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values_sql(rows: list[tuple]) -> str:
    """Rows as the body of a VALUES clause."""
    return ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)


def inline(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A literal relation. Its size is known to the optimizer, so joins with it
    become broadcasts on their own and no hint is needed."""
    return spark.sql(f"SELECT * FROM VALUES {values_sql(rows)} AS t({columns})")


def banks(spark: SparkSession) -> DataFrame:
    return inline(spark, BANKS, "bank_id, bank_name, bank_type")


def error_codes(spark: SparkSession) -> DataFrame:
    return inline(
        spark,
        ERROR_CODES,
        "error_code, error_category, error_description, technical_or_business_decline",
    )


def stage_names(spark: SparkSession) -> DataFrame:
    return inline(spark, STAGES, "stage_id, stage_name")
