"""Declared schemas of the payment tables; nothing is inferred at load."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_S = T.StringType()

USERS = _struct(
    ("user_id", _S),
    ("signup_date", T.DateType()),
    ("user_segment", _S),
    ("state", _S),
    ("age_group", _S),
    ("tenure_days", T.IntegerType()),
)

TRANSACTIONS = _struct(
    ("transaction_id", _S),
    ("user_id", _S),
    ("payer_bank_id", _S),
    ("payee_bank_id", _S),
    ("amount", MONEY),
    ("timestamp", T.TimestampNTZType()),
    ("transaction_type", _S),
    ("device_id", _S),
    ("network_type", _S),
    ("payment_app", _S),
    ("final_status", _S),
    ("failure_code", _S),
)

# Raw attempts keep the amount as text: parsing it is a cleaning rule.
RAW_TRANSACTIONS = T.StructType(
    [T.StructField(f.name, _S if f.name == "amount" else f.dataType, True) for f in TRANSACTIONS]
)

STAGE_EVENTS = _struct(
    ("transaction_id", _S),
    ("stage_id", T.IntegerType()),
    ("event_timestamp", T.TimestampNTZType()),
    ("stage_status", _S),
    ("error_code", _S),
)

BANKS = _struct(("bank_id", _S), ("bank_name", _S), ("bank_type", _S))

# os_version stays text: "11" and "16.5" would otherwise become numbers.
DEVICES = _struct(
    ("device_id", _S),
    ("operating_system", _S),
    ("os_version", _S),
    ("device_category", _S),
)

ERROR_CODES = _struct(
    ("error_code", _S),
    ("error_category", _S),
    ("error_description", _S),
    ("technical_or_business_decline", _S),
)

TRANSACTION_COLUMNS = [f.name for f in TRANSACTIONS]
STAGE_EVENT_COLUMNS = [f.name for f in STAGE_EVENTS]

STATIC_TABLES = {
    "banks": BANKS,
    "error_codes": ERROR_CODES,
    "devices": DEVICES,
    "users": USERS,
}
