"""Fixed schemas of the review files and the five telemetry tables (op A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

REVIEW_SCHEMA = T.StructType([
    T.StructField("userName", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("at", T.TimestampNTZType()),
    T.StructField("content", T.StringType()),
])

CATEGORY_COL = "ai_complaint_category"

CATEGORISED_REVIEW_SCHEMA = T.StructType(
    REVIEW_SCHEMA.fields + [T.StructField(CATEGORY_COL, T.StringType())])

_L, _D, _S, _I = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType()


def _struct(*cols):
    return T.StructType([T.StructField(n, t) for n, t in cols])


TABLE_SCHEMAS: dict[str, T.StructType] = {
    "users": _struct(
        ("user_id", _L), ("kyc_status", _S), ("kyc_processing_age_days", _D),
        ("margin_balance", _D), ("total_ledger_balance", _D), ("auth_bottleneck", _S)),
    "app_performance": _struct(
        ("session_id", _L), ("user_id", _L), ("device_os", _S), ("session_start_ts", _L),
        ("chart_render_latency_ms", _D), ("websocket_drop_rate_pct", _D),
        ("indicator_sync_status_flag", _I), ("api_5xx_error_rate_pct", _D),
        ("crash_loop_count_per_session", _I)),
    "trades": _struct(
        ("order_id", _L), ("user_id", _L), ("order_type", _S), ("requested_price", _D),
        ("executed_price", _D), ("price_slippage_bps", _D), ("order_routing_latency_ms", _D),
        ("exchange_rejection_code", _S)),
    "financial_ledger": _struct(
        ("txn_id", _L), ("user_id", _L), ("txn_type", _S), ("amount", _D),
        ("balance_after_txn", _D), ("peak_margin_utilization_pct", _D),
        ("withdrawal_processing_latency_hours", _D), ("eod_ledger_sync_status_flag", _I)),
    "customer_support": _struct(
        ("ticket_id", _L), ("user_id", _L), ("complaint_theme", _S),
        ("ticket_resolution_time_hours", _D), ("support_interaction_count", _I)),
}

# Declared keys: primary key per table, and the user_id foreign key of the
# four child tables to users.user_id.
PRIMARY_KEYS = {
    "users": "user_id",
    "app_performance": "session_id",
    "trades": "order_id",
    "financial_ledger": "txn_id",
    "customer_support": "ticket_id",
}
FOREIGN_KEYS = {t: ("user_id", "users", "user_id")
                for t in ("app_performance", "trades", "financial_ledger", "customer_support")}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project and cast ``df`` to the fixed schema of table ``name``."""
    return df.to(TABLE_SCHEMAS[name])
