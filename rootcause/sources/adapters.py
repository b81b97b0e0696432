"""Map the driver's TPC-H-style tables onto the logical schemas.

The telemetry tables of the application (users, app_performance, trades,
financial_ledger, customer_support) and the review feed are derived, lazily,
from ``customer``, ``events``, ``lineitem``, ``orders`` and ``documents``. The
rules are deterministic functions of keys, so every engine derives identical
rows; on real data these views are replaced by the real tables.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootcause.functions.finance import executed_price, rejection_code
from rootcause.schemas import conform
from rootcause.session import ensure_parallelism
from rootcause.themes import AUTH_CLEARED, AUTH_OTP, KYC_REASONS, THEMES

SOURCE_TABLES = ("customer", "orders", "lineitem", "events", "documents")

# Fixed values of the adapter (the mapping itself, see FIXTURES.md section 3).
KYC_SEGMENT = "BUILDING"
LEVERAGE = [1.0, 2.0, 4.0, 5.0]
TXN_BY_PRIORITY = [
    ("1-URGENT", "MARGIN_PENALTY"),
    ("2-HIGH", "AUTO_SQUARE_OFF"),
    ("3-MEDIUM", "WITHDRAWAL"),
    ("4-NOT SPECIFIED", "DEPOSIT"),
    ("5-LOW", "AMC_FEE"),
]
SIDE_BY_RETURNFLAG = [("A", "BUY_"), ("N", "SELL_"), ("R", "STOP_LOSS_")]
REVIEW_EPOCH = "2026-02-09 00:00:00"

# Cohort of each theme: (theme, predicate on the users table, base interaction count).
COHORTS = [
    ("KYC_ONBOARDING_EFFICIENCY", "kyc_status <> 'APPROVED'", 4),
    ("LOGIN_AND_2FA_ISSUE", f"auth_bottleneck = '{AUTH_OTP}'", 1),
    ("CHARTING_UI_GLITCH", "kyc_status = 'APPROVED' AND user_id % 6 = 0", 1),
    ("EXECUTION_SLIPPAGE", "kyc_status = 'APPROVED' AND user_id % 4 = 1", 1),
    ("SYSTEM_STABILITY", "kyc_status = 'APPROVED' AND user_id % 8 = 3", 1),
    ("LEDGER_DISPUTE", "kyc_status = 'APPROVED' AND user_id % 7 = 2", 1),
    ("GENERAL_INQUIRY", "kyc_status = 'APPROVED' AND user_id % 5 = 4", 1),
]
TICKET_ID_STRIDE = 1_000_000_000

assert sorted(t for t, _, _ in COHORTS) == sorted(THEMES)


def read_sources(spark: SparkSession, sf_dir: str, names=SOURCE_TABLES, spread: bool = False) -> dict[str, DataFrame]:
    """Read driver tables; with ``spread``, a table read as fewer partitions
    than there are cores is dealt out across them (see ``ensure_parallelism``).
    Only worth it ahead of CPU-heavy per-row work (regex over long texts):
    for cheap columns the extra exchange costs more than it saves."""
    out = {}
    for n in names:
        df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet")
        # The first column is the table's key (doc_id, c_custkey, ...).
        out[n] = ensure_parallelism(df, keys=[df.columns[0]]) if spread else df
    return out


def _pick(col, pairs, default=None):
    """CASE col WHEN k THEN v ... END from a list of pairs."""
    out = F.lit(default)
    for k, v in reversed(pairs):
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def users(customer: DataFrame) -> DataFrame:
    c = customer
    kyc = F.col("c_mktsegment") == KYC_SEGMENT
    key = F.col("c_custkey")
    lev = _pick(key % 4, list(enumerate(LEVERAGE)))
    reason = _pick(F.col("c_nationkey") % 6, list(enumerate(KYC_REASONS)))
    df = c.select(
        key.alias("user_id"),
        F.when(kyc, F.when(F.col("c_nationkey") % 5 < 4, "PENDING").otherwise("REJECTED"))
         .otherwise("APPROVED").alias("kyc_status"),
        F.when(kyc, F.lit(14.0) + (key * 37 % 311) / F.lit(10.0))
         .otherwise(F.lit(0.5) + (key * 37 % 26) / F.lit(10.0)).alias("kyc_processing_age_days"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * lev)
         .otherwise(F.col("c_acctbal")).alias("margin_balance"),
        F.col("c_acctbal").alias("total_ledger_balance"),
        F.when(kyc, reason).when(key % 7 == 0, F.lit(AUTH_OTP))
         .otherwise(F.lit(AUTH_CLEARED)).alias("auth_bottleneck"),
    )
    return conform(df, "users")


def app_performance(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    err = F.col("event_type") == "error"
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    df = events.select(
        F.col("event_id").alias("session_id"),
        F.col("user_id"),
        F.when(F.col("event_id") % 2 == 0, "Android").otherwise("iOS").alias("device_os"),
        F.timestamp_diff("SECOND", epoch, F.col("ts").cast("timestamp_ntz")).alias("session_start_ts"),
        (F.col("value") * F.lit(10.0)).alias("chart_render_latency_ms"),
        k.cast("double").alias("websocket_drop_rate_pct"),
        F.when(F.col("event_type") == "view", 0).otherwise(1).alias("indicator_sync_status_flag"),
        F.when(err, F.lit(15.0) + k * F.lit(0.3)).otherwise(F.lit(0.0)).alias("api_5xx_error_rate_pct"),
        F.when(err, F.lit(2) + k % 4).otherwise(F.lit(0)).alias("crash_loop_count_per_session"),
    )
    return conform(df, "app_performance")


def trades(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    li = lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice",
                         "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    o = orders.select(F.col("o_orderkey"), F.col("o_custkey"))
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    market = F.col("l_linestatus") == "F"
    order_type = F.concat(_pick(F.col("l_returnflag"), SIDE_BY_RETURNFLAG),
                          F.when(market, "MARKET").otherwise("LIMIT"))
    requested = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    bps = F.when(market, -F.col("l_discount") * F.lit(1000.0)).otherwise(F.col("l_tax") * F.lit(100.0))
    latency = F.col("l_quantity") * F.lit(110.0)
    base_code = (F.when(F.col("l_partkey") % 10 == 0, "INSUFFICIENT_DEPTH")
                 .when(F.col("l_partkey") % 10 == 1, "INVALID_TICK_SIZE").otherwise("NONE"))
    df = j.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        order_type.alias("order_type"),
        requested.alias("requested_price"),
        executed_price(order_type, requested, bps).alias("executed_price"),
        bps.alias("price_slippage_bps"),
        latency.alias("order_routing_latency_ms"),
        rejection_code(latency, base_code).alias("exchange_rejection_code"),
    )
    return conform(df, "trades")


def ledger_events(orders: DataFrame) -> DataFrame:
    """Ledger transactions with their replay order (o_orderdate, o_orderkey)."""
    return orders.select(
        F.col("o_orderkey").alias("txn_id"),
        F.col("o_custkey").alias("user_id"),
        _pick(F.col("o_orderpriority"), TXN_BY_PRIORITY).alias("txn_type"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("txn_ts"),
        F.col("o_orderstatus"),
    )


def financial_ledger(orders: DataFrame, customer: DataFrame) -> DataFrame:
    ev = ledger_events(orders)
    c = customer.select(F.col("c_custkey"), F.col("c_acctbal"))
    j = ev.join(c, ev.user_id == c.c_custkey, "inner")
    wd = F.col("txn_type") == "WITHDRAWAL"
    df = j.select(
        "txn_id", "user_id", "txn_type", "amount",
        F.when(F.col("txn_type") == "DEPOSIT", F.col("c_acctbal") + F.col("amount"))
         .otherwise(F.col("c_acctbal") - F.col("amount")).alias("balance_after_txn"),
        (F.lit(10.0) + (F.col("txn_id") % 170)).alias("peak_margin_utilization_pct"),
        F.when(wd, F.lit(2.0) + (F.col("txn_id") % 97)).otherwise(F.lit(0.0))
         .alias("withdrawal_processing_latency_hours"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("eod_ledger_sync_status_flag"),
    )
    return conform(df, "financial_ledger")


def customer_support(users_df: DataFrame) -> DataFrame:
    """One ticket per (user, theme) whose cohort predicate holds (op G11)."""
    from rootcause.operators.cohorts import cohort_tickets
    return cohort_tickets(users_df, COHORTS, TICKET_ID_STRIDE)


def reviews(documents: DataFrame) -> DataFrame:
    """Review feed with its arrival sequence ``seq``."""
    return documents.select(
        F.col("doc_id").alias("seq"),
        F.col("source").alias("userName"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("score"),
        (F.lit(REVIEW_EPOCH).cast("timestamp_ntz")
         + F.make_dt_interval(secs=F.col("doc_id").cast("decimal(18,6)"))).alias("at"),
        F.col("text").alias("content"),
    )


# Lazy view definitions per session and folder: a session defines its tables
# once, as an application registers its views once. Only plans are kept here;
# every query still reads the files.
_VIEWS: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def _memo(spark: SparkSession, key, build):
    views = _VIEWS.setdefault(spark, {})
    if key not in views:
        views[key] = build()
    return views[key]


def telemetry_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five logical tables, lazily derived from the driver tables."""
    return dict(_memo(spark, ("telemetry", sf_dir), lambda: _build_telemetry(spark, sf_dir)))


def _build_telemetry(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    src = read_sources(spark, sf_dir, ("customer", "orders", "lineitem", "events"))
    u = users(src["customer"])
    return {
        "users": u,
        "app_performance": app_performance(src["events"]),
        "trades": trades(src["lineitem"], src["orders"]),
        "financial_ledger": financial_ledger(src["orders"], src["customer"]),
        "customer_support": customer_support(u),
    }


def review_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo(spark, ("reviews", sf_dir),
                 lambda: reviews(read_sources(spark, sf_dir, ("documents",), spread=True)["documents"]))
