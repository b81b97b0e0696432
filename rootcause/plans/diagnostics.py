"""Theme -> diagnostic plan table (ops E1-E7).

Each complaint theme names a target table that is joined to the theme's
support-ticket cohort on ``user_id``, an optional categorical grouping column,
and the metrics to aggregate. Output aliases keep the unit suffix of the source
column (``_ms``, ``_bps``, ``_pct``, ``_hours``, ``_days``).

The severity rule (op F2) picks one row per theme: by the distance of every
metric from the users outside the cohort, in the direction that is bad for it
(``operators/severity.py``), or, without those, by the primary metric alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from rootcause.themes import AUTH_CLEARED


AGGREGATES = ("avg", "sum", "count")


@dataclass(frozen=True)
class Metric:
    alias: str
    agg: str          # "avg", "sum" or "count"
    column: str       # column of the target table (or of customer_support)
    source: str = "target"   # "target" or "support"
    high_is_bad: bool = True

    def __post_init__(self):
        if self.agg not in AGGREGATES or self.source not in ("target", "support"):
            raise ValueError(f"unknown aggregate or source: {self}")


@dataclass(frozen=True)
class DiagnosticPlan:
    theme: str
    target: str
    group_by: str | None
    metrics: tuple[Metric, ...]
    severity_metric: str
    severity_high_is_bad: bool
    healthy_key: str | None = None   # group key that is never the most severe

    @property
    def output_columns(self) -> list[str]:
        return ([self.group_by] if self.group_by else []) + [m.alias for m in self.metrics]


# The theme -> table -> metric definitions of the reference's
# diagnostic strategy, in the reference's order.
PLANS: dict[str, DiagnosticPlan] = {p.theme: p for p in [
    DiagnosticPlan(
        "EXECUTION_SLIPPAGE", "trades", None,
        (Metric("avg_price_slippage_bps", "avg", "price_slippage_bps", high_is_bad=False),
         Metric("avg_order_routing_latency_ms", "avg", "order_routing_latency_ms")),
        "avg_price_slippage_bps", False),
    DiagnosticPlan(
        "SYSTEM_STABILITY", "app_performance", None,
        (Metric("avg_api_5xx_error_rate_pct", "avg", "api_5xx_error_rate_pct"),
         Metric("avg_crash_loop_count_per_session", "avg", "crash_loop_count_per_session")),
        "avg_api_5xx_error_rate_pct", True),
    DiagnosticPlan(
        "LEDGER_DISPUTE", "financial_ledger", "txn_type",
        (Metric("txn_count", "count", "txn_id"),
         Metric("avg_balance_after_txn", "avg", "balance_after_txn", high_is_bad=False),
         Metric("avg_withdrawal_processing_latency_hours", "avg", "withdrawal_processing_latency_hours")),
        "avg_balance_after_txn", False),
    DiagnosticPlan(
        "CHARTING_UI_GLITCH", "app_performance", None,
        (Metric("avg_chart_render_latency_ms", "avg", "chart_render_latency_ms"),
         Metric("avg_websocket_drop_rate_pct", "avg", "websocket_drop_rate_pct")),
        "avg_chart_render_latency_ms", True),
    DiagnosticPlan(
        "LOGIN_AND_2FA_ISSUE", "users", "auth_bottleneck",
        (Metric("user_count", "count", "user_id"),),
        "user_count", True, AUTH_CLEARED),
    DiagnosticPlan(
        "KYC_ONBOARDING_EFFICIENCY", "users", "auth_bottleneck",
        (Metric("avg_kyc_processing_age_days", "avg", "kyc_processing_age_days"),
         Metric("user_count", "count", "user_id")),
        "avg_kyc_processing_age_days", True, AUTH_CLEARED),
    DiagnosticPlan(
        "GENERAL_INQUIRY", "users", None,
        (Metric("avg_ticket_resolution_time_hours", "avg", "ticket_resolution_time_hours", "support"),
         Metric("avg_support_interaction_count", "avg", "support_interaction_count", "support")),
        "avg_ticket_resolution_time_hours", True),
]}

# Columns that identify single rows; grouping by them defeats the aggregate.
ID_COLUMNS = ("session_id", "order_id", "txn_id", "user_id", "ticket_id")
UNIT_SUFFIXES = ("_ms", "_bps", "_pct", "_hours", "_days")
