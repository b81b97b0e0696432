"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The derived tables, the diagnostics, the cohorts and the units are written out
here as SQL over the driver tables; none of the engine's tables or code is used
but for the rule lists and reply texts that queries pass to either side. Floating
literals carry an ``e0`` exponent so DuckDB computes in double, like Spark.
"""

from __future__ import annotations

# The diagnostics by theme, written out here and not read from the
# engine's plan table: (theme, table, group column, [(alias, aggregate, column)],
# severity metric, high is bad, healthy group).
DIAGNOSTICS = [
    ("EXECUTION_SLIPPAGE", "trades", None,
     [("avg_price_slippage_bps", "avg", "trades.price_slippage_bps"),
      ("avg_order_routing_latency_ms", "avg", "trades.order_routing_latency_ms")],
     "avg_price_slippage_bps", False, None),
    ("SYSTEM_STABILITY", "app_performance", None,
     [("avg_api_5xx_error_rate_pct", "avg", "app_performance.api_5xx_error_rate_pct"),
      ("avg_crash_loop_count_per_session", "avg", "app_performance.crash_loop_count_per_session")],
     "avg_api_5xx_error_rate_pct", True, None),
    ("LEDGER_DISPUTE", "financial_ledger", "txn_type",
     [("txn_count", "count", "financial_ledger.txn_id"),
      ("avg_balance_after_txn", "avg", "financial_ledger.balance_after_txn"),
      ("avg_withdrawal_processing_latency_hours", "avg", "financial_ledger.withdrawal_processing_latency_hours")],
     "avg_balance_after_txn", False, None),
    ("CHARTING_UI_GLITCH", "app_performance", None,
     [("avg_chart_render_latency_ms", "avg", "app_performance.chart_render_latency_ms"),
      ("avg_websocket_drop_rate_pct", "avg", "app_performance.websocket_drop_rate_pct")],
     "avg_chart_render_latency_ms", True, None),
    ("LOGIN_AND_2FA_ISSUE", "users", "auth_bottleneck",
     [("user_count", "count", "users.user_id")],
     "user_count", True, "CLEARED"),
    ("KYC_ONBOARDING_EFFICIENCY", "users", "auth_bottleneck",
     [("avg_kyc_processing_age_days", "avg", "users.kyc_processing_age_days"),
      ("user_count", "count", "users.user_id")],
     "avg_kyc_processing_age_days", True, "CLEARED"),
    ("GENERAL_INQUIRY", "users", None,
     [("avg_ticket_resolution_time_hours", "avg", "customer_support.ticket_resolution_time_hours"),
      ("avg_support_interaction_count", "avg", "customer_support.support_interaction_count")],
     "avg_ticket_resolution_time_hours", True, None),
]

# Which users hold a ticket of which theme in the derived tables.
_COHORT_UNION = "\n  UNION ALL\n".join(
    f"  SELECT CAST({i} AS BIGINT) * 1000000000 + user_id AS ticket_id, user_id, "
    f"'{theme}' AS complaint_theme, "
    f"0.5e0 + ((user_id * 13) % 480) / 20.0e0 AS ticket_resolution_time_hours, "
    f"CAST({base} + user_id % 3 AS INTEGER) AS support_interaction_count "
    f"FROM users WHERE {pred}"
    for i, (theme, pred, base) in enumerate([
        ("KYC_ONBOARDING_EFFICIENCY", "kyc_status IN ('PENDING', 'REJECTED')", 4),
        ("LOGIN_AND_2FA_ISSUE", "auth_bottleneck = '2FA/OTP_NOT_RECEIVED'", 1),
        ("CHARTING_UI_GLITCH", "kyc_status = 'APPROVED' AND user_id % 6 = 0", 1),
        ("EXECUTION_SLIPPAGE", "kyc_status = 'APPROVED' AND user_id % 4 = 1", 1),
        ("SYSTEM_STABILITY", "kyc_status = 'APPROVED' AND user_id % 8 = 3", 1),
        ("LEDGER_DISPUTE", "kyc_status = 'APPROVED' AND user_id % 7 = 2", 1),
        ("GENERAL_INQUIRY", "kyc_status = 'APPROVED' AND user_id % 5 = 4", 1)]))

ADAPTER_CTES = f"""
users AS (
  SELECT c_custkey AS user_id,
    CASE WHEN c_mktsegment = 'BUILDING' THEN (CASE WHEN c_nationkey % 5 < 4 THEN 'PENDING' ELSE 'REJECTED' END)
         ELSE 'APPROVED' END AS kyc_status,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 14.0e0 + ((c_custkey * 37) % 311) / 10.0e0
         ELSE 0.5e0 + ((c_custkey * 37) % 26) / 10.0e0 END AS kyc_processing_age_days,
    CASE WHEN c_acctbal > 0 THEN c_acctbal * (CASE c_custkey % 4 WHEN 0 THEN 1.0e0 WHEN 1 THEN 2.0e0
         WHEN 2 THEN 4.0e0 ELSE 5.0e0 END) ELSE c_acctbal END AS margin_balance,
    c_acctbal AS total_ledger_balance,
    CASE WHEN c_mktsegment = 'BUILDING' THEN (CASE c_nationkey % 6 WHEN 0 THEN 'DOCUMENT_MISMATCH'
           WHEN 1 THEN 'RE_KYC_REQUIRED' WHEN 2 THEN 'SELFIE_VERIFICATION_FAILED'
           WHEN 3 THEN 'BANK_VERIFICATION_ISSUE' WHEN 4 THEN 'TECHNICAL_API_DELAY' ELSE 'COMPLIANCE_REVIEW' END)
         WHEN c_custkey % 7 = 0 THEN '2FA/OTP_NOT_RECEIVED' ELSE 'CLEARED' END AS auth_bottleneck
  FROM customer
),
ev_k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
app_performance AS (
  SELECT event_id AS session_id, user_id,
    CASE WHEN event_id % 2 = 0 THEN 'Android' ELSE 'iOS' END AS device_os,
    CAST(floor(epoch(ts)) AS BIGINT) AS session_start_ts,
    value * 10.0e0 AS chart_render_latency_ms,
    CAST(k AS DOUBLE) AS websocket_drop_rate_pct,
    CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS indicator_sync_status_flag,
    CASE WHEN event_type = 'error' THEN 15.0e0 + k * 0.3e0 ELSE 0.0e0 END AS api_5xx_error_rate_pct,
    CASE WHEN event_type = 'error' THEN 2 + k % 4 ELSE 0 END AS crash_loop_count_per_session
  FROM ev_k
),
trades_base AS (
  SELECT l_orderkey, o_custkey, l_partkey, l_quantity,
    CASE l_returnflag WHEN 'A' THEN 'BUY_' WHEN 'N' THEN 'SELL_' WHEN 'R' THEN 'STOP_LOSS_' END
      || CASE WHEN l_linestatus = 'F' THEN 'MARKET' ELSE 'LIMIT' END AS order_type,
    l_extendedprice / l_quantity AS requested_price,
    CASE WHEN l_linestatus = 'F' THEN -l_discount * 1000.0e0 ELSE l_tax * 100.0e0 END AS bps,
    l_quantity * 110.0e0 AS latency
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
trades AS (
  SELECT l_orderkey AS order_id, o_custkey AS user_id, order_type, requested_price,
    requested_price * (1.0e0 + (CASE WHEN order_type LIKE '%BUY%' THEN 1 ELSE -1 END) * (-bps) / 10000.0e0)
      AS executed_price,
    bps AS price_slippage_bps, latency AS order_routing_latency_ms,
    CASE WHEN latency > 5000 THEN 'FAILED TIMEOUT' WHEN l_partkey % 10 = 0 THEN 'INSUFFICIENT_DEPTH'
         WHEN l_partkey % 10 = 1 THEN 'INVALID_TICK_SIZE' ELSE 'NONE' END AS exchange_rejection_code
  FROM trades_base
),
ledger_events AS (
  SELECT o_orderkey AS txn_id, o_custkey AS user_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'MARGIN_PENALTY' WHEN '2-HIGH' THEN 'AUTO_SQUARE_OFF'
      WHEN '3-MEDIUM' THEN 'WITHDRAWAL' WHEN '4-NOT SPECIFIED' THEN 'DEPOSIT' WHEN '5-LOW' THEN 'AMC_FEE' END
      AS txn_type,
    o_totalprice AS amount, o_orderdate AS txn_ts, o_orderstatus
  FROM orders
),
financial_ledger AS (
  SELECT txn_id, user_id, txn_type, amount,
    CASE WHEN txn_type = 'DEPOSIT' THEN c_acctbal + amount ELSE c_acctbal - amount END AS balance_after_txn,
    10.0e0 + (txn_id % 170) AS peak_margin_utilization_pct,
    CASE WHEN txn_type = 'WITHDRAWAL' THEN 2.0e0 + (txn_id % 97) ELSE 0.0e0 END
      AS withdrawal_processing_latency_hours,
    CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS eod_ledger_sync_status_flag
  FROM ledger_events JOIN customer ON user_id = c_custkey
),
customer_support AS (
{_COHORT_UNION}
),
reviews AS (
  SELECT doc_id AS seq, source AS "userName", CAST(doc_id % 5 + 1 AS INTEGER) AS score,
    TIMESTAMP '2026-02-09 00:00:00' + to_seconds(doc_id) AS "at", text AS content
  FROM documents
)"""


def with_adapters(body: str, extra_ctes: str = "", recursive: bool = False) -> str:
    head = "WITH RECURSIVE" if recursive else "WITH"
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"{head}{ADAPTER_CTES}{extra}\n{body}"


def exact_avg_sql(ref: str) -> str:
    return f"CAST(SUM(CAST({ref} AS DECIMAL(18,6))) AS DOUBLE) / NULLIF(COUNT({ref}), 0)"


# The metrics of which a low value is the bad one.
LOW_IS_BAD = ("avg_price_slippage_bps", "avg_balance_after_txn")


def severity_ctes() -> str:
    """CTEs over ``dl`` and ``disp``: exact quantiles, group shares and the worst row by its distance from them."""
    measured, counted = [], []
    for theme, t, group, metrics, *_ in DIAGNOSTICS:
        outside = f"(SELECT user_id FROM customer_support WHERE complaint_theme = '{theme}' AND user_id IS NOT NULL)"
        for alias, agg, ref in metrics:
            table, col = ref.split(".")
            rows = f"FROM {table} WHERE user_id IS NULL OR user_id NOT IN {outside}"
            if agg == "count":
                counted.append(f"SELECT '{theme}' AS complaint_theme, '{alias}' AS metric, coalesce({group}, '') AS g, COUNT({col}) AS c "
                               f"{rows} GROUP BY 3")
            else:
                measured.append(f"SELECT '{theme}' AS complaint_theme, '{alias}' AS metric, list_sort(list(CAST({col} AS DOUBLE)) "
                                f"FILTER ({col} IS NOT NULL)) AS x {rows}")
    q = {p: f"x[CAST(ceil({p}e0 * len(x)) AS BIGINT)]" for p in ("0.05", "0.25", "0.5", "0.75", "0.95")}
    low = ", ".join(f"'{m}'" for m in LOW_IS_BAD)
    return (f"""outs AS ({' UNION ALL '.join(measured)}),
base AS (SELECT complaint_theme, metric, {q['0.5']} AS med, nullif(greatest(({q['0.75']} - {q['0.25']}) / 1.349e0,
  ({q['0.95']} - {q['0.05']}) / 3.29e0), 0.0e0) AS scale FROM outs),
shares AS ({' UNION ALL '.join(counted)}),
totals AS (SELECT complaint_theme, metric, SUM(c) AS c FROM shares GROUP BY ALL),
whole AS (SELECT complaint_theme, metric, SUM(n) AS n FROM dl WHERE agg = 'count' GROUP BY ALL),
far AS (SELECT d.*, CASE WHEN d.agg = 'count' THEN CAST(d.n AS DOUBLE) / CAST(w.n AS DOUBLE) END AS p,
  (coalesce(s.c, 0) + 0.5e0) / (CAST(t.c AS DOUBLE) + 1.0e0) AS u,
  (d.value - b.med) / coalesce(b.scale, 1.0e0) AS apart
  FROM disp d LEFT JOIN base b ON b.complaint_theme = d.complaint_theme AND b.metric = d.metric
  LEFT JOIN totals t ON t.complaint_theme = d.complaint_theme AND t.metric = d.metric
  LEFT JOIN whole w ON w.complaint_theme = d.complaint_theme AND w.metric = d.metric
  LEFT JOIN shares s ON s.complaint_theme = d.complaint_theme AND s.metric = d.metric AND s.g = coalesce(d.group_key, '')),
severe AS (SELECT *, CASE WHEN agg = 'count' THEN (p - u) / sqrt(u * (1.0e0 - u)) WHEN metric IN ({low}) THEN -apart ELSE apart END AS severity
  FROM far),
worst AS (SELECT complaint_theme, group_key, metric AS severity_metric, value AS severity_value, display AS severity_display, severity
  FROM (SELECT *, row_number() OVER (PARTITION BY complaint_theme ORDER BY value IS NULL,
    complaint_theme IN ('LOGIN_AND_2FA_ISSUE', 'KYC_ONBOARDING_EFFICIENCY') AND coalesce(group_key, '') = 'CLEARED',
    severity IS NULL, severity DESC, group_key, metric) AS rn FROM severe) s WHERE rn = 1)""")


def millionths_sql(ref: str) -> str:
    return f"SUM(CAST(CAST({ref} AS DECIMAL(18,6)) * 1000000 AS HUGEINT))"


def fmt_ratio_2dp_sql(s: str, n: str) -> str:
    """A sum of millionths over a count, to 2 decimals, half away from zero."""
    h = f"((abs({s}) + ({n}) * 5000) // (({n}) * 10000))"
    return (f"(CASE WHEN ({n}) > 0 THEN (CASE WHEN ({s}) < 0 AND {h} > 0 THEN '-' ELSE '' END) || "
            f"CAST({h} // 100 AS VARCHAR) || '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0') END)")


def unit_suffix_sql(name: str) -> str:
    """The unit printed after a metric, by the words of its name."""
    return (f"(CASE WHEN regexp_matches({name}, '(^|_)bps(_|$)') THEN ' bps' "
            f"WHEN regexp_matches({name}, '(^|_)ms(_|$)') THEN ' ms' "
            f"WHEN regexp_matches({name}, '(^|_)(pct|rate)(_|$)') THEN '%' "
            f"WHEN regexp_matches({name}, '(^|_)hours(_|$)') THEN ' hours' "
            f"WHEN regexp_matches({name}, '(^|_)days(_|$)') THEN ' days' ELSE '' END)")


def uniform_sql(key: str, salt: str) -> str:
    """The draw in [0, 1) from 52 bits of md5('<key>:<salt>')."""
    return f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 13))::BIGINT / 4503599627370496.0e0)"


def diagnose_sql(theme: str) -> str:
    _, t, group, metrics, *_ = next(d for d in DIAGNOSTICS if d[0] == theme)
    sel = [f"{t}.{group} AS {group}"] if group else []
    sel += [f"COUNT({ref}) AS {alias}" if agg == "count" else f"{exact_avg_sql(ref)} AS {alias}"
            for alias, agg, ref in metrics]
    body = (f"SELECT {', '.join(sel)} FROM {t} JOIN customer_support ON customer_support.user_id = {t}.user_id "
            f"WHERE customer_support.complaint_theme = '{theme}'")
    return body + (f" GROUP BY {t}.{group}" if group else "")


def diagnose_long_sql() -> str:
    """Tidy rows of all seven diagnostics, as a SELECT (no WITH); sums as millionths."""
    parts = []
    for theme, t, group, metrics, *_ in DIAGNOSTICS:
        gk = f"CAST({t}.{group} AS VARCHAR)" if group else "CAST(NULL AS VARCHAR)"
        for alias, agg, ref in metrics:
            v, s = ((f"CAST(COUNT({ref}) AS DOUBLE)", "CAST(NULL AS HUGEINT)") if agg == "count"
                    else (exact_avg_sql(ref), millionths_sql(ref)))
            parts.append(f"SELECT '{theme}' AS complaint_theme, {gk} AS group_key, '{alias}' AS metric, "
                         f"'{agg}' AS agg, {v} AS value, {s} AS millionths, COUNT({ref}) AS n "
                         f"FROM {t} JOIN customer_support ON customer_support.user_id = {t}.user_id "
                         f"WHERE customer_support.complaint_theme = '{theme}'"
                         + (f" GROUP BY {t}.{group}" if group else ""))
    return "\nUNION ALL\n".join(parts)


# The weighted reasons with the upper end of each one's share.
KYC_REASON_CUTS = [
    ("DOCUMENT_MISMATCH", "0.40e0"),
    ("RE_KYC_REQUIRED", "0.60e0"),
    ("SELFIE_VERIFICATION_FAILED", "0.75e0"),
    ("BANK_VERIFICATION_ISSUE", "0.85e0"),
    ("TECHNICAL_API_DELAY", "0.95e0"),
]


def kyc_reason_sql(u: str) -> str:
    whens = " ".join(f"WHEN {u} < {cut} THEN '{reason}'" for reason, cut in KYC_REASON_CUTS)
    return f"(CASE {whens} ELSE 'COMPLIANCE_REVIEW' END)"


def classify_sql(col: str, rules, default: str = "GENERAL_INQUIRY") -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({col}), '{p}') THEN '{label}'" for label, p in rules)
    return f"(CASE WHEN {col} IS NULL THEN NULL {whens} ELSE '{default}' END)"


def scope_sql(col: str, words: dict[str, str]) -> str:
    """The scope classifier: tokens to tags by a map, then the patterns."""
    from rootcause.plans.scoped import TOKEN_PATTERN, label_sql

    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"
    table = "MAP {" + ", ".join(f"{lit(w)}: '{t}'" for w, t in words.items()) + "}"
    mark = "CASE WHEN substr(w, 1, 1) IN ('.', '!', '?', chr(10)) THEN '.' WHEN substr(w, 1, 1) IN (';', ',', ':') THEN '|' "
    tags = (f"array_to_string(list_transform(regexp_extract_all(lower({col}), {lit(TOKEN_PATTERN)}), "
            f"lambda w: {mark} ELSE coalesce({table}[w], '_') END), '')")
    label = label_sql("t", lambda s, p: f"regexp_matches({s}, {lit(p)})", lambda s, p, by: f"regexp_replace({s}, {lit(p)}, {lit(by)}, 'g')")
    tags = f"replace(replace({tags}, 'Ny', 'Nd'), 'y', '|')"
    return f"(CASE WHEN {col} IS NOT NULL THEN list_transform([{tags}], lambda t: {label})[1] END)"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def preview_sql(x: str, n: int = 75) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END)"


def read_label_reply_sql(prompt: str) -> str:
    """The reply that depends on the prompt's MD5."""
    k = f"(('0x' || substr(md5({prompt}), 1, 8))::BIGINT)"
    return _label_reply_sql(k, f"('review ' || CAST({k} AS VARCHAR))")


def label_reply_sql(prompt_len: str) -> str:
    n = f"({prompt_len})"
    return _label_reply_sql(n, f"('review of ' || CAST({n} AS VARCHAR) || ' characters')")


def _label_reply_sql(n: str, why: str) -> str:
    from rootcause.plans.reply_models import LABEL_TEMPLATES, template_sql
    theme = (f"(CASE {n} % 7 WHEN 0 THEN 'EXECUTION_SLIPPAGE' WHEN 1 THEN 'LEDGER_DISPUTE' WHEN 2 THEN 'SYSTEM_STABILITY' "
             f"WHEN 3 THEN 'LOGIN_AND_2FA_ISSUE' WHEN 4 THEN 'KYC_ONBOARDING_EFFICIENCY' WHEN 5 THEN 'CHARTING_UI_GLITCH' "
             f"ELSE 'GENERAL_INQUIRY' END)")
    shape = f"(({n} // 7) % {len(LABEL_TEMPLATES)})"
    whens = " ".join(f"WHEN {shape} = {i} THEN {template_sql(t, W=why, T=theme)}"
                     for i, t in enumerate(LABEL_TEMPLATES))
    return f"(CASE {whens} END)"


def sql_reply_sql(text: str) -> str:
    from rootcause.plans.reply_models import SQL_TEMPLATES, template_sql
    shape = f"(length({text}) % {len(SQL_TEMPLATES)})"
    whens = " ".join(f"WHEN {shape} = {i} THEN {template_sql(t, X=text)}" for i, t in enumerate(SQL_TEMPLATES))
    return f"(CASE WHEN {text} IS NULL THEN NULL {whens} END)"


def extract_label_sql(reply: str) -> str:
    span = f"regexp_extract({reply}, '(?s)\\{{.*\\}}', 0)"
    return (f"(CASE WHEN {reply} IS NULL OR {span} = '' OR NOT json_valid({span}) THEN 'GENERAL_INQUIRY' "
            f"WHEN json_type({span}) <> 'OBJECT' THEN 'GENERAL_INQUIRY' "
            f"WHEN NOT json_exists({span}, '$.category') THEN 'GENERAL_INQUIRY' "
            f"ELSE json_extract_string({span}, '$.category') END)")


def extract_sql_sql(reply: str) -> str:
    stmt = strip_sql(f"regexp_extract({reply}, '(?is)\\bSELECT\\b.*?(?:;|$)', 0)")
    return f"(CASE WHEN {stmt} = '' THEN 'ERROR_GENERATING_SQL' ELSE {stmt} END)"
