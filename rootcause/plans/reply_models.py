"""Deterministic stand-ins for the hosted model, for tests and registered queries.

Replies are pure functions of the prompt length, rendered from the templates
below (``@W`` reasoning, ``@T`` theme, ``@X`` the prompt text), so they can be
restated in SQL. They cover the reply shapes the extraction rules must handle:
clean JSON, fenced or chatty JSON, no braces, missing or mis-cased key, single
quotes, a raw newline inside a string, two objects, an extra closing brace, an
explicit null and an off-taxonomy label; and for SQL: a clean statement, a
code fence without ';', a leading WITH, no statement, a ';' inside a literal,
and a statement running to the end of the reply.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd

from rootcause.plans.diagnostics import PLANS
from rootcause.themes import THEMES

LABEL_TEMPLATES = [
    '{"reasoning": "@W", "category": "@T"}',
    'Sure.\n```json\n{"reasoning": "@W", "category": "@T"}\n```',
    "I cannot classify this review (@W).",
    '{"reasoning": "@W"}',
    '{"reasoning": "@W", "Category": "@T"}',
    "{'reasoning': '@W', 'category': '@T'}",
    '{"reasoning": "@W\nsecond line", "category": "@T"}',
    '{"category": "@T"}\n{"category": "GENERAL_INQUIRY"}',
    '{"reasoning": "@W", "category": "@T"}}',
    '{"reasoning": "@W", "category": null}',
    '{"reasoning": "@W", "category": "OTHER_@T"}',
]

SQL_TEMPLATES = [
    "Analysis: @X\nSELECT AVG(trades.price_slippage_bps) AS avg_price_slippage_bps FROM trades;\nDone.",
    "Note: @X\n```sql\nselect COUNT(users.user_id) AS user_count from users\n```",
    "WITH c AS (SELECT user_id FROM customer_support) SELECT COUNT(*) AS n FROM c;\n@X\nEnd.",
    "No query for: @X (end)",
    "SELECT 'a;b' AS s FROM users;\n@X\nEnd.",
    "  SELECT users.auth_bottleneck FROM users WHERE users.kyc_status = '@X'",
]

_MARK = re.compile(r"@([WTX])")


def render(template: str, **values: str) -> str:
    return _MARK.sub(lambda m: values[m.group(1)], template)


def label_reply(prompt: str | None) -> str | None:
    if prompt is None:
        return None
    n = len(prompt)
    shape = (n // len(THEMES)) % len(LABEL_TEMPLATES)
    return render(LABEL_TEMPLATES[shape], W=f"review of {n} characters", T=THEMES[n % len(THEMES)])


def sql_reply(prompt: str | None) -> str | None:
    if prompt is None:
        return None
    return render(SQL_TEMPLATES[len(prompt) % len(SQL_TEMPLATES)], X=prompt)


def label_model(prompts: pd.Series) -> pd.Series:
    return prompts.map(label_reply)


def read_label_reply(prompt: str | None) -> str | None:
    """A reply that depends on what the prompt says: the theme by its MD5."""
    if prompt is None:
        return None
    k = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16)
    return render(LABEL_TEMPLATES[k // len(THEMES) % len(LABEL_TEMPLATES)], W=f"review {k}", T=THEMES[k % len(THEMES)])


def reading_model(prompts: pd.Series) -> pd.Series:
    return prompts.map(read_label_reply)


def sql_model(prompts: pd.Series) -> pd.Series:
    return prompts.map(sql_reply)


def template_sql(template: str, **exprs: str) -> str:
    """A template as a SQL string concatenation (for the oracle queries)."""
    out = []
    for i, part in enumerate(_MARK.split(template)):
        if i % 2:
            out.append(f"({exprs[part]})")
        elif part:
            out.append("'" + part.replace("'", "''") + "'")
    return " || ".join(out) if out else "''"


def failing_label_model(prompts: pd.Series) -> pd.Series:
    """``label_model`` that fails on every prompt of some lengths, as a call to a hosted model may."""
    if any(p is not None and len(p) % 10 == 3 for p in prompts):
        raise TimeoutError("no reply")
    return label_model(prompts)


def theme_sql_reply(theme: str) -> str:
    """A reply to the request for a theme's statement: sound, chatty, against the rules, or none."""
    plan = PLANS[theme]
    joined = (f"FROM {plan.target} JOIN customer_support ON customer_support.user_id = {plan.target}.user_id "
              f"WHERE customer_support.complaint_theme = '{theme}'")
    if theme == "LEDGER_DISPUTE":
        return ("Here is the query:\nSELECT financial_ledger.txn_type, COUNT(financial_ledger.txn_id) AS txn_count, "
                "AVG(financial_ledger.withdrawal_processing_latency_hours) AS avg_withdrawal_processing_latency_hours "
                f"{joined} GROUP BY financial_ledger.txn_type;\nIt groups by type.")
    if theme == "CHARTING_UI_GLITCH":
        return ("SELECT AVG(app_performance.chart_render_latency_ms) AS avg_latency, COUNT(DISTINCT "
                f"app_performance.websocket_drop_rate_pct) AS drops_pct {joined};")
    if theme == "LOGIN_AND_2FA_ISSUE":
        return f"SELECT users.user_id, COUNT(users.user_id) AS user_count {joined} GROUP BY users.user_id;"
    if theme == "KYC_ONBOARDING_EFFICIENCY":
        return "I need more information about the schema."
    if theme == "GENERAL_INQUIRY":
        return "SELECT AVG(tickets.resolution_hours) AS avg_resolution_hours FROM tickets;"
    return f"SELECT {', '.join(f'AVG({plan.target}.{m.column}) AS {m.alias}' for m in plan.metrics)} {joined};"
