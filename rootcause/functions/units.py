"""Unit-aware metric rendering (op F3).

Units are carried by name tokens: ``bps`` is basis points and never a percent,
``ms`` stays milliseconds, ``pct`` or ``rate`` is a percentage, ``hours`` and
``days`` keep their unit. Tokens are matched whole (``_ms``), bps first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit tokens in test order, and the suffix printed for each.
UNIT_RULES = [
    (("bps",), " bps"),
    (("ms",), " ms"),
    (("pct", "rate"), "%"),
    (("hours",), " hours"),
    (("days",), " days"),
]


def unit_suffix_expr(name: str) -> str:
    """Spark SQL text: the unit suffix for a metric-name column ('' when unitless)."""
    parts = []
    for toks, suffix in UNIT_RULES:
        cond = " OR ".join(f"array_contains(split({name}, '_'), '{t}')" for t in toks)
        parts.append(f"WHEN {cond} THEN '{suffix}'")
    return "CASE " + " ".join(parts) + " ELSE '' END"


def unit_suffix(name: str) -> Column:
    return F.expr(unit_suffix_expr(name))


def format_metric(name: str, number_text) -> Column:
    """Attach the unit (from the metric-name column ``name``) to a rendered number."""
    number_text = F.col(number_text) if isinstance(number_text, str) else number_text
    return F.concat(number_text, unit_suffix(name))

