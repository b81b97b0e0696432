"""Column-level building blocks (all JVM-side built-ins)."""

from rootcause.functions.numeric import exact_avg, exact_sum, fmt_ratio_2dp
from rootcause.functions.uniform import uniform
from rootcause.functions.text import (
    strip, preview, wrap_review, word_pattern, extract_sql, extract_label_native,
)
from rootcause.functions.units import format_metric
from rootcause.functions.finance import margin_balance, slippage_bps, executed_price, order_side, rejection_code

__all__ = [
    "exact_avg", "exact_sum", "fmt_ratio_2dp", "uniform", "strip", "preview",
    "wrap_review", "word_pattern", "extract_sql", "extract_label_native", "format_metric",
    "margin_balance", "slippage_bps", "executed_price", "order_side", "rejection_code",
]
