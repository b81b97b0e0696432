"""Trading and ledger column functions (ops G6, G7, G8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rootcause.themes import TIMEOUT_CODE, TIMEOUT_LATENCY_MS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def margin_balance(balance, leverage) -> Column:
    """balance * leverage while positive; a non-positive balance is not levered."""
    b = _col(balance)
    return F.when(b > 0, b * _col(leverage)).otherwise(b)


def order_side(order_type) -> Column:
    """+1 for buy-side order types (name contains BUY), -1 for everything else."""
    return F.when(_col(order_type).contains("BUY"), F.lit(1)).otherwise(F.lit(-1))


def slippage_bps(order_type, requested, executed) -> Column:
    """Signed slippage in basis points.

    A buy filled above the request, or a sell filled below it, is an adverse
    move and is stored negative; an improvement is positive. Null for a
    requested price of 0.
    """
    req, exe = _col(requested), _col(executed)
    return F.try_divide(-order_side(order_type) * (exe - req), req) * F.lit(10000.0)


def executed_price(order_type, requested, bps) -> Column:
    """Inverse of ``slippage_bps``: the fill price for a stored bps value."""
    return _col(requested) * (F.lit(1.0) + order_side(order_type) * -_col(bps) / F.lit(10000.0))


def rejection_code(latency_ms, code) -> Column:
    """Routing latency above 5000 ms overrides the exchange code."""
    return F.when(_col(latency_ms) > TIMEOUT_LATENCY_MS, F.lit(TIMEOUT_CODE)).otherwise(_col(code))
