"""Order-independent sums and averages and exact 2-dp rendering.

A double ``sum`` depends on the order in which partitions are added, so results
would change with the partitioning. Summing a fixed-point decimal is exact and
order free. Six decimals are kept, and sums hold up to 1e32, far beyond what a
64-bit count of units would.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUM_TYPE = "decimal(32,6)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_sum(c) -> Column:
    """Aggregate: the exact sum, as a decimal."""
    return F.sum(_col(c).cast(SUM_TYPE))


def exact_avg(c) -> Column:
    """Aggregate: AVG(c) computed as decimal sum / count (null for no rows)."""
    return F.try_divide(exact_sum(c).cast("double"), F.count(_col(c)))


def fmt_ratio_2dp_expr(total: str, n: str) -> str:
    """Spark SQL text of ``fmt_ratio_2dp`` over two column names."""
    units = f"(abs(CAST({total} * 1000000 AS DECIMAL(38,0))) + {n} * 5000L)"
    cents = _quotient(units, f"({n} * 10000L)")
    return (f"CASE WHEN {n} > 0 THEN concat(CASE WHEN {total} < 0 AND {cents} > 0 THEN '-' ELSE '' END, "
            f"cast({_quotient(cents, '100L')} AS STRING), '.', "
            f"lpad(cast(CAST({cents} % 100L AS INT) AS STRING), 2, '0')) END")


def _quotient(a: str, b: str) -> str:
    """a div b over decimals (``div`` itself gives a 64-bit number)."""
    return f"CAST(({a} - {a} % {b}) / nullif({b}, 0L) AS DECIMAL(38,0))"


def fmt_ratio_2dp(total: str, n: str) -> Column:
    """Render total / n with 2 decimals, half away from zero, exactly.

    ``total`` is a decimal column with six decimals. Whole numbers only, so
    every engine prints the same digits; rounding a double is not portable (1.005 becomes 1.01 in one
    engine, 1.00 in another).
    """
    return F.expr(fmt_ratio_2dp_expr(total, n))
