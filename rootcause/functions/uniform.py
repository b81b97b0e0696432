"""Deterministic uniform draws.

``uniform(id, salt)`` maps a key to [0, 1) from the first 52 bits of
md5("<id>:<salt>"). Unlike ``rand(seed)`` it does not depend on partitioning or
task retries, so a re-executed task draws the same values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = 4503599627370496.0


def uniform(key, salt: str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(key.cast("string"), F.lit(":" + salt)))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double") / F.lit(TWO_POW_52)
