"""A Bloom filter of join keys, built and tested with built-in functions (op E0).

A large table that will be aggregated by key and then joined to a smaller set
of keys need not be shuffled whole: its rows are first tested against a Bloom
filter of those keys, in the scan's own tasks. The filter is a table of pages
of 512 bits (eight longs), one for every 64 keys; a key sets and tests three
bits of one page, so that the test is one lookup in a broadcast table. Bits are
merged with ``bit_or``, partially aggregated in the tasks that read the keys.
No row of a key is lost; a few in a hundred of the others pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 8
WORDS = 8
HASHES = 3
#: Keys whose filter may be broadcast (72 bytes for every 64 keys).
MAX_KEYS = 16_000_000


def _pages(n_keys: int) -> int:
    return max(1, -(-n_keys * BITS_PER_KEY // (64 * WORDS)))


def _hashed(df: DataFrame, key: str, pages: int) -> DataFrame:
    """``df`` with its key's page and the 64 bits that its places in the page are taken from."""
    return df.selectExpr("*", f"pmod(xxhash64(`{key}`), {pages}L) AS _page", f"xxhash64(1, `{key}`) AS _h")


def _word(k: int) -> str:
    return f"CAST(shiftright(_h, {9 * k + 6}) & {WORDS - 1} AS INT)"


def _bit(k: int) -> str:
    return f"CAST(shiftright(_h, {9 * k}) & 63 AS INT)"


def build_filter(keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """(_page, _w0 .. _w7) of the keys, of which there are at most ``n_keys``; repeated ones are fine."""
    def word(w: int) -> str:
        ones = [f"CASE WHEN {_word(k)} = {w} THEN shiftleft(1L, {_bit(k)}) ELSE 0L END" for k in range(HASHES)]
        return f"bit_or({' | '.join(ones)}) AS _w{w}"
    return (_hashed(keys.where(f"`{key}` IS NOT NULL").select(key), key, _pages(n_keys)).groupBy("_page")
            .agg(*(F.expr(word(w)) for w in range(WORDS))))


def _tested(df: DataFrame, key: str, keys: DataFrame, n_keys: int, how: str) -> tuple[DataFrame, str]:
    """``df`` joined to the pages of its keys, and the test of the bits as SQL text."""
    words = "array(" + ", ".join(f"_w{w}" for w in range(WORDS)) + ")"
    bits = [f"(shiftright(element_at({words}, {_word(k)} + 1), {_bit(k)}) & 1) = 1" for k in range(HASHES)]
    joined = _hashed(df, key, _pages(n_keys)).join(F.broadcast(build_filter(keys, key, n_keys)), "_page", how)
    return joined, " AND ".join(bits)


def might_match(df: DataFrame, key: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """The rows of ``df`` whose key may be among ``keys`` (column of the same
    name); all of them stay as they are where the filter would be too large."""
    if n_keys > MAX_KEYS:
        return df
    joined, passes = _tested(df, key, keys, n_keys, "inner")
    return joined.where(passes).select(*df.columns)


def flag_matches(df: DataFrame, key: str, keys: DataFrame, n_keys: int, flag: str) -> DataFrame:
    """Every row of ``df``, with whether its key may be among ``keys``: true for
    all where the filter would be too large, false for a null key."""
    if n_keys > MAX_KEYS:
        return df.withColumn(flag, F.col(key).isNotNull())
    joined, passes = _tested(df, key, keys, n_keys, "left")
    return joined.select(*df.columns, F.expr(f"coalesce({passes}, false) AND `{key}` IS NOT NULL").alias(flag))
