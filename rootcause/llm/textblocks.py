"""Words, word hashes and window hashes of whole Arrow batches, with numpy.

Everything works on the UTF-8 bytes that Arrow already holds. A batch is cut
into blocks of whole documents of bounded size, so that the working memory of
a task follows the block (or one very long document), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 2 << 20

#: Word characters of the two word definitions used, by byte. Bytes from 0x80
#: belong to characters outside ASCII, which both definitions count as word
#: characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has length 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.large_string() if pa.types.is_string(col.type) else pa.large_binary())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together hold at most ``limit`` bytes, or one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


@lru_cache(maxsize=None)
def _byte_codes(salt: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 (base is odd) for i below n."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 16
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        got = _POWERS[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return got


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of codes[start:end] for every range."""
    up, down = _powers(base, len(codes) + 1)
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[:len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


BYTE_BASE, WORD_BASE = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray,
          lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word's index by document + total, starts) of all words.

    The second array has len(offs) entries: the words of document i are those
    from its entry i to its entry i + 1. Long inputs are hashed in pieces cut
    between words, so that the arrays of 8 bytes a byte stay small.
    """
    if lower:
        data = LOWER[data]
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offs[(offs > 0) & (offs < len(data))]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), U64)
    codes, i = _byte_codes(0), 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + (1 << 18), "right")))
        out[i:j] = range_hashes(codes[data[lo:ends[j - 1]]], starts[i:j] - lo, ends[i:j] - lo, BYTE_BASE)
        i = j
    return out, np.searchsorted(starts, offs), starts


def gram_hashes(hashes: np.ndarray, index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one document, and their starts.

    ``index`` has the first word of every document and the total.
    """
    if len(hashes) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    starts = np.arange(len(hashes) - n + 1)
    doc_end = np.repeat(index[1:], np.diff(index))[:len(starts)]
    starts = starts[starts + n <= doc_end]
    return range_hashes(hashes, starts, starts + n, WORD_BASE), starts


def rows_of(items: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*items)) if items else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
