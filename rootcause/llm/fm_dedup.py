"""Substring dedup with an FM-index of each shard of repeated runs.

A shard's runs (see :mod:`repeats`) are joined into one text of word numbers.
Its Burrows-Wheeler transform, sorted to more words than a window has, is kept
as a wavelet matrix: a few bits a word, with counts. The runs are streamed
against it from right to left by backward search; after every step the match
is cut back to a window less one word at the marked group bounds, so that the
statistics stay at window length. Windows whose search ends in the same
interval are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootcause.llm import textblocks as T
from rootcause.llm.repeats import Kind, merged_intervals, settle

WINDOW, GRAM = 50, 8


class WaveletMatrix:
    """Rank over a sequence of small numbers, one packed bit row a level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(values) // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((level, words, before, len(values) - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of the sequence lands in its symbol's block."""
        for level, words, before, zeros in self.levels:
            word = at >> 6
            below = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = before[word] + np.bitwise_count(below)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Backward search for patterns of at most ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        ranks, size = [text.astype(np.int64)], 1
        while size < depth:  # ranks[k]: order of the next 2**k symbols
            r = ranks[-1]
            ahead = np.zeros(n, np.int64)
            ahead[:max(0, n - size)] = r[size:]
            key = r * (int(r.max()) + 1) + ahead
            ranks.append(np.unique(key, return_inverse=True)[1])
            size *= 2
        order = np.argsort(ranks[-1], kind="stable")
        last = np.concatenate([text[-1:], text[:-1]])[order]
        self.n, symbols = n, int(text.max()) + 1
        self.wavelet = WaveletMatrix(last, max(1, int(symbols - 1).bit_length()))
        counts = np.bincount(text, minlength=symbols)
        every = np.arange(symbols)
        # First row of each symbol, less where its block begins.
        self.first = np.cumsum(counts) - counts - self.wavelet.descend(every, np.zeros(symbols, np.int64))
        # Bounds of the groups that share depth - 1 symbols.
        new, at = np.zeros(n, bool), order
        new[0] = True
        rest, skip = depth - 1, 0
        for k in range(len(ranks) - 1, -1, -1):
            if rest >> k & 1:
                r = np.full(n, -1, np.int64)
                inside = at + skip < n
                r[inside] = ranks[k][at[inside] + skip]
                new[1:] |= r[1:] != r[:-1]
                skip += 1 << k
        bounds = np.append(np.flatnonzero(new), n)
        group = np.cumsum(new) - 1
        self.group_start, self.group_end = bounds[group], bounds[group + 1]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = self.first[symbol]
        return base + self.wavelet.descend(symbol, lo), base + self.wavelet.descend(symbol, hi)

    def shorten(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of a match without its last symbol, at full depth."""
        return self.group_start[lo], self.group_end[lo]


def number_windows(units: np.ndarray, seg_at: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """First row of the index interval of every window of the shard's runs."""
    number = np.full(len(windows), -1, np.int64)
    if not len(windows):
        return number
    symbols = np.unique(units, return_inverse=True)[1] + 1
    text = np.insert(symbols, seg_at[1:], 0)  # 0 ends a run and is in no pattern
    text = np.append(text, 0)
    index = FMIndex(text, window)
    ends = np.append(seg_at[1:], len(units))
    length = ends - seg_at
    slot = np.full(len(units), -1, np.int64)
    slot[windows] = np.arange(len(windows))
    lo, hi = np.zeros(len(seg_at), np.int64), np.full(len(seg_at), index.n, np.int64)
    for step in range(int(length.max())):
        live = np.flatnonzero(length > step)
        l, h = lo[live], hi[live]
        if step >= window:
            l, h = index.shorten(l)
        at = ends[live] - 1 - step
        lo[live], hi[live] = l, h = index.extend(symbols[at], l, h)
        if step + 1 >= window:
            found = slot[at] >= 0
            number[slot[at[found]]] = np.where(h[found] - l[found] > 1, l[found], -1)
    return number


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return T.words(data, offs, T.NOT_SPACE)[:2]


KIND = Kind(WINDOW, GRAM, _words, within=False, index=number_windows)
_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].cast(pa.large_binary())):
            words = (text.as_py() or b"").split()
            sha = hashlib.sha256(b" ".join(words)).hexdigest()
            rows.append((len(words), sha, doc_id, len(words), 0, sha))
        yield _table(rows, ["size", "digest", "doc_id", "n_words", "n_removed", "kept_sha256"],
                     (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in range(b.num_rows):
            words = b["text"][r].cast(pa.large_binary()).as_py().split()
            kept, at = [], 0
            for first, last in merged_intervals(b["intervals"][r]):
                kept += words[at:first]
                at = last
            kept += words[at:]
            rows.append((b["doc_id"][r].as_py(), len(words), len(words) - len(kept),
                         hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield _table(rows, ["doc_id", "n_words", "n_removed", "kept_sha256"],
                     (pa.int64(), pa.int64(), pa.int64(), pa.string()))


def _table(rows: list[tuple], names: list[str], types: tuple) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def repeated_words(docs: DataFrame, kind: Kind = KIND) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``.

    A word goes if a window of 50 words that covers it also starts in a
    document with a smaller doc_id. A null or empty text has no words. A row
    without doc_id is smaller than none and loses nothing. Rows with equal
    doc_id and text are each returned; rows that give one doc_id several texts
    share their removals. Other columns are ignored.
    """
    rest, cut = settle(docs, kind, np.uint64, _profile, _cut, _SCHEMA)
    copy = F.col("copy").isNotNull() & (F.col("size") >= WINDOW)
    return rest.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.lit(0)).alias("n_removed"),
                       F.when(copy, F.lit(EMPTY_SHA256)).otherwise(F.col("kept_sha256")).alias("kept_sha256")).union(cut)
