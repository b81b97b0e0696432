"""Suffix-array dedup by a depth-limited radix sort.

Only suffixes that start in a repeated run (see :mod:`repeats`) are sorted, and
only through the first ``WINDOW`` bytes: passes over eight bytes at a time,
most significant first, each within the groups of the pass before. A suffix
that is alone in its group drops out. The groups after the last pass are
exactly the repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootcause.llm import textblocks as T
from rootcause.llm.fm_dedup import EMPTY_SHA256, _table
from rootcause.llm.repeats import Kind, merged_intervals, settle

WINDOW, GRAM = 100, 24


def radix_groups(data: np.ndarray, seg_at: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """Group of every window among equal ones, -1 for those that are alone."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    digits = np.zeros(len(data), np.uint64)
    for k in range(8):
        digits = (digits << np.uint64(8)) | padded[k:k + len(data)]
    group = np.zeros(len(windows), np.int64)
    live = np.arange(len(windows))
    for at in range(0, window, 8):
        digit = digits[windows[live] + at]
        if window - at < 8:
            digit = digit >> np.uint64(8 * (8 - (window - at)))
        order = np.lexsort((digit, group[live]))
        live, digit = live[order], digit[order]
        new = np.ones(len(live), bool)
        new[1:] = (digit[1:] != digit[:-1]) | (group[live[1:]] != group[live[:-1]])
        alone = new & np.append(new[1:], True)
        group[live] = np.cumsum(new) - 1
        group[live[alone]] = -1
        live = live[~alone]
    return group


def _bytes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offs


KIND = Kind(WINDOW, GRAM, _bytes, within=True, index=radix_groups)
_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
_NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = T.text_buffers(b["text"])
        view, rows = memoryview(data), []
        for r, doc_id in enumerate(b["doc_id"].to_pylist()):
            n = int(offs[r + 1] - offs[r])
            sha = hashlib.sha256(view[offs[r]:offs[r + 1]]).hexdigest()
            rows.append((n, sha, doc_id, n, 0, 0, sha))
        yield _table(rows, ["size", "digest", *_NAMES], (pa.int64(), pa.string(), *_TYPES))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = T.text_buffers(b["text"])
        view, rows = memoryview(data), []
        for r in range(b.num_rows):
            text = view[offs[r]:offs[r + 1]]
            spans = [(s, min(e, len(text))) for s, e in merged_intervals(b["intervals"][r])]
            sha, at = hashlib.sha256(), 0
            for first, last in spans:
                sha.update(text[at:first])
                at = last
            sha.update(text[at:])
            rows.append((b["doc_id"][r].as_py(), len(text), sum(e - s for s, e in spans), len(spans), sha.hexdigest()))
        yield _table(rows, _NAMES, _TYPES)


def repeated_bytes(docs: DataFrame, kind: Kind = KIND) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in
    a document with a smaller doc_id, or before in its own. A null text is
    empty. A row without doc_id loses nothing. Rows with equal doc_id and text
    are each returned; rows that give one doc_id several texts share their
    removals. Other columns are ignored.
    """
    rest, cut = settle(docs, kind, np.uint8, _profile, _cut, _SCHEMA)
    copy = F.col("copy").isNotNull() & (F.col("size") >= WINDOW)
    return rest.select("doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"),
                       F.when(copy, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"),
                       F.when(copy, F.lit(EMPTY_SHA256)).otherwise(F.col("kept_sha256")).alias("kept_sha256")).union(cut)
