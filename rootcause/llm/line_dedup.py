"""Line dedup with a once-seen and a twice-seen Bloom filter.

1. Every task sets four bits for each line of its documents and tells, for
   each page of the filters, the bits set once and those set more often. Pages
   are merged by page: a bit that two lines set is in the twice-seen filter,
   and all bits of a line that two documents hold are. The filters have twelve
   bits for every line counted, so one line in some 150 is suspected wrongly at
   any size of the corpus.
2. Lines are tested against the pages of the twice-seen filter. While the pages
   are few (their number is known) they are broadcast and no line moves; more
   are joined by page. Only suspected lines, as document and 128-bit digest, go
   on to the exact count of documents and the choice of the one that keeps the
   line; the digest alone decides then, the filters decide nothing.
3. Lines to drop are broadcast while they are few (counted); more are joined to
   the suspected lines and reach their documents through a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootcause.llm import textblocks as T
from rootcause.llm.tables import map_batches, stage_table

BITS_PER_LINE = 12
HASHES = 4
PAGE_BITS = 1 << 16
#: Pages (8 KB each) that may be broadcast, and lines to drop (24 bytes each).
BROADCAST_PAGES = 4096
BROADCAST_LINES = 250_000
#: Lines whose bits a task holds before it tells them.
FLUSH_LINES = 500_000

BLANK = b" \t\n\x0b\x0c\r"
_LINE = "doc_id long, hi long, lo long"


def line_digest(line: bytes, least: int) -> bytes | None:
    """Digest of a lower-cased line's key; None if it has under ``least`` characters."""
    key = line.strip(BLANK)
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """(row, text) of every row, an empty text for a null."""
    data, offs = T.text_buffers(batch["text"])
    data = data.tobytes()
    for r in range(batch.num_rows):
        yield r, data[offs[r]:offs[r + 1]]


def _words(digests: list[bytes]) -> np.ndarray:
    """Digests as rows of two longs."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _distinct_lines(text: bytes, least: int) -> set[bytes]:
    # bytes.lower() changes A-Z alone.
    return {d for line in text.lower().split(b"\n") if (d := line_digest(line, least))}


def _set_bits(least: int, pages: int):
    """(page, bits set once, bits set more often) of a task's lines, as 16-bit places."""
    def tell(held: list[bytes]) -> pa.RecordBatch:
        hi, lo = _words(held).T
        places = [(lo >> (16 * k)) & (PAGE_BITS - 1) for k in range(HASHES)]
        bits, times = np.unique(np.concatenate([(hi % pages) * PAGE_BITS + p for p in places]), return_counts=True)
        page, place = bits // PAGE_BITS, (bits % PAGE_BITS).astype("<u2")
        cuts = np.flatnonzero(np.diff(page)) + 1
        groups = list(zip(np.split(place, cuts), np.split(times > 1, cuts)))
        return pa.RecordBatch.from_arrays(
            [pa.array(page[np.append(0, cuts)], pa.int64()), pa.array([p[~m].tobytes() for p, m in groups], pa.binary()),
             pa.array([p[m].tobytes() for p, m in groups], pa.binary())], ["page", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for b in batches:
            for _, text in _documents(b):
                held += _distinct_lines(text, least)
                if len(held) >= FLUSH_LINES:
                    yield tell(held)
                    held = []
        if held:
            yield tell(held)
    return run


def _merge_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The twice-seen filter's pages, as 64-bit words; rows come sorted by page."""
    def finished() -> pa.RecordBatch:
        bits = np.packbits(seen > 1, bitorder="little").view("<i8")
        return pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int64()), pa.ListArray.from_arrays([0, len(bits)], pa.array(bits))], ["page", "bits"])

    at, seen = None, np.zeros(PAGE_BITS, np.uint8)
    for b in batches:
        for page, once, twice in zip(*(b[c].to_pylist() for c in ("page", "once", "twice"))):
            if page != at:
                if at is not None:
                    yield finished()
                at, seen = page, np.zeros(PAGE_BITS, np.uint8)
            places = np.frombuffer(once, "<u2")
            seen[places] = np.minimum(seen[places] + 1, 2)
            seen[np.frombuffer(twice, "<u2")] = 2
    if at is not None:
        yield finished()


def _tell_lines(least: int):
    """(doc_id, digest) of every document's distinct lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, held, counts = b["doc_id"], [], []
            for _, text in _documents(b):
                lines = _distinct_lines(text, least)
                held += lines
                counts.append(len(lines))
            if held:
                hi, lo = _words(held).T
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(hi), pa.array(lo)], ["doc_id", "hi", "lo"])
    return run


class KeptBy:
    """The document that keeps each of the lines to drop, by digest."""

    def __init__(self, lines: pa.Table):
        by = np.argsort(lines["hi"].to_numpy(), kind="stable")
        self.hi, self.lo, self.keeper = (lines[c].to_numpy()[by] for c in ("hi", "lo", "keeper"))
        same = np.diff(np.flatnonzero(np.append(True, np.diff(self.hi) != 0)), append=len(self.hi)) if len(self.hi) else [0]
        self.equal = int(max(same))

    def keepers(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, keeper) of each digest."""
        known, keeper = np.zeros(len(digests), bool), np.zeros(len(digests), np.int64)
        first = np.searchsorted(self.hi, digests[:, 0])
        for k in range(self.equal):
            at = np.minimum(first + k, len(self.hi) - 1)
            hit = (self.hi[at] == digests[:, 0]) & (self.lo[at] == digests[:, 1])
            known |= hit
            keeper[hit] = self.keeper[at[hit]]
        return known, keeper


_KEPT = "doc_id long, text string, n_lines long, n_dropped long"


def _drop_lines(least: int, kept_by=None):
    """Texts without the lines that another document keeps.

    The lines come from the broadcast ``kept_by`` or from column ``gone``, the
    digests to drop of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["doc_id"].to_pylist()
            gone = b["gone"].to_pylist() if kept_by is None else None
            out: list[tuple] = []
            for r, text in _documents(b):
                lines, n_dropped = text.split(b"\n"), 0
                n_lines = len(lines)
                if ids[r] is not None and (kept_by is not None or gone[r]):
                    digests = [line_digest(line, least) for line in text.lower().split(b"\n")]
                    if kept_by is None:
                        drop = {(g["hi"], g["lo"]) for g in gone[r]}
                        dropped = [d is not None and tuple(_words([d])[0].tolist()) in drop for d in digests]
                    else:
                        at = [k for k, d in enumerate(digests) if d]
                        dropped = np.zeros(n_lines, bool)
                        if at:
                            known, keeper = kept_by.value.keepers(_words([digests[k] for k in at]))
                            dropped[at] = known & (keeper != ids[r])
                    n_dropped = int(sum(dropped))
                    if n_dropped:
                        text = b"\n".join(line for line, d in zip(lines, dropped) if not d)
                out.append((text, n_lines, n_dropped))
            texts, n_lines, n_dropped = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string()),
                 pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])
    return run


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keep: str = "last",
                   broadcast_pages: int = BROADCAST_PAGES) -> tuple[DataFrame, DataFrame]:
    """(suspected lines of documents: doc_id, hi, lo; lines to drop: hi, lo, keeper).

    A line is named by the two longs of its key's digest.
    """
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    n_lines = docs.where(F.octet_length("text") >= min_chars).agg(F.sum(lines)).first()[0] or 0
    pages = max(1, -(-n_lines * BITS_PER_LINE // PAGE_BITS))
    filters = (docs.transform(map_batches, _set_bits(min_chars, pages), "page long, once binary, twice binary")
               .repartition("page").sortWithinPartitions("page").mapInArrow(_merge_pages, "page long, bits array<long>"))
    filters = stage_table(filters, "line-filter")

    def is_set(k: int):
        place = F.shiftright("lo", 16 * k).bitwiseAND(PAGE_BITS - 1).cast("int")
        word = F.get("bits", F.shiftright(place, 6))
        # A shift by a column is left to SQL: the function takes a number only.
        return F.call_function("shiftright", word, place.bitwiseAND(63)).bitwiseAND(1) == 1

    told = docs.transform(map_batches, _tell_lines(min_chars), _LINE).withColumn("page", F.pmod("hi", F.lit(pages)))
    small = pages <= broadcast_pages
    suspects = told.join(F.broadcast(filters) if small else filters, "page")
    for k in range(HASHES):
        suspects = suspects.where(is_set(k))
    suspects = stage_table(suspects.select("doc_id", "hi", "lo"), "suspected-lines")
    keeper = F.max("doc_id") if keep == "last" else F.min("doc_id")
    # A line of very many documents is counted in parts: the first shuffle is
    # by line and document, the second has partial counts.
    drops = (suspects.distinct().groupBy("hi", "lo").agg(F.count("*").alias("n"), keeper.alias("keeper"))
             .where(F.col("n") >= min_docs).select("hi", "lo", "keeper"))
    return suspects, stage_table(drops, "repeated-lines")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, keep: str = "last",
                broadcast_pages: int = BROADCAST_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """doc_id, text without repeated lines, n_lines before and n_dropped.

    Lines are parted by \\n. A line's key is the line without white space at
    its ends, A-Z lower-cased. Keys of at least ``min_chars`` code points that
    ``min_docs`` different doc_ids hold lose all their lines but those of the
    largest of these doc_ids (smallest for ``keep="first"``), also where it
    says the line twice.

    A null or empty text is one empty line and comes back as an empty text.
    Rows that share a doc_id are one document to the count and each keep or
    lose their lines alike; rows without doc_id count nowhere and lose nothing.
    Other columns are ignored; an empty table gives no rows. The broadcast
    bounds change no result.
    """
    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    suspects, drops = repeated_lines(known, min_chars, min_docs, keep, broadcast_pages)
    if drops.count() <= broadcast_lines:
        kept_by = docs.sparkSession.sparkContext.broadcast(KeptBy(drops.toArrow()))
        return docs.transform(map_batches, _drop_lines(min_chars, kept_by), _KEPT)
    gone = (suspects.distinct().join(drops, ["hi", "lo"]).where("doc_id != keeper")
            .groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias("gone")))
    return docs.join(gone, "doc_id", "left").transform(map_batches, _drop_lines(min_chars), _KEPT)
