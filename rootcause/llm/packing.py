"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most ``capacity`` ids. Only the number of
pieces of each length (at most ``capacity`` numbers, whatever the corpus)
reaches the driver, where a plan of patterns is made: a pattern is a list of
lengths that share a sequence, and the number of sequences made so. From the
longest length down, the gap a piece leaves is looked up among the sums of
one, two and three lengths still available; a combination that fills it
exactly is consumed as often as the counts allow. What has no exact
complement is packed best-fit decreasing, again in bulk. Pieces then take the
places planned for their length in the order of their rank within it; ranks
are formed per (length, bucket of documents) and offset by the bucket's count,
so that no length, however common, meets in one task.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootcause.llm.tables import kept, map_batches, stage_table

CAPACITY = 2048
CACHE_WORDS = 600_000
#: ASCII punctuation without the apostrophe, which can begin a contraction.
_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_TOGETHER = 400
_STEM_END = frozenset(bytes([c]) for c in b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Pieces that one (length, bucket) group holds on average when one length
#: has all of them.
BUCKET_PIECES = 10_000


class WordIds:
    """Token ids of texts, little-endian, with a bounded cache of words.

    The tokenizer drops white space before it splits and lower-cases, so its
    ids of a text are those of the lower-cased words between ASCII white space,
    one after another. Punctuation after an ASCII letter or digit begins a
    pre-token of its own, so a new word's stem and tail are looked up apart.
    Texts with a special token's string, in any case, are encoded whole.
    """

    def __init__(self, path: str):
        # Spark runs a worker for each core: no threads inside it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        special = [re.escape(t.content.encode()) for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = re.compile(b"|".join(special), re.I) if special else None
        # Every pre-token ends with an id of this kind.
        suffix = self.tok.model.end_of_word_suffix
        self.is_end = np.zeros(self.tok.get_vocab_size(), bool)
        if suffix:
            self.is_end[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        self.cache: dict[bytes, bytes] = {}

    def ids(self, texts: list[bytes]) -> list[bytes]:
        split = [None if self.odd and self.odd.search(t) else t.lower().split() for t in texts]
        new = set().union(*(ws for ws in split if ws)).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = set().union(*(ws for ws in split if ws))
        self._learn(new)
        get = self.cache.__getitem__
        return [self._whole(t) if ws is None else b"".join(map(get, ws)) for t, ws in zip(texts, split)]

    def _learn(self, new: set[bytes]) -> None:
        joined = []
        ask = set()
        for w in new:
            stem = w.rstrip(_TAIL)
            if stem != w and stem[-1:] in _STEM_END:
                tail = w[len(stem):]
                joined.append((w, stem, tail))
                ask.update((stem, tail))
            else:
                ask.add(w)
        self._encode([w for w in ask if w not in self.cache])
        for w, stem, tail in joined:
            self.cache[w] = self.cache[stem] + self.cache[tail]

    def _encode(self, words: list[bytes]) -> None:
        """Words of letters alone are one pre-token each and go to the tokenizer
        many at a time; their ids are told apart by those that end a word."""
        texts = [w.decode("utf-8", "replace") for w in words]
        letters = [i for i, t in enumerate(texts) if t.isalpha()]
        rest = [i for i, t in enumerate(texts) if not t.isalpha()]
        groups = [letters[k:k + _TOGETHER] for k in range(0, len(letters), _TOGETHER)]
        encoded = self.tok.encode_batch_fast([" ".join(texts[i] for i in g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, encoded):
            ids = np.array(e.ids, "<u4")
            ends = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            if len(ends) != len(group):  # lower-casing made a letter into more than letters
                rest += group
                continue
            raw = ids.tobytes()
            for i, start, end in zip(group, [0, *ends], ends):
                self.cache[words[i]] = raw[start:end]
        for i, e in zip(rest, self.tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            self.cache[words[i]] = array("I", e.ids).tobytes()

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept(path, lambda: WordIds(path))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for doc_id, ids in zip(part["doc_id"].to_pylist(),
                                       enc.ids(part["text"].cast(pa.large_binary()).to_pylist())):
                    ids += end
                    for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                        piece = ids[4 * start:4 * (start + capacity)]
                        rows.append((doc_id, k, start, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def plan_patterns(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, times), ...] with how many sequences use each.

    ``counts[n]`` is the number of pieces of length n, up to ``capacity``.
    Every step takes a combination as often as the counts allow and so uses
    some length up: the number of patterns follows the number of lengths.
    """
    left = counts.astype(np.int64).copy()
    patterns: list[tuple[list[tuple[int, int]], int]] = []
    rest = np.zeros_like(left)
    for base in range(capacity, 0, -1):
        while left[base]:
            if base == capacity:
                combo: list[int] | None = []
            else:
                left[base] -= 1
                combo = _exact_fill(left, capacity - base)
                left[base] += 1
            if combo is None:
                rest[base], left[base] = left[base], 0
                break
            need = np.bincount([base, *combo], minlength=capacity + 1)
            used = np.flatnonzero(need)
            times = int((left[used] // need[used]).min())
            left[used] -= times * need[used]
            patterns.append(([(int(n), int(need[n])) for n in used[::-1]], times))
    return patterns + _best_fit(rest, capacity)


def _exact_fill(left: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that sum to ``gap``, longest first."""
    if left[gap]:
        return [gap]
    pair = _pair(left, gap)
    if pair:
        return pair
    for a in np.flatnonzero(left[:gap - 1])[::-1]:
        if 3 * a < gap:
            break
        left[a] -= 1
        pair = _pair(left, gap - int(a))
        left[a] += 1
        if pair and pair[0] <= a:
            return [int(a), *pair]
    return None


def _pair(left: np.ndarray, total: int) -> list[int] | None:
    a = np.arange((total + 1) // 2, total)
    b = total - a
    ok = np.flatnonzero((left[a] > 0) & (left[b] > (a == b)))
    return [int(a[ok[-1]]), int(b[ok[-1]])] if len(ok) else None


def _best_fit(rest: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over counts: the fullest sequence with room takes
    the next piece, and as many more of its length as fit."""
    open_by_gap: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    done = []
    for n in range(capacity, 0, -1):
        k = int(rest[n])
        while k:
            gap = min((g for g in open_by_gap if g >= n), default=None)
            pattern, bins = open_by_gap[gap].pop() if gap is not None else ([], -1)
            gap = capacity if gap is None else gap
            each = gap // n
            if bins < 0:
                bins = k // each + (k % each > 0)
            elif not open_by_gap[gap]:
                del open_by_gap[gap]
            full = min(bins, k // each)
            part = k % each if full < bins else 0
            for times, m in ((each, full), (part, 1 if part else 0), (0, bins - full - (1 if part else 0))):
                if m:
                    open_by_gap.setdefault(gap - times * n, []).append((pattern + [(n, times)] if times else pattern, m))
            k -= full * each + part
    for group in open_by_gap.values():
        done += group
    return done


def place_table(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, times in it, first offset).

    Rank r from a row's first rank on goes to sequence first + (r - first
    rank) // times, as its (r - first rank) % times'th piece of that length.
    """
    rank: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for pattern, bins in patterns:
        offset = 0
        for n, times in pattern:
            rows.setdefault(n, []).append((rank.get(n, 0), sequence, times, offset))
            rank[n] = rank.get(n, 0) + times * bins
            offset += n * times
        sequence += bins
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def _place(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rows = table[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                past = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + past // row[:, 2]
                offset[at] = row[:, 3] + past % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                                              pa.array(sequence), pa.array(offset)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A null or empty text is the single end id. Rows that repeat a doc_id are
    packed each on its own. Other columns are ignored; an empty table gives no
    rows. Equal lengths take their places in the order of the document's hash
    bucket, doc_id and piece.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pieces = stage_table(docs.transform(map_batches, _pieces(tokenizer_path, capacity, end_id), _PIECES, tokenizer_path), "pieces")
    by_length = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_length:
        counts[r["length"]] = r["count"]
    places = spark.sparkContext.broadcast(place_table(plan_patterns(counts, capacity)))
    buckets = max(1, int(counts.sum()) // BUCKET_PIECES)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    ahead = (pieces.groupBy("length", "bucket").count()
             .withColumn("ahead", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count"))
             .select("length", "bucket", "ahead"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    ranked = (pieces.withColumn("rank", F.row_number().over(within) - 1).join(ahead, ["length", "bucket"])
              .withColumn("rank", F.col("rank") + F.col("ahead")))
    return ranked.transform(map_batches, _place(places), _PIECES + ", sequence_id long, offset long")
