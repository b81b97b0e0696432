"""Windows of units (words or bytes) that occur in more than one place.

Comparing every window with every other would shuffle the corpus many times
over. Instead every window is filed under its anchor, the least hash among the
short grams inside it: equal windows have equal anchors at equal places.
Neighbouring windows mostly share their anchor and form a run.

1. Exact copies of a whole document are settled by digest.
2. Runs of all other documents are shuffled once by anchor, as a few numbers;
   equal runs of one document (a line said a hundred times) are one row with
   all its places. Runs whose anchor occurs once hold no repeat and end here.
   Runs with equal content are represented by the first of them. Anchors of
   very many runs are found by a count beforehand; theirs are not brought
   together but aggregated and joined, which Spark can split.
3. The texts of the runs that are left go to chunks of bounded size, by
   anchor. A chunk's index (an FM-index or a radix sort, given by the caller)
   numbers the windows so that equal windows have equal numbers; the earliest
   of each number stays. An anchor with more runs than a chunk may hold is
   dealt over several by a second gram of its windows, so that equal windows
   still meet. What is then still too much for a chunk is taken in parts, and
   the parts' windows are merged by digest, by a partially aggregated min.
4. Removed intervals are joined to the documents that have any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootcause.llm import textblocks as T
from rootcause.llm.tables import map_batches, stage_table, with_ids

U64 = np.uint64
_LOW = U64((1 << 24) - 1)
#: Units that are cut into runs at a time.
PIECE_UNITS = 1 << 20


@dataclass(frozen=True)
class Kind:
    """What a unit is, and which windows count."""

    window: int
    gram: int
    #: (bytes, offsets) -> (units, first unit of every document and total); a unit
    #: is a 64-bit word hash or a byte.
    units: Callable
    #: Whether an earlier place in the same document counts as a repeat.
    within: bool
    #: (hashes of joined runs, start of every window in them, window) -> a number
    #: for every window, equal for equal windows.
    index: Callable
    #: Units that one chunk's index holds (up to four times as many in one
    #: group), and runs of one anchor that go to one chunk.
    chunk_units: int = 400_000
    anchor_runs: int = 4_000
    #: Rows of one anchor that may meet in one task.
    hot_runs: int = 200_000


def find_runs(codes: np.ndarray, index: np.ndarray, window: int, gram: int):
    """(document, start, windows, anchor's place, anchor, digest) of every run."""
    out = []
    for i, j in T.blocks(index, PIECE_UNITS):
        # One document that is longer than a piece is taken in pieces that
        # overlap by a window less one unit.
        for lo in range(int(index[i]), int(index[j]), PIECE_UNITS):
            hi = min(int(index[j]), lo + PIECE_UNITS + window - 1) if j == i + 1 else int(index[j])
            ends = np.repeat(index[i + 1:j + 1], np.diff(index[i:j + 1]))[lo - index[i]:hi - index[i]]
            got = _runs_of_piece(codes[lo:hi], np.minimum(ends, hi) - lo, window, gram)
            if got is not None:
                start, rest = got[0] + lo, got[1:]
                doc = np.searchsorted(index, start, "right") - 1
                out.append((doc, start - index[doc], *rest))
            if hi == index[j]:
                break
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64, U64))
    return tuple(np.concatenate(c) for c in zip(*out))


def _codes(units: np.ndarray) -> np.ndarray:
    return units if units.dtype == U64 else T._byte_codes(1)[units]


def _runs_of_piece(codes: np.ndarray, ends: np.ndarray, window: int, gram: int):
    n = len(codes) - window + 1
    if n <= 0:
        return None
    codes = _codes(codes)
    at = np.arange(len(codes) - gram + 1)
    grams = T.range_hashes(codes, at, at + gram, T.WORD_BASE)
    least = (grams & ~_LOW) | at.astype(U64)
    width, have = window - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    starts = np.flatnonzero(ends[:n] >= np.arange(n) + window)
    if not len(starts):
        return None
    anchor = (least[starts] & _LOW).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    start, anchor = starts[first], anchor[first]
    place = anchor - start
    digest = T.mix(T.range_hashes(codes, start, start + count + window - 1, T.BYTE_BASE) ^ place.astype(U64))
    return start, count, place, grams[anchor], digest


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def _emit_runs(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = T.text_buffers(b["text"])
            ids = b["doc_id"].to_numpy(zero_copy_only=False)
            for i, j in T.blocks(offs):
                codes, index = kind.units(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                doc, start, count, place, anchor, digest = find_runs(codes, index, kind.window, kind.gram)
                if len(doc):
                    first, more = _once_a_document(doc, start, anchor, digest)
                    pack = (start << 16) | (count << 8) | place
                    yield pa.RecordBatch.from_arrays(
                        [_long(anchor[first]), _long(digest[first]), _long(ids[i:j][doc[first]]), _long(pack[first]), more],
                        ["anchor", "digest", "doc_id", "pack", "more"])
    return run


def _once_a_document(doc, start, anchor, digest) -> tuple[np.ndarray, pa.Array]:
    """The first of equal runs of one document, and the starts of the others."""
    order = np.argsort(digest ^ T.mix(doc.astype(U64)), kind="stable")  # places stay in order
    new = np.zeros(len(order), bool)
    new[0] = True
    for key in (doc, anchor, digest):
        new[1:] |= key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(new)
    rest = order[~new]
    ends = np.append(first[1:], len(order)) - np.arange(1, len(first) + 1)
    more = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), _long(start[rest]))
    return order[first], more


def _emit_texts(kind: Kind):
    """The units of the listed runs of each document.

    A run of an anchor that is dealt over several chunks is cut where the
    greatest gram of its windows changes, and goes by that gram: equal windows
    still meet.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = T.text_buffers(b["text"])
            for r in range(b.num_rows):
                units, _ = kind.units(data[offs[r]:offs[r + 1]], np.array([0, offs[r + 1] - offs[r]]))
                raw, size = units.tobytes(), units.itemsize
                runs = b["runs"][r].values
                pack, dealt = runs.field("pack").to_numpy(), runs.field("dealt").to_numpy()
                start, count = pack >> 16, (pack >> 8) & 255
                at, piece, salt = _cut_runs(units, start, count, dealt, kind)
                for lo in range(0, len(at), 4096):
                    i, (from_, windows) = at[lo:lo + 4096], piece[:, lo:lo + 4096]
                    begin = (start[i] + from_) * size
                    end = begin + (windows + kind.window - 1) * size
                    yield pa.RecordBatch.from_arrays(
                        [*(runs.field(c).take(pa.array(i)) for c in ("anchor", "digest", "pack")),
                         pa.array(salt[lo:lo + 4096]), pa.array(from_.astype(np.int32)), pa.array(windows.astype(np.int32)),
                         pa.array(np.full(len(i), b["doc_id"][r].as_py(), np.int64)),
                         pa.array([raw[x:y] for x, y in zip(begin.tolist(), end.tolist())], pa.binary())],
                        ["anchor", "digest", "pack", "salt", "from", "windows", "doc_id", "units"])
    return run


def _cut_runs(units: np.ndarray, start: np.ndarray, count: np.ndarray, dealt: np.ndarray, kind: Kind):
    """(run, its pieces as [first window, windows], chunk of the anchor) of every piece."""
    hot = np.flatnonzero(dealt > 1)
    if not len(hot):
        return np.arange(len(start)), np.stack([np.zeros_like(count), count]), np.zeros(len(start), np.int64)
    cold = np.flatnonzero(dealt <= 1)
    at, first, windows, salt = [cold], [np.zeros_like(cold)], [count[cold]], [np.zeros_like(cold)]
    for i in hot.tolist():
        codes = _codes(units[start[i]:start[i] + count[i] + kind.window - 1])
        gram = np.arange(len(codes) - kind.gram + 1)
        most = T.range_hashes(codes, gram, gram + kind.gram, T.BYTE_BASE)
        width, have = kind.window - kind.gram + 1, 1
        while have < width:
            step = min(have, width - have)
            most = np.maximum(most[:-step], most[step:])
            have += step
        cut = np.append(0, np.flatnonzero(most[1:] != most[:-1]) + 1)
        at.append(np.full(len(cut), i))
        first.append(cut)
        windows.append(np.diff(np.append(cut, count[i])))
        salt.append((most[cut] % U64(dealt[i])).astype(np.int64))
    return np.concatenate(at), np.stack([np.concatenate(first), np.concatenate(windows)]), np.concatenate(salt)


_DECIDED = "anchor long, digest long, doc_id long, pack long, first long, last long, place long, window_hash long"


def _decide(kind: Kind, dtype):
    """Removed intervals of the runs of each chunk. A chunk is a number of
    whole (anchor, salt) groups. One that outgrows four chunks by itself is
    taken in parts, and its windows are returned to be merged."""
    schema = ["anchor", "digest", "doc_id", "pack", "first", "last", "place", "window_hash"]
    item = np.dtype(dtype).itemsize

    def chunk(rows: list[pa.RecordBatch], part_of_group: bool) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        data, offs = T.text_buffers(t["units"].cast(pa.large_binary()))
        units = data.view(dtype) if item > 1 else data
        seg_at = offs[:-1] // item
        anchor, digest, doc, pack, from_, count = (
            t[c].to_numpy().astype(np.int64) for c in ("anchor", "digest", "doc_id", "pack", "from", "windows"))
        seg = np.repeat(np.arange(len(pack)), count)
        inside = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
        number = kind.index(units, seg_at, seg_at[seg] + inside, kind.window)
        rel = inside + from_[seg]
        place = (pack >> 16)[seg] + rel
        if part_of_group:
            # Of equal windows of one part the earliest stands for all but is
            # not known to be the earliest of the group.
            pos = seg_at[seg] + inside
            hashes = T.range_hashes(_codes(units), pos, pos + kind.window, T.BYTE_BASE)
            yield _batch(schema, anchor[seg], digest[seg], doc[seg], pack[seg], rel, rel + kind.window, place, hashes)
            return
        edge = np.flatnonzero(_repeats(number, doc[seg], place, kind.within))
        # Intervals of neighbouring removed windows, relative to the run.
        new = np.ones(len(edge), bool)
        new[1:] = (edge[1:] != edge[:-1] + 1) | (seg[edge[1:]] != seg[edge[:-1]])
        first = edge[new]
        last = edge[np.append(np.flatnonzero(new)[1:] - 1, len(edge) - 1)] if len(edge) else edge
        yield _batch(schema, anchor[seg[first]], digest[seg[first]], doc[seg[first]], pack[seg[first]],
                     rel[first], rel[last] + kind.window, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # whole groups
        group, group_size, outgrown, last = [], 0, False, None
        for b in batches:
            anchor, salt = b["anchor"].to_numpy(), b["salt"].to_numpy()
            lengths = pc.binary_length(b["units"]).to_numpy() // item
            new = np.ones(len(anchor), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])
            cuts = [*np.flatnonzero(new).tolist(), len(anchor)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if (anchor[s], salt[s]) != last:  # the group before is whole
                    if outgrown:
                        if group:
                            yield from chunk(group, True)
                    else:
                        held, size = held + group, size + group_size
                        if size >= kind.chunk_units:
                            yield from chunk(held, False)
                            held, size = [], 0
                    group, group_size, outgrown, last = [], 0, False, (anchor[s], salt[s])
                group.append(b.slice(s, e - s))
                group_size += int(lengths[s:e].sum())
                if group_size >= 4 * kind.chunk_units:
                    outgrown = True
                    yield from chunk(group, True)
                    group, group_size = [], 0
        if outgrown:
            if group:
                yield from chunk(group, True)
        else:
            held += group
        if held:
            yield from chunk(held, False)
    return run


def _batch(schema, *cols) -> pa.RecordBatch:
    n = len(cols[0])
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else _long(c) for c in cols], schema)


def _repeats(number: np.ndarray, doc: np.ndarray, place: np.ndarray, within: bool) -> np.ndarray:
    """Whether an earlier place has the same number (-1: the window is alone)."""
    out = np.zeros(len(number), bool)
    at = np.flatnonzero(number >= 0)
    at = at[np.lexsort((place[at], doc[at], number[at]))]
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = number[at][1:] != number[at][:-1]
        head = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        out[at] = doc[head] < doc[at]
        if within:
            out[at] |= (doc[head] == doc[at]) & (place[head] < place[at])
    return out


def removed_intervals(docs: DataFrame, kind: Kind, unit_type) -> DataFrame:
    """doc_id and intervals (array of struct first, last: units, past the end)
    of every document that loses units, exact copies of documents left out.

    ``docs`` has doc_id and text, whole copies already taken out.
    """
    runs = docs.where("doc_id IS NOT NULL").transform(map_batches, 
        _emit_runs(kind), "anchor long, digest long, doc_id long, pack long, more array<long>")
    # The counts are aggregated before their shuffle; hot anchors are at most
    # one for every `hot_runs` rows.
    hot = stage_table(runs.groupBy("anchor").count().where(F.col("count") > kind.hot_runs).select("anchor"), "hot-anchors")
    if hot.isEmpty():
        held = _held_together(runs, kind)
    else:
        held = _held_together(with_ids(runs, hot, "left_anti", "anchor"), kind).union(
            _held_apart(stage_table(with_ids(runs, hot, key="anchor"), "hot-runs")))
    held = stage_table(held, "runs")

    dealt = F.ceil(F.col("heads") / kind.anchor_runs).cast("int")
    heads = held.where("is_head").select("anchor", "digest", "doc_id", "pack", dealt.alias("dealt")).distinct()
    by_doc = heads.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "dealt", "digest", "pack")).alias("runs"))
    texts = (with_ids(docs, heads).join(by_doc, "doc_id")
             .transform(map_batches, _emit_texts(kind), "anchor long, digest long, pack long, salt long, from int, windows int, doc_id long, units binary"))
    decided = (texts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
               .transform(map_batches, _decide(kind, unit_type), _DECIDED))
    decided = stage_table(decided, "decided")

    settled = decided.where("window_hash IS NULL").select("anchor", "digest", "doc_id", "pack", "first", "last")
    dealt_windows = decided.where("window_hash IS NOT NULL")
    key = ["anchor", "window_hash"]
    earliest = dealt_windows.groupBy(*key).agg(F.min(F.struct("doc_id", "place")).alias("e"))
    later = F.col("e.doc_id") < F.col("doc_id")
    if kind.within:
        later = later | ((F.col("e.doc_id") == F.col("doc_id")) & (F.col("e.place") < F.col("place")))
    merged = dealt_windows.join(earliest, key).where(later)
    settled = settled.union(merged.select(*settled.columns))

    start, count = F.shiftright("pack", 16), F.shiftright("pack", 8).bitwiseAND(255)

    def places(starts, first, last):
        return F.transform(starts, lambda s: F.struct((s + first).alias("first"), (s + last).alias("last"))).alias("i")

    everywhere = F.concat(F.array(start), "more")
    nothing, whole = F.lit(0), count + kind.window - 1
    if kind.within:
        # Every place but the first one of all repeats it.
        copies = held.select("doc_id", places(F.when(F.col("is_head"), F.col("more")).otherwise(everywhere), nothing, whole))
        parts = settled.select("doc_id", places(F.array(start), F.col("first"), F.col("last")))
    else:
        # Other places of a run in its own first document share its decisions.
        copies = held.where("doc_id > head_doc").select("doc_id", places(everywhere, nothing, whole))
        peers = held.where("doc_id = head_doc").select("anchor", "digest", "doc_id", "pack", "more")
        parts = (settled.drop("doc_id", "pack").join(peers, ["anchor", "digest"])
                 .select("doc_id", places(everywhere, F.col("first"), F.col("last"))))
    return (copies.where(F.size("i") > 0).union(parts)
            .groupBy("doc_id").agg(F.flatten(F.collect_list("i")).alias("intervals")))


def _weight(kind: Kind):
    """Places that count towards a repeat: those of the same document only if they can be one."""
    return 1 + F.size("more") if kind.within else F.lit(1)


def _held_together(runs: DataFrame, kind: Kind) -> DataFrame:
    """Runs of anchors with several places, each with the first run of its
    content and the anchor's number of contents; an anchor's rows in one task."""
    same = Window.partitionBy("anchor")
    order = Window.partitionBy("anchor", "digest").orderBy("doc_id", "pack")
    return (runs.repartition("anchor").withColumn("total", F.sum(_weight(kind)).over(same)).where("total > 1")
            .withColumn("head_doc", F.first("doc_id").over(order))
            .withColumn("head_pack", F.first("pack").over(order))
            .withColumn("is_head", (F.col("doc_id") == F.col("head_doc")) & (F.col("pack") == F.col("head_pack")))
            .withColumn("heads", F.count(F.when(F.col("is_head"), 1)).over(same))
            .drop("total", "head_pack"))


def _held_apart(runs: DataFrame) -> DataFrame:
    """The same for hot anchors, with partial aggregates and joins."""
    first = runs.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "pack")).alias("h"))
    heads = first.groupBy("anchor").agg(F.count("*").alias("heads"))
    return (runs.join(first, ["anchor", "digest"]).join(heads, "anchor")
            .select("anchor", "digest", "doc_id", "pack", "more", F.col("h.doc_id").alias("head_doc"),
                    ((F.col("doc_id") == F.col("h.doc_id")) & (F.col("pack") == F.col("h.pack"))).alias("is_head"), "heads"))


def drop_copies(profile: DataFrame, at_least: int) -> DataFrame:
    """doc_ids of ``profile`` (doc_id, size, digest) that repeat a whole text
    of at least so many units of a smaller doc_id."""
    long = profile.where(F.col("size") >= at_least)
    first = long.groupBy("digest", "size").agg(F.min("doc_id").alias("first"))
    return long.join(first, ["digest", "size"]).where("doc_id > first").select("doc_id")


def merged_intervals(intervals: pa.ListScalar) -> list[tuple[int, int]]:
    """Sorted intervals with overlapping and touching ones joined."""
    a = intervals.values
    first, last = a.field("first").to_numpy(), a.field("last").to_numpy()
    at = np.argsort(first, kind="stable")
    first, reach = first[at], np.maximum.accumulate(last[at])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1]
    end = np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)
    return list(zip(first[new].tolist(), reach[end].tolist()))


def settle(docs: DataFrame, kind: Kind, unit_type, profile_fn, cut_fn, schema: str) -> tuple[DataFrame, DataFrame]:
    """(profile rows of whole documents, rows of documents that lose a part).

    profile_fn maps (doc_id, text) to size, digest and the columns of
    ``schema`` for a document that loses nothing; cut_fn maps (doc_id, text,
    intervals) to ``schema``. Exact copies are among the profile rows, with
    ``copy`` set.
    """
    docs = docs.select("doc_id", "text")
    cols = [c.split()[0] for c in schema.split(", ")]
    profile = stage_table(docs.transform(map_batches, profile_fn, f"size long, digest string, {schema}"), "profile")
    copies = stage_table(drop_copies(profile, kind.window), "copies")
    intervals = stage_table(removed_intervals(with_ids(docs, copies, "left_anti"), kind, unit_type), "intervals")
    cut = with_ids(docs, intervals).join(intervals, "doc_id").transform(map_batches, cut_fn, schema)
    rest = profile.join(intervals.select("doc_id"), "doc_id", "left_anti").join(
        copies.distinct().withColumn("copy", F.lit(True)), "doc_id", "left")
    return rest, cut.select(cols)
