"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix
filters, and one verification a pair.

Word n-grams are 64-bit hashes. They are ordered rare first by the counts of a
fixed table of 2**20 buckets, gathered over the whole corpus (8 MB whatever
its size, so it is broadcast), then by hash: any order common to all documents
keeps the prefix filter exact. Documents with equal n-gram sets form one
class. Two classes that reach the threshold share a gram of their prefixes.

Not all pairs that share one are made. First every class of a prefix gram is
paired with the gram's class that has the fewest rarer grams, which is one pair a
class and ties most groups of copies together. Only grams whose
classes are then still in several components make the pairs that could still
join them: each class outside the gram's commonest component with those of
other components. A link between two classes of one component changes nothing
and is not looked for.

Where a gram has many classes outside its commonest component (boilerplate that
unlike documents share) these would be all pairs of a crowd. Its classes are
paired by signatures instead: two sets that link differ in at most H grams, so
that of H + 1 parts into which the grams are dealt by hash at least one holds
the same grams in both. Sets of neighbouring size bands are compared in the
parts of the larger one's band. The positional filter holds for them too: what
precedes a class's first crowded gram is common to none of these pairs. Before
any classes are paired, those whose place leaves no room for a link with even
the smallest class of their gram go. No link is lost.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootcause.llm import textblocks as T
from rootcause.llm.tables import connected_components, map_batches, stage_table, with_ids

ORDER_BITS = 20
CHUNKS = 64
#: Parts that a document's grams are dealt into by hash for the suffix filter.
SUFFIX_PARTS = 64
#: Classes of a gram outside its commonest component above which they are
#: paired by signatures.
CROWD = 128
_SIGN = np.uint64(0x9E3779B97F4A7C15)


def document_sets(data: np.ndarray, offs: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each document; a document of fewer
    words has one gram of all of them, one without words has none."""
    hashes, index, _ = T.words(data, offs, T.NOT_SPACE, lower=True)
    grams, starts = T.gram_hashes(hashes, index, n)
    at = np.searchsorted(starts, index)
    for i in range(len(index) - 1):
        if at[i + 1] > at[i]:
            yield np.unique(grams[at[i]:at[i + 1]])
        elif index[i + 1] > index[i]:
            yield T.range_hashes(hashes, index[i:i + 1], index[i + 1:i + 2], T.WORD_BASE)
        else:
            yield np.zeros(0, np.uint64)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for b in batches:
        data, offs = T.text_buffers(b["text"])
        ids = b["doc_id"].to_pylist()
        for i, j in T.blocks(offs):
            yield from zip(ids[i:j], document_sets(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i], n))


def _profile(n: int):
    """Size, digest and part sizes of every document's set; then the task's bucket counts."""
    names = ["doc_id", "n_shingles", "digest", "parts", "chunk", "counts"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.binary())
    shift = np.uint64(64 - (SUFFIX_PARTS.bit_length() - 1))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(1 << ORDER_BITS, np.uint32), []
        for doc_id, s in _sets(batches, n):
            np.add.at(counts, s >> np.uint64(64 - ORDER_BITS), np.uint32(1))
            parts = np.bincount((s >> shift).astype(np.int64), minlength=SUFFIX_PARTS).astype(np.int32)
            rows.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest(), parts, None, None))
            if len(rows) == 4096:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)
        if counts.any():
            for k, part in enumerate(np.split(counts, CHUNKS)):
                yield batch([(None, None, None, None, k, _packed(part))])
    return run


def _packed(counts: np.ndarray) -> bytes:
    """Counts as compressed byte planes: most of a task's are 0 to 9."""
    return zlib.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, counts in zip(b["chunk"].to_pylist(), b["counts"]):
            total[chunk] = total.get(chunk, 0) + _unpacked(counts.as_py()).astype(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                      pa.array([v.tobytes() for v in total.values()], pa.binary())], ["chunk", "counts"])


def _ranked(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return s[np.argsort(counts[s >> np.uint64(64 - ORDER_BITS)], kind="stable")]  # s is sorted by hash


def _prefixes(n: int, percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for doc_id, s in _sets(batches, n):
            if not len(s):
                continue
            keep = len(s) - -(-percent * len(s) // 100) + 1
            cols[0].append(_ranked(s, counts.value)[:keep])
            cols[1].append(np.full(keep, doc_id, np.int64))
            cols[2].append(np.full(keep, len(s), np.int64))
            cols[3].append(np.arange(keep))
            if len(cols[0]) == 512:
                yield _prefix_batch(cols)
                cols = [[], [], [], []]
        if cols[0]:
            yield _prefix_batch(cols)
    return run


def _prefix_batch(cols) -> pa.RecordBatch:
    gram, doc, size, place = map(np.concatenate, cols)
    return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(doc),
                                       pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))],
                                      ["gram", "id", "size", "place"])


def _set_rows(n: int):
    """Each document's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, s in _sets(batches, n):
            rows.append((doc_id, s.tobytes()))
            if len(rows) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))],
                                                 ["id", "grams"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))],
                                             ["id", "grams"])
    return run


@lru_cache(maxsize=64)
def size_bands(largest: int, percent: int) -> np.ndarray:
    """First sizes of the bands up to the one after that of ``largest``: sets
    that link are of the same band or of neighbours."""
    firsts = [1]
    while firsts[-1] <= largest:
        firsts.append(100 * firsts[-1] // percent + 1)
    firsts.append(100 * firsts[-1] // percent + 1)
    return np.array(firsts, np.int64)


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """A key for each part of the set, in the parts of its own size band and of the next."""
    bands = size_bands(1 << len(s).bit_length(), percent)
    own = int(np.searchsorted(bands, len(s), "right")) - 1
    spread, keys = T.mix(s ^ _SIGN), []
    for band in (own, own + 1):
        largest = int(100 * bands[band] // percent)  # the last size of the band
        parts = 2 * largest * (100 - percent) // (100 + percent) + 1
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, (spread % np.uint64(parts)).astype(np.int64), spread)
        place = np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(256) + np.uint64(band)
        keys.append(T.mix(sums + T.mix(place)))
    return np.concatenate(keys)


def _signed(n: int, percent: int):
    """(gram, id, size) with the signatures of every set in place of its grams."""
    def batch(rows):
        ids, sizes, keys = zip(*rows)
        times = [len(k) for k in keys]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), times)),
             pa.array(np.repeat(np.array(sizes, np.int32), times))], ["gram", "id", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, s in _sets(batches, n):
            if len(s):
                rows.append((doc_id, len(s), signatures(s, percent)))
            if len(rows) == 128:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)
    return run


def _verify(percent: int):
    """Pairs that reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["grams_a"], b["grams_b"]):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _needed(percent: int, a, b):
    """Common grams that sets of these sizes need."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent) - 1e-9)


def _parts_allow(percent: int, size_a: str, size_b: str, parts_a: str, parts_b: str):
    """Suffix filter: two sets differ in at least the size differences of their parts."""
    a, b = F.col(size_a), F.col(size_b)
    apart = F.aggregate(F.zip_with(parts_a, parts_b, lambda x, y: F.abs(x - y)), F.lit(0), lambda acc, x: acc + x)
    return apart <= a + b - 2 * _needed(percent, a, b)


def _can_reach(percent: int, size_a: str, size_b: str, place_a: str, place_b: str):
    """Length and positional filter of a pair that shares a gram at these places.

    What precedes the first gram in common is not common: the place of that
    gram leaves room for the overlap in both sets. A pair that links passes at
    least there.
    """
    a, b = F.col(size_a), F.col(size_b)
    need = _needed(percent, a, b)
    length = F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)
    return length & (F.least(a - F.col(place_a), b - F.col(place_b)) >= need)


def _reaches_any(percent: int):
    """Whether a class can link with any class of its gram, whose sizes are
    ``small`` to ``large``: what :func:`_can_reach` asks of the smallest
    partner that a class of this size and place may have."""
    size, least = F.col("size"), F.greatest(F.lit(100) * F.col("small"), F.lit(percent) * F.col("size"))
    room = F.lit(100 * (100 + percent)) * (size - F.col("place"))
    return (F.lit(percent) * (F.lit(100) * size + least) <= room) & (F.lit(percent) * size <= F.lit(100) * F.col("large"))


def _open(rows: DataFrame, component: DataFrame, parts: DataFrame, percent: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows of grams whose classes are in several components, with component
    and parts, without classes that can link with none of their gram; by gram
    its commonest component and how many classes are not of it)."""
    rows = rows.withColumn("size", F.col("size").cast("long"))
    labelled = rows.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    several = (labelled.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                            F.min("size").alias("small"), F.max("size").alias("large"))
               .where("lo < hi").select("gram", "small", "large"))
    labelled = labelled.join(several, "gram").where(_reaches_any(percent)).drop("small", "large")
    labelled = stage_table(labelled.join(parts, ["id", "size"]), name)
    common = (labelled.groupBy("gram", "component").count().groupBy("gram")
              .agg(F.max(F.struct("count", "component")).alias("m"), F.sum("count").alias("n"))
              .select("gram", F.col("m.component").alias("common"), (F.col("n") - F.col("m.count")).alias("others")))
    return labelled, common


def _across(labelled: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """Pairs of a gram's classes outside its commonest component with those of
    other components that may link."""
    minor = (labelled.join(common, "gram").where("component != common")
             .select("gram", *(F.col(c).alias(f"{c}2") for c in ("id", "size", "place", "component", "parts"))))
    return (labelled.join(minor, "gram").where("component != component2")
            .where(_can_reach(percent, "size", "size2", "place", "place2"))
            .where(_parts_allow(percent, "size", "size2", "parts", "parts2"))
            .select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")))


def _links(pairs: DataFrame, docs: DataFrame, n: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) that verify."""
    sets = stage_table(with_ids(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
                       .transform(map_batches, _set_rows(n), "id long, grams binary"), f"{name}-sets")
    full = (pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b")), "b"))
    return stage_table(full.transform(map_batches, _verify(percent), "a long, b long"), f"{name}-links")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Two documents link when 100 * shared grams >= percent * grams of either.
    component_id is the smallest doc_id reachable, the row's own included. A
    null or empty text, or one of white space, has no grams and no link. Rows
    that repeat a doc_id count as one document and share a component; a row
    without doc_id has a null component, and links with nothing, unless a
    document with an id has the same grams. Other columns are ignored. ``crowd``
    changes the work, not the result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    profile = stage_table(docs.transform(map_batches, _profile(n), "doc_id long, n_shingles long, digest string, parts array<int>, chunk int, counts binary"),
                          "shingles")
    chunks = (profile.where("chunk IS NOT NULL").select("chunk", "counts")
              .repartition(CHUNKS, "chunk").transform(map_batches, _add_counts, "chunk int, counts binary").collect())
    counts = np.zeros(1 << ORDER_BITS, np.uint64)
    for r in chunks:
        counts.reshape(CHUNKS, -1)[r["chunk"]] = np.frombuffer(bytes(r["counts"]), np.uint64)
    order = spark.sparkContext.broadcast(counts)
    rows = profile.where("n_shingles IS NOT NULL").select("doc_id", "n_shingles", "digest")

    classes = (rows.where("n_shingles > 0").groupBy("digest", "n_shingles")
               .agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("top")))
    classes = stage_table(classes, "classes")
    # A doc_id with several texts is one document: its classes are linked, and
    # it is no copy, since it may stand for the class of another of its texts.
    mixed = stage_table(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id")
                        .agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high").select("doc_id"), "mixed")
    copies = (rows.where("n_shingles > 0").join(classes.where("top > id"), ["digest", "n_shingles"])
              .where("doc_id > id").select("doc_id"))
    alike = None
    if not mixed.isEmpty():
        copies = with_ids(copies, mixed, "left_anti")
        held = (with_ids(rows.where("n_shingles > 0"), mixed).join(classes, ["digest", "n_shingles"]).select("doc_id", "id").distinct())
        alike = held.join(held.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a != b")
    firsts = with_ids(docs.where("doc_id IS NOT NULL"), stage_table(copies, "copies"), "left_anti")

    # Most prefix grams are in one class. The counts alone are shuffled to find
    # the others; the prefixes are made again to be filtered by them, which is
    # cheaper than to keep them.
    prefixes = firsts.transform(map_batches, _prefixes(n, percent, order), "gram long, id long, size int, place int")
    shared = stage_table(prefixes.groupBy("gram").count().where("count > 1").select("gram"), "shared-grams")
    grams = stage_table(with_ids(prefixes, shared, key="gram"), "shared")

    # Round 1: pairs with the gram's class that has the fewest rarer grams, which
    # is near the middle of a group of copies.
    hubs = grams.groupBy("gram").agg(F.min(F.struct(F.col("place").alias("p"), F.xxhash64("id").alias("k"), "id", "size", "place"))
                                     .alias("hub"))
    parts = profile.where("n_shingles > 0").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "parts")
    first = (grams.join(hubs, "gram").select("id", "size", "place", F.col("hub.id").alias("id2"),
                                             F.col("hub.size").alias("size2"), F.col("hub.place").alias("place2"))
             .where("id != id2").where(_can_reach(percent, "size", "size2", "place", "place2"))
             .select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
             .join(parts.toDF("a", "size", "parts"), "a").join(parts.toDF("b", "size2", "parts2"), "b")
             .where(_parts_allow(percent, "size", "size2", "parts", "parts2")).select("a", "b"))
    first = stage_table(first, "pairs")
    links = _links(first, docs, n, percent, "first")
    if alike is not None:
        links = stage_table(links.union(alike), "links")
    component = stage_table(connected_components(links), "labels")

    # Round 2: what could still join two components.
    labelled, common = _open(grams, component, parts, percent, "open")
    common = stage_table(common, "common")
    second = _across(labelled, common.where(F.col("others") <= crowd), percent)
    crowded = common.where(F.col("others") > crowd).select("gram")
    if not crowded.isEmpty():
        # Signatures look for the pairs whose first gram in common is a crowd's:
        # the grams before the class's first such gram are in neither overlap.
        leads = stage_table(labelled.join(crowded, "gram").groupBy(F.col("id").alias("doc_id")).agg(F.min("place").alias("place")),
                            "crowded")
        signed = with_ids(firsts, leads).transform(map_batches, _signed(n, percent), "gram long, id long, size int")
        signed = signed.join(leads.withColumnRenamed("doc_id", "id"), "id")
        labelled, common = _open(signed, component, parts, percent, "signed")
        second = second.union(_across(labelled, common, percent))
    second = stage_table(second.distinct(), "met")
    second = stage_table(second.join(first, ["a", "b"], "left_anti"), "more-pairs")
    if not second.isEmpty():
        more = _links(second, docs, n, percent, "second")
        if not more.isEmpty():
            component = stage_table(connected_components(links.union(more)), "labels")

    out = rows.join(classes.select("digest", "n_shingles", "id"), ["digest", "n_shingles"], "left")
    out = out.join(component.withColumnRenamed("node", "id"), "id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "id", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows of a component other than its smallest doc_id.

    Rows without doc_id stay. Columns stay as they are.
    """
    gone = near_duplicates(docs, n, percent).where("doc_id != component_id").select("doc_id")
    return with_ids(docs, stage_table(gone, "duplicates"), "left_anti")
