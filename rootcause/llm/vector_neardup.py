"""Embedding near-dedup by sorted projection passes.

Each pass orders all vectors by the signs of 64 random projections, read as
one number, and compares each vector with the next ``neighbours`` of the
order. A vector's rank in the order is exact (the place in its sorted
partition plus the rows of the partitions before), so the blocks that are
compared, and the result, do not depend on how Spark dealt the rows, and a
clump of any size is spread over as many blocks as it fills.

The verified pairs of all passes, thinned to a forest in each block, give the
components. Links are then counted within components: vectors within half the
threshold angle of the component's first vector are all linked to each other,
which is a count; only the others are compared with the component, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootcause.llm.tables import connected_components, map_batches, stage_table

#: PASSES at least; more where RECALL of the pairs at the threshold needs them.
PASSES, NEIGHBOURS, BLOCK, RECALL = 10, 64, 4096, 0.99
#: Vectors on either side of a block of comparisons within a component.
SIDE = 1024


def _valid_vectors(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, vector in double precision) of usable vectors."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lengths = pc.list_value_length(col).fill_null(0).to_numpy()
    values = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for r in np.flatnonzero(lengths):
        v = values[ends[r] - lengths[r]:ends[r]]
        if np.isfinite(v).all() and v.any():
            yield int(r), v


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, unit = [], []
        for r, v in _valid_vectors(b["embedding"]):
            v = v / np.abs(v).max()
            rows.append(r)
            unit.append((v / math.sqrt(float(v @ v))).tobytes())
        yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(rows, pa.int64())), pa.array(unit, pa.binary())],
                                         ["vec_id", "unit"])


def _matrix(col: pa.Array) -> np.ndarray:
    """The vectors of a column of equal dimension, one a row."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    return np.frombuffer(b"".join(x.as_buffer() for x in col), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _planes(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([dim, number]).standard_normal((dim, 64))


def _keys(passes: int):
    """(pass, key, id) of every vector; the key orders as the sign bits do."""
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = pc.binary_length(b["unit"]).to_numpy() // 8
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = b.take(pa.array(at))
                x = _matrix(part["unit"])
                for k in range(passes):
                    bits = (x @ _planes(int(dim), k)) >= 0
                    key = (bits * weights).sum(axis=1, dtype=np.uint64) ^ np.uint64(1 << 63)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), dim, np.int32)),
                         pa.array(key.view(np.int64)), part["id"]], ["pass", "dim", "key", "id"])
    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that arrive ordered by ``keys``; one is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b[k].to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[s] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _neighbours(threshold: float, neighbours: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ["pass", "dim", "block"]):
            x, ids = _matrix(t["unit"]), t["id"].to_numpy()
            parent = np.arange(len(ids))

            def find(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            links = []
            for at in range(0, len(ids), neighbours):
                near = x[at:at + neighbours] @ x[at:at + 2 * neighbours].T >= threshold
                for i, j in zip(*np.nonzero(near)):
                    if 0 < j - i <= neighbours:
                        p, q = find(at + i), find(at + j)
                        if p != q:
                            parent[p] = q
                            links.append((ids[at + i], ids[at + j]))
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _near_pivot(threshold: float):
    # Two vectors within half the threshold angle of a third are linked; the
    # margin covers rounding.
    inner = math.cos(math.acos(threshold) / 2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [len(x.as_buffer()) == len(p.as_buffer())
                    and float(np.frombuffer(x.as_buffer()) @ np.frombuffer(p.as_buffer())) >= inner
                    for x, p in zip(b["unit"], b["pivot"])]
            yield pa.RecordBatch.from_arrays([b["component"], b["id"], b["rows"], pa.array(near, pa.bool_()), b["unit"]],
                                             ["component", "id", "rows", "inner", "unit"])
    return run


def _count_links(threshold: float):
    """Links between the outer side's vectors and all of the component, by vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ["component", "outer_block", "block"]):
            side = t["side"].to_numpy()
            a, b = t.take(pa.array(np.flatnonzero(side == 0))), t.take(pa.array(np.flatnonzero(side == 1)))
            id_a, id_b = a["id"].to_numpy(), b["id"].to_numpy()
            linked = (_matrix(a["unit"]) @ _matrix(b["unit"]).T >= threshold) & (id_a[:, None] != id_b[None, :]) \
                if len(a) and len(b) else np.zeros((len(a), len(b)), bool)
            # A pair of two outer vectors is met from either side; each counts
            # for its first vector only.
            to_outer = linked @ b["rows"].to_numpy()
            to_inner = (linked * a["rows"].to_numpy()[:, None]).sum(axis=0) * b["inner"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([id_a, id_b]), pa.int64()),
                                              pa.array(np.concatenate([to_outer, to_inner]).astype(np.int64))], ["id", "links"])
    return run


def passes_for(n: int, threshold: float, neighbours: int, recall: float = RECALL) -> int:
    """Passes in which a pair at the threshold is met with probability ``recall``.

    One bit is the same for both with probability 1 - angle / pi. A pass
    compares two vectors that share their first log2(n / neighbours) bits: so
    many leave about ``neighbours`` of n evenly spread vectors together.
    """
    bits = math.log2(max(1.0, n / neighbours))
    met = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return max(PASSES, math.ceil(math.log(1 - recall) / math.log1p(-met))) if met < 1 else PASSES


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, passes: int | None = None,
                           neighbours: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without vec_id, link with nothing; so do vectors of different
    dimension. Equal vectors are one class, whose rows are linked to each
    other. Rows that repeat a vec_id share its component and are counted each.
    Other columns are ignored. ``passes`` follow the number of different
    vectors unless they are given.
    """
    ids = vectors.select("vec_id", "embedding")
    unit = stage_table(ids.where("vec_id IS NOT NULL").transform(map_batches, _normalise, "vec_id long, unit binary")
                       .withColumn("digest", F.md5("unit")), "units")
    classes = unit.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("rows"))
    classes = stage_table(classes, "classes")
    firsts = stage_table(unit.join(classes.withColumnRenamed("id", "vec_id"), ["digest", "vec_id"])
                         .select(F.col("vec_id").alias("id"), "rows", "unit").dropDuplicates(["id", "unit"]), "firsts")

    if passes is None:
        passes = passes_for(firsts.count(), threshold, neighbours)
    order = ["pass", "dim", "key", "tie", "id"]
    ranked = (firsts.transform(map_batches, _keys(passes), "pass int, dim int, key long, id long")
              .withColumn("tie", F.xxhash64("id", "pass")).orderBy(*order)
              .withColumn("at", F.monotonically_increasing_id()))
    ranked = stage_table(ranked.withColumn("part", F.shiftright("at", 33))
                         .withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "ranks")
    # One row for each sorted partition.
    ahead = (ranked.groupBy("part").count()
             .withColumn("ahead", F.sum("count").over(Window.orderBy("part")) - F.col("count")).select("part", "ahead"))
    rank = F.col("ahead") + F.col("at")
    blocks = (ranked.join(ahead, "part").withColumn("rank", rank)
              .withColumn("block", F.explode(F.when(F.col("rank") % block < neighbours, F.array(
                  F.floor(F.col("rank") / block), F.floor(F.col("rank") / block) - 1))
                  .otherwise(F.array(F.floor(F.col("rank") / block)))))
              .select("pass", "dim", "block", "rank", "id"))
    edges = (blocks.join(firsts.select("id", "unit"), "id").repartition("pass", "dim", "block")
             .sortWithinPartitions("pass", "dim", "block", "rank").transform(map_batches, _neighbours(threshold, neighbours), "a long, b long"))
    component = stage_table(connected_components(edges, "vector-components"), "labels")

    members = component.withColumnRenamed("node", "id").join(firsts, "id")
    pivot = firsts.select(F.col("id").alias("component"), F.col("unit").alias("pivot"))
    members = stage_table(members.join(pivot, "component").transform(map_batches, 
        _near_pivot(threshold), "component long, id long, rows long, inner boolean, unit binary"), "members")
    sizes = (members.groupBy("component").agg(F.sum(F.when(F.col("inner"), F.col("rows")).otherwise(0)).alias("inner_rows"),
                                              F.count("*").alias("size"),
                                              F.count(F.when(~F.col("inner"), 1)).alias("outer")))
    sized = members.join(sizes.where("outer > 0").select("component", "size", "outer"), "component")
    n_all, n_outer = F.ceil(F.col("size") / SIDE).cast("int"), F.ceil(F.col("outer") / SIDE).cast("int")
    own = F.xxhash64("id")
    columns = ["component", "outer_block", "block", "side", "id", "rows", "inner", "unit"]
    outer_side = (sized.where("NOT inner").withColumn("outer_block", F.pmod(own, n_outer).cast("int"))
                  .withColumn("block", F.explode(F.sequence(F.lit(0), n_all - 1))).withColumn("side", F.lit(0)))
    all_side = (sized.withColumn("block", F.pmod(own, n_all).cast("int"))
                .withColumn("outer_block", F.explode(F.sequence(F.lit(0), n_outer - 1))).withColumn("side", F.lit(1)))
    counted = (outer_side.select(columns).union(all_side.select(columns)).repartition("component", "outer_block", "block")
               .sortWithinPartitions("component", "outer_block", "block").transform(map_batches, _count_links(threshold), "id long, links long")
               .groupBy("id").agg(F.sum("links").alias("links")))
    links = (members.select("id", "component", "inner", "rows").join(sizes.select("component", "inner_rows"), "component")
             .join(counted, "id", "left")
             .select("id", "component", (F.coalesce("links", F.lit(0))
                                         + F.when(F.col("inner"), F.col("inner_rows") - F.col("rows")).otherwise(0)).alias("links")))
    of_class = (classes.join(links, "id", "left")
                .select("digest", F.coalesce("component", "id").alias("component"),
                        (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("links")))
    found = unit.select("vec_id", "digest").join(of_class, "digest").groupBy("vec_id").agg(
        F.min("component").alias("component"), F.max("links").alias("links"))
    return (ids.select("vec_id").join(found, "vec_id", "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
