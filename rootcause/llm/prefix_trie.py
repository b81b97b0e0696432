"""Trie of conversations that begin alike, from sorted neighbours.

A conversation is its path: 16 bytes of MD5 of each turn's role and text, and
the turn's size. Sorted by path, conversations with a common prefix stand
together, and the trie follows from the lengths of the prefixes that neighbours
share (LCP).

1. Turns are dealt by blocks of conversations that can share turns; each
   becomes one path (24 bytes a turn). Texts are never shuffled.
2. Paths are sorted by range, first with the conversation's id, so that very
   many equal ones lie over several tasks; each task contracts equal ones to
   one row, and a second sort brings these together.
3. A task takes its sorted paths in blocks. Union-find over the LCP edges in
   descending depth: a merge at depth l makes (or widens) the branching node of
   depth l; the nodes between it and the component's last one hold the same
   conversations. What lies beyond the edge of a block can only change nodes
   that are prefixes of its first or last path, as deep as the LCP with the
   neighbour block. All other nodes are final.
4. Those open nodes go on as partial sums under the MD5 of their prefix and are
   merged over all blocks. Each node's bytes, leaves and place among its
   parent's children are counted in the block where it first occurs, so that
   sums are all that is left to do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootcause.llm.tables import map_batches, stage_table
from rootcause.session import reliable_checkpoint

#: Bytes of a turn in a path: digest and size.
TURN = 24
#: Paths and their bytes that a block of a task's sorted paths may hold.
BLOCK_PATHS, BLOCK_BYTES = 100_000, 16 << 20
#: Conversation ids (as text) that travel in one row.
CHUNK_IDS = 50_000
#: Children of one open node that wait for it are dealt over so many keys.
SALTS = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

_PATHS = "path binary, conv_id long, n long, ids string"
_SORTED = "path binary, conv_id long, n long, ends string"
_NODES = ("key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, ends_sha256 string")


def rebuilt_turns(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Turns of every conversation, dealt and sorted for ``_paths``.

    A conversation c begins with the first h = crc32(c) % most turns of the
    first of its family, c - c % family.
    """
    c = conversations.where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    family_id = F.col("conv_id") - F.col("conv_id") % family
    turns = c.select(
        family_id.alias("family"), (F.col("conv_id") != family_id).alias("later"), "conv_id", "turn",
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
        (F.crc32(F.col("conv_id").cast("string")) % most).cast("int").alias("borrowed"))
    return turns.repartition("family").sortWithinPartitions("family", "later", "conv_id", F.asc_nulls_first("turn"), "digest")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A path of every rebuilt conversation."""
    family, first, conv, own, borrowed = None, [], None, [], 0

    def finished() -> tuple[bytes, int]:
        return b"".join(first[:borrowed] + own[borrowed:]), conv

    for b in batches:
        out = []
        for fam, c, digest, size, h in zip(*(b[k].to_pylist() for k in ("family", "conv_id", "digest", "size", "borrowed"))):
            if c != conv:
                if conv is not None:
                    out.append(finished())
                if fam != family:
                    family, first = fam, []
                conv, own, borrowed = c, [], h
            own.append(digest + size.to_bytes(8, "big"))
            if c == fam:
                first = own
        yield _path_rows(out)
    if conv is not None:
        yield _path_rows([finished()])


def _path_rows(rows: list[tuple[bytes, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())],
                                      ["path", "conv_id"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal neighbours as one row with their ids as text, in parts of CHUNK_IDS."""
    path, ids = None, []

    def row():
        return path, ids[0], len(ids), ",".join(map(str, ids))

    for b in batches:
        out = []
        for p, c in zip(b["path"].to_pylist(), b["conv_id"].to_pylist()):
            if p != path or len(ids) == CHUNK_IDS:
                if ids:
                    out.append(row())
                path, ids = p, []
            ids.append(c)
        yield _rows(out, _PATHS)
    if ids:
        yield _rows([row()], _PATHS)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names)


def _merge_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each path, with the hash of all its ids; rows come sorted by path and first id."""
    path, lowest, n, sha = None, 0, 0, None
    for b in batches:
        out = []
        for p, c, count, ids in zip(*(b[k].to_pylist() for k in ("path", "conv_id", "n", "ids"))):
            if p != path:
                if sha is not None:
                    out.append((path, lowest, n, sha.hexdigest()))
                path, lowest, n, sha = p, c, 0, hashlib.sha256()
            sha.update((("," if n else "") + ids).encode())
            n += count
        yield _rows(out, _SORTED)
    if sha is not None:
        yield _rows([(path, lowest, n, sha.hexdigest())], _SORTED)


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        if a[TURN * low:TURN * mid] == b[TURN * low:TURN * mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Forest:
    """The trie nodes of one block of sorted, distinct paths.

    ``before`` and ``after`` are the LCPs with the paths next to the block, -1
    at the ends of the table.
    """

    def __init__(self, rows: list[tuple[bytes, int, int, str]], before: int, after: int):
        self.paths = [r[0] for r in rows]
        self.before, self.after = before, after
        k = len(rows)
        self.lcp = [before, *(common_turns(a, b) for a, b in zip(self.paths, self.paths[1:])), after]
        self.length = [len(p) // TURN for p in self.paths]
        # Bytes of the first d turns, d from 0.
        self.cum = [np.append(0, np.cumsum(np.frombuffer(p, ">i8").reshape(-1, 3)[:, 2].astype(np.int64))) for p in self.paths]
        whole = [int(c[-1]) for c in self.cum]
        # Of each component, at its root: first and last path, conversations,
        # smallest id, n times bytes, leaves, bytes of nodes that its paths but
        # the first one add; then of its topmost node: depth, children, ends, number.
        self.up = list(range(k))
        self.first, self.last = list(range(k)), list(range(k))
        self.lowest, self.n = [r[1] for r in rows], [r[2] for r in rows]
        self.weight = [c * w for c, w in zip(self.n, whole)]
        self.leaves = [int(nxt < d) for nxt, d in zip(self.lcp[1:], self.length)]
        self.added = [0] * k
        self.depth, self.children, self.ends = list(self.length), [0] * k, [r[3] for r in rows]
        self.node = list(range(k))
        self.same_node: list[int] = list(range(k))
        self.segments: list[tuple] = []
        for j in sorted(range(1, k), key=self.lcp.__getitem__, reverse=True):
            self._merge(self._root(j - 1), self._root(j), self.lcp[j], whole[j] - int(self.cum[j][self.lcp[j]]))
        self._lift(self._root(0), -1)

    def _root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def _node(self, i: int) -> int:
        while self.same_node[i] != i:
            self.same_node[i] = i = self.same_node[self.same_node[i]]
        return i

    def _lift(self, x: int, depth: int) -> None:
        """Close the component's nodes below ``depth``; its topmost node is then there."""
        if self.depth[x] == depth:
            return
        above = len(self.same_node)
        self.same_node.append(above)
        self.segments.append((self.node[x], above, self.depth[x], depth + 1, self.children[x], self.ends[x], self.first[x], self.last[x],
                              self.lowest[x], self.n[x], self.weight[x], self.leaves[x], self.added[x]))
        self.depth[x], self.children[x], self.ends[x], self.node[x] = depth, 1, None, above

    def _merge(self, x: int, y: int, depth: int, added: int) -> None:
        """Two neighbour components meet in a node of this depth."""
        self._lift(x, depth)
        self._lift(y, depth)
        self.same_node[self._node(self.node[y])] = self._node(self.node[x])
        children, ends = self.children[x] + self.children[y], self.ends[x] or self.ends[y]
        first, last = self.first[x], self.last[y]
        total = [(s[x] + s[y]) for s in (self.n, self.weight, self.leaves, self.added)]
        low, node = min(self.lowest[x], self.lowest[y]), self.node[x]
        if last - self.first[y] > self.last[x] - first:  # the larger one stays the root
            x, y = y, x
        self.up[y] = x
        self.first[x], self.last[x], self.lowest[x], self.node[x] = first, last, low, node
        self.n[x], self.weight[x], self.leaves[x], self.added[x] = total
        self.added[x] += added
        self.children[x], self.ends[x] = children, ends

    def _open(self, first: int, last: int, depth: int) -> bool:
        return first == 0 and depth <= self.before or last == len(self.paths) - 1 and depth <= self.after

    def _key(self, path: int, depth: int) -> bytes:
        return hashlib.md5(self.paths[path][:TURN * depth]).digest()

    def nodes(self) -> Iterator[tuple]:
        """Rows of _NODES, the topmost nodes last."""
        by_node = {self._node(s[0]): s for s in self.segments}
        for number, above, bottom, top, children, ends, first, last, lowest, n, weight, leaves, added in self.segments:
            cum = self.cum[first]
            whole = int(cum[-1])
            parent = by_node.get(self._node(above))
            for depth in range(bottom, top - 1, -1):
                under = int(cum[max(depth - 1, 0)])
                kids, its_ends = (children, ends) if depth == bottom else (1, None)
                opened = self._open(first, last, depth)
                seen = under
                if first == 0 and depth <= self.before:
                    # The node began in a block before, with its first path's
                    # nodes down to there.
                    seen = int(cum[self.before])
                    kids -= depth < self.before
                saved = weight - n * under - (added + whole - seen)
                holder = (first, last, lowest) if depth > top or parent is None else (parent[6], parent[7], parent[8])
                waits = depth > 0 and self._open(holder[0], holder[1], depth - 1)
                yield (self._key(first, depth) if opened else None, self._key(first, depth - 1) if waits else None, lowest, depth,
                       None if depth == 0 or waits else holder[2], n, kids, leaves, saved, its_ends)


def _forests(lcp_after: dict[int, int], block_paths: int):
    """Nodes of a task's sorted paths; ``lcp_after`` has the LCP of each
    partition's last path with the next partition's first one."""
    before_of = dict(zip(list(lcp_after)[1:], lcp_after.values()))

    def told(forest: Forest) -> Iterator[pa.RecordBatch]:
        out = []
        for row in forest.nodes():
            out.append(row)
            if len(out) == 20_000:
                yield _rows(out, _NODES)
                out = []
        yield _rows(out, _NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, before, part = [], 0, -1, None
        for b in batches:
            for path, c, n, ends, at in zip(*(b[k].to_pylist() for k in ("path", "conv_id", "n", "ends", "part"))):
                if part is None:
                    part, before = at, before_of.get(at, -1)
                if held and (len(held) >= block_paths or size >= BLOCK_BYTES):
                    after = common_turns(held[-1][0], path)
                    yield from told(Forest(held, before, after))
                    held, size, before = [], 0, after
                held.append((path, c, n, ends))
                size += len(path)
        if held:
            yield from told(Forest(held, before, lcp_after.get(part, -1)))
    return run


def _edge_lcp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lcp = [common_turns(x, y) for x, y in zip(b["last"].to_pylist(), b["first"].to_pylist())]
        yield pa.RecordBatch.from_arrays([b["part"], pa.array(lcp, pa.int64())], ["part", "lcp"])


def sorted_paths(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """path, conv_id (smallest), n and ends of every distinct rebuilt
    conversation, in partitions that are sorted and follow one another; the
    frame is checkpointed, so that both hold for every reader."""
    paths = stage_table(rebuilt_turns(conversations, family, most).transform(map_batches, _paths, "path binary, conv_id long"), "paths")
    # Equal paths lie over several tasks where there are very many of them.
    contracted = stage_table(paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
                             .mapInArrow(_contract, _PATHS), "contracted-paths")
    merged = contracted.repartitionByRange("path").sortWithinPartitions("path", "conv_id").mapInArrow(_merge_equal, _SORTED)
    return reliable_checkpoint(merged)


def prefix_trie(conversations: DataFrame, family: int = 5, most: int = 9, block_paths: int = BLOCK_PATHS) -> DataFrame:
    """A row for each distinct sequence of first turns (role, text) of the
    rebuilt conversations, from the root without turns: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256.

    ``conversations`` has conv_id, turn, role and text. Turns are ordered by
    turn, null first, then by the MD5 of role and text; repeated rows are turns
    of their own. Null roles and texts are empty. Rows without conv_id are left
    out. Other columns are ignored; an empty table gives no rows. A path is one
    row: 24 bytes for each turn of a conversation.
    """
    paths = sorted_paths(conversations, family, most).withColumn("part", F.spark_partition_id())
    edges = stage_table(paths.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last")), "path-edges")
    parts = sorted(r["part"] for r in edges.select("part").collect())
    spark = conversations.sparkSession
    lcp_after: dict[int, int] = {}
    if len(parts) > 1:
        follows = spark.createDataFrame(list(zip(parts, parts[1:])), "part int, next int")
        pairs = (edges.select("part", "last").join(follows, "part")
                 .join(edges.select(F.col("part").alias("next"), "first"), "next").select("part", "last", "first"))
        lcp_after = {r["part"]: r["lcp"] for r in pairs.mapInArrow(_edge_lcp, "part int, lcp long").orderBy("part").collect()}
        lcp_after[parts[-1]] = -1
    nodes = stage_table(paths.mapInArrow(_forests(lcp_after, block_paths), _NODES), "trie-nodes")

    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    opened = nodes.where("key IS NOT NULL").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *(F.sum(c).alias(c) for c in sums), F.max("ends_sha256").alias("ends_sha256"))
    opened = stage_table(opened, "open-nodes")
    out = ["conv_id", "depth", "parent_conv_id", *sums, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    closed = nodes.where("key IS NULL")
    waiting = (closed.where("parent_key IS NOT NULL").drop("key", "parent_conv_id")
               .unionByName(opened.where("parent_key IS NOT NULL").drop("key"))
               .withColumn("salt", F.pmod(F.hash("conv_id", "depth"), F.lit(SALTS))))
    parents = opened.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"),
                            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return (closed.where("parent_key IS NULL").select(out)
            .unionAll(opened.where("parent_key IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")).select(out))
            .unionAll(waiting.join(parents, ["parent_key", "salt"]).select(out)))
