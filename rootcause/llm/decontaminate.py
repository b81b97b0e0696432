"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all benchmark items is broadcast in shards of bounded size
(a document table never is). Training words are streamed through it: the state
gives the longest suffix read so far that occurs in some item. Where it is as
long as a window (n consecutive item words), the window's words are hit; an
item shorter than a window counts as one window of its own length.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rootcause.llm.tables import kept, map_batches, stage_table, with_ids

WINDOW = 10
SHARD_BYTES = 2 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class ItemAutomaton:
    """Generalised suffix automaton over the words of items."""

    def __init__(self, items: list[tuple[int, bytes]], n: int):
        self.n = n
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        split = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in _WORD.findall(text.lower())]
            if ids:
                split.append((item_id, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self._windows(split)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # an earlier item had this continuation
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, c)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.len.append(self.len[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _windows(self, items: list[tuple[int, list[int]]]) -> None:
        """The state that holds each state's last n words, which items have
        that window, and the short items that end in each state."""
        n, size = self.n, len(self.next)
        order = sorted(range(1, size), key=self.len.__getitem__)
        self.window = [0] * size
        for v in order:
            if self.len[v] >= n:
                up = self.link[v]
                self.window[v] = v if self.len[up] < n else self.window[up]
        self.items_of: dict[int, set[int]] = {}
        self.short_at: dict[int, dict[int, set[int]]] = {}
        for item_id, ids in items:
            v = 0
            for i, c in enumerate(ids):
                v = self.next[v][c]
                if i + 1 >= n:
                    self.items_of.setdefault(self.window[v], set()).add(item_id)
            if len(ids) < n:
                self.short_at.setdefault(v, {}).setdefault(len(ids), set()).add(item_id)
        self.short_link = [0] * size
        for v in order:
            self.short_link[v] = v if v in self.short_at else self.short_link[self.link[v]]

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int], int]:
        """(merged hit spans [first word, past last], items, longest match)."""
        nxt, link, length, window, n = self.next, self.link, self.len, self.window, self.n
        short = self.short_link if self.short_at else None
        spans: list[list[int]] = []
        states: set[int] = set()
        items: set[int] = set()
        v = size = longest = 0

        def hit(start: int, end: int) -> None:
            while spans and start <= spans[-1][1]:
                start = min(start, spans.pop()[0])
            spans.append([start, end])

        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                v = size = 0
                continue
            to = nxt[v].get(c)
            while to is None:  # the root has a transition for every known word
                v = link[v]
                size = length[v]
                to = nxt[v].get(c)
            v, size = to, size + 1
            if size > longest:
                longest = size
            if size >= n:
                states.add(window[v])
                hit(i + 1 - n, i + 1)
            if short is not None:
                u = short[v]
                while u:
                    for m, ids in self.short_at[u].items():
                        if m <= size:
                            items |= ids
                            hit(i + 1 - m, i + 1)
                    u = short[link[u]]
        for s in states:
            items |= self.items_of[s]
        return spans, items, longest


def _automaton(shard) -> ItemAutomaton:
    return kept(shard.id, lambda: ItemAutomaton(*shard.value))


class _Shard:
    """A broadcast variable with its id, by which a worker keeps the automaton."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


_MATCHES = ("doc_id long, text_md5 string, n_words long, spans array<array<long>>, items array<long>, longest int")


def _match(shard: _Shard):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _automaton(shard)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.large_binary()).to_pylist()):
                    words = _WORD.findall((text or b"").lower())
                    spans, items, longest = found.scan(words)
                    rows.append((doc_id, hashlib.md5(text or b"").hexdigest(), len(words), spans, sorted(items), longest))
                types = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                 ["doc_id", "text_md5", "n_words", "spans", "items", "longest"])
    return run


def _shards(items: DataFrame, n: int, shard_bytes: int) -> list[_Shard]:
    """The items in broadcasts of about ``shard_bytes`` of text, or one item, each."""
    spark = items.sparkSession
    items = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    count = max(1, -(-total // shard_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    out = []
    for s in range(count):
        rows = items.where(part == s).select("item_id", F.col("text").cast("binary").alias("text")).collect()
        out.append(_Shard(spark.sparkContext.broadcast(
            (sorted({(r["item_id"], bytes(r["text"])) for r in rows}), n))))
    return out


def match_items(docs: DataFrame, items: DataFrame, n: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, text_md5, n_words, spans, items and longest of every row of ``docs``.

    ``spans`` are the merged runs of hit words as [first, past last], ``items``
    the sorted ids of items with an occurring window, ``longest`` the longest
    match in words. A null or empty text has no words; items without id, text
    or words match nothing. Rows that repeat a doc_id are matched each on its
    own; other columns are ignored. The documents are streamed once for each
    shard of the items; the parts of a row are then joined by doc_id and text
    digest.
    """
    docs = docs.select("doc_id", "text")
    shards = _shards(items, n, shard_bytes)
    parts = [docs.transform(map_batches, _match(s), _MATCHES, s.id) for s in shards]
    if len(parts) == 1:
        return parts[0]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    merged = (whole.groupBy("doc_id", "text_md5")
              .agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                   F.max("longest").alias("longest"), (F.count("*") / len(parts)).cast("int").alias("rows"))
              .withColumn("spans", merge_spans("spans")))
    return merged.select("doc_id", "text_md5", "n_words", "spans", "items", "longest",
                         F.explode(F.sequence(F.lit(1), "rows")).alias("row")).drop("row")


def merge_spans(col: str):
    """Sorted, joined spans of an array of [first, past last]."""
    return F.aggregate(
        F.array_sort(col), F.array().cast("array<array<bigint>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(F.element_at(acc, -1), 2) >= s[0]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(
                                  F.element_at(F.element_at(acc, -1), 1),
                                  F.greatest(F.element_at(F.element_at(acc, -1), 2), s[1])))))
        .otherwise(F.concat(acc, F.array(s))))


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])


def _clean(shards: list[_Shard], schema_names: list[str], max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                keep, texts = [], []
                for text in part["text"].cast(pa.large_binary()).to_pylist():
                    cleaned, ok = clean_text(text, [_automaton(s) for s in shards], max_coverage)
                    keep.append(ok)
                    texts.append(cleaned)
                cols = [pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(part.schema.field("text").type)
                        if c == "text" else part[c] for c in schema_names]
                yield pa.RecordBatch.from_arrays(cols, schema_names).filter(pa.array(keep))
    return run


def clean_text(text: bytes | None, automata: list[ItemAutomaton], max_coverage: float) -> tuple[bytes | None, bool]:
    """The text without hit spans, and whether the document is kept.

    A cut can bring words together that match anew; they are cut as well.
    """
    first = True
    while text:
        found = list(_WORD.finditer(text.lower()))
        words = [m.group() for m in found]
        spans = sorted(s for a in automata for s in a.scan(words)[0])
        if not spans:
            break
        hit = set()
        for s, e in spans:
            hit.update(range(s, e))
        if first and len(hit) > max_coverage * len(words):
            return text, False
        first = False
        text = _cut(text, found, spans)
    return text, True


def _cut(text: bytes, found: list[re.Match], spans: list) -> bytes:
    """The text without its words from first to past last of each sorted span."""
    out, at = [], 0
    for s, e in spans:
        start, end = found[s].start(), found[e - 1].end()
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW, max_coverage: float = 0.5,
                  shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without the text of hit spans, and without documents of which
    more than ``max_coverage`` of the words are hit. Columns stay as they are.

    With several shards of the items, the spans of all are merged by row before
    the share of hit words is judged and anything is cut; rows that were cut go
    through all shards again until none is hit. The result is that of one shard.
    """
    shards = _shards(items, n, shard_bytes)
    if len(shards) == 1:
        return docs.transform(map_batches, _clean(shards, docs.columns, max_coverage), docs.schema, shards[0].id)
    columns, schema = docs.columns, docs.schema
    row = "row_" + uuid.uuid4().hex
    left = stage_table(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    out, first = None, True
    while True:
        found = None
        for s in shards:
            part = left.select(F.col(row).alias("doc_id"), "text").transform(map_batches, _match(s), _MATCHES, s.id).where(F.size("spans") > 0)
            found = part if found is None else found.union(part)
        found = stage_table(found.groupBy(F.col("doc_id").alias(row))
                            .agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"))
                            .withColumn("spans", merge_spans("spans")), "spans")
        clean = with_ids(left, found, "left_anti", row).select(columns)
        out = clean if out is None else out.union(clean)
        if first:
            found, first = found.where(n_hit() <= max_coverage * F.col("n_words")), False
        if found.isEmpty():
            return out
        hit = with_ids(left, found, "left_semi", row).join(found.select(row, "spans"), row)
        left = stage_table(hit.transform(map_batches, _cut_rows([*columns, row]),
                                         StructType([*schema.fields, StructField(row, LongType())])), "decontaminate")


def _cut_rows(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, spans in zip(b["text"].cast(pa.large_binary()).to_pylist(), b["spans"].to_pylist()):
                texts.append(_cut(text, list(_WORD.finditer(text.lower())), spans))
            cut = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(b.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([cut if c == "text" else b[c] for c in names], names)
    return run


def contamination_report(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """The digest of :func:`match_items` by document."""
    m = match_items(docs, items, n)
    hits = n_hit()
    return m.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>"))), 256).alias("items_sha256"),
                    (hits > 0).alias("contaminated"), "longest")
