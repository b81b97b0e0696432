"""Token counts by overlap resynchronisation.

Documents of up to ``chunk_bytes`` are encoded whole. Longer ones are cut into
overlapping chunks that are encoded as rows of their own, on any executor,
with the offsets of their pre-tokens. Two neighbouring chunks are spliced at a
boundary that both encodings have inside their overlap, at least ``MARGIN``
bytes from the first chunk's end: pre-tokens are found from left to right and
look only a few bytes ahead, so that from a common boundary on the second
chunk's encoding is that of the whole document. Documents with an overlap that
holds no such boundary (one word longer than it, say) go round again with
overlaps and chunks eight times as long, until every splice is proven or one
chunk holds the document.

Pre-tokens are looked up in a bounded cache of the worker before the tokenizer
is asked: ASCII white space splits a text exactly as the tokenizer's own first
step does, unless the text holds other white space or a special token's
string; such texts go to the tokenizer as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootcause.llm.tables import kept, map_batches, stage_table

CHUNK_BYTES = 1 << 16
OVERLAP_BYTES = 1 << 11
MARGIN = 64
CACHE_WORDS = 700_000

_PIECE = re.compile(rb" ?[^\x09-\x0d ]+|[\x09-\x0d ]+(?![^\x09-\x0d ])|[\x09-\x0d ]+")
#: White space of Unicode outside ASCII, and the separators 1C to 1F, as UTF-8.
_ODD = (rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class PieceCounter:
    """Token counts of texts, and of their pieces with offsets."""

    def __init__(self, path: str):
        # Spark runs a worker for each core: no threads inside it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        special = [re.escape(t.content.encode()) for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = re.compile(b"|".join([_ODD, *special]))
        self.cache: dict[bytes, int] = {}

    def _learn(self, pieces: list[bytes]) -> None:
        new = [p for p in set(pieces) if p not in self.cache]
        if not new:
            return
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(set(pieces))
        for p, e in zip(new, self.tok.encode_batch_fast([p.decode("utf-8", "replace") for p in new],
                                                        add_special_tokens=False)):
            self.cache[p] = len(e)

    def count(self, texts: list[bytes]) -> list[int]:
        plain = [None if self.odd.search(t) else _PIECE.findall(t) for t in texts]
        self._learn([p for ps in plain if ps for p in ps])
        get = self.cache.__getitem__
        return [len(self.tok.encode(t.decode("utf-8", "replace"), add_special_tokens=False)) if ps is None
                else sum(map(get, ps)) for t, ps in zip(texts, plain)]

    def pieces(self, text: bytes) -> list[tuple[int | None, int]]:
        """(byte offset, tokens) of every pre-token, from left to right.

        The offset is that of its first byte that is not white space; None for
        pre-tokens of white space alone, which no splice uses.
        """
        if not self.odd.search(text):
            found = [(m.start(), m.group()) for m in _PIECE.finditer(text)]
            self._learn([p for _, p in found])
            return [(at + (p[0] == 0x20) if p.strip() else None, self.cache[p]) for at, p in found]
        string = text.decode("utf-8", "replace")
        enc = self.tok.encode(string, add_special_tokens=False)
        out, prev, at_char, at_byte = [], object(), 0, 0
        for (start, end), word in zip(enc.offsets, enc.word_ids):
            if word is None or word != prev:
                blank = start >= end or string[start].isspace()
                if not blank:
                    at_byte += len(string[at_char:start].encode())
                    at_char = start
                out.append([None if blank else at_byte, 0])
            out[-1][1] += 1
            prev = word if word is not None else object()
        return [tuple(x) for x in out]


def counter(path: str) -> PieceCounter:
    return kept(f"pieces of {path}", lambda: PieceCounter(path))


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part["text"].cast(pa.large_binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([len(t) for t in texts], pa.int64()),
                     pa.array(c.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
    return run


#: Of a chunk: its tokens, and the boundaries in the overlaps with the chunk
#: before and after it, each as (byte in the document, tokens before it).
_CHUNK = "row long, chunk int, n_bytes long, tokens long, head array<array<long>>, tail array<array<long>>"


def _encode_chunks(path: str, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        pairs = pa.list_(pa.list_(pa.int64()))
        for b in batches:
            for r in range(b.num_rows):
                row = {k: b[k][r].as_py() for k in ("row", "chunk", "base", "n_bytes", "piece")}
                text, base = row["piece"], row["base"]
                # A chunk may begin or end inside a character: those bytes are
                # within the margin that no splice uses.
                skip = next((i for i in range(min(4, len(text))) if text[i] & 0xC0 != 0x80), 0) if base else 0
                found, total, bounds = c.pieces(text[skip:]), 0, []
                for at, n in found:
                    if at is not None:
                        bounds.append((base + skip + at, total))
                    total += n
                end = base + len(text)
                head = [x for x in bounds if base and x[0] < base + overlap]
                tail = [x for x in bounds if end < row["n_bytes"] and end - overlap <= x[0] <= end - MARGIN]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["row"]], pa.int64()), pa.array([row["chunk"]], pa.int32()),
                     pa.array([row["n_bytes"]], pa.int64()), pa.array([total], pa.int64()),
                     pa.array([head], pairs), pa.array([tail], pairs)],
                    ["row", "chunk", "n_bytes", "tokens", "head", "tail"])
    return run


def _splice(chunks):
    """One document's chunks to its count; null where a splice is unproven."""
    import pandas as pd
    chunks = chunks.sort_values("chunk")
    total, begin = 0, 0
    for k in range(len(chunks)):
        row = chunks.iloc[k]
        until = int(row["tokens"])
        if k + 1 < len(chunks):
            nxt = {int(p): int(t) for p, t in chunks.iloc[k + 1]["head"]}
            # A boundary at the very start of the next chunk proves nothing:
            # the chunk begins there whatever the text.
            first = min(nxt, default=0)
            common = [(int(p), int(t)) for p, t in row["tail"] if int(p) in nxt and int(p) > first and int(t) >= begin]
            if not common:
                total = None
                break
            p, until = common[len(common) // 2]
            total += until - begin
            begin = nxt[p]
        else:
            total += until - begin
    return pd.DataFrame({"row": [chunks["row"].iloc[0]], "n_bytes": [chunks["n_bytes"].iloc[0]],
                         "n_tokens": pd.array([total], dtype="Int64")})


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, chunk_bytes: int = CHUNK_BYTES,
                 overlap_bytes: int = OVERLAP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens). Rows that repeat a doc_id,
    or have none, are counted each on its own. Other columns are ignored; an
    empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text")
    out = docs.where(size <= chunk_bytes).transform(map_batches, _whole(tokenizer_path), "doc_id long, n_bytes long, n_tokens long",
                              f"pieces of {tokenizer_path}")
    # Chunks are told apart by their row: written once, its number stays.
    left = stage_table(docs.where(size > chunk_bytes).withColumn("row", F.monotonically_increasing_id()), "long-documents")
    ids = left.select("row", "doc_id")
    chunk, overlap = chunk_bytes, overlap_bytes
    while True:
        step = chunk - overlap
        n_chunks = F.greatest(F.lit(1), F.ceil((F.col("n_bytes") - overlap) / F.lit(step))).cast("int")
        rows = (left.withColumn("n_bytes", F.octet_length("text").cast("long"))
                .select("row", "n_bytes", F.col("text").cast("binary").alias("text"),
                        F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("chunk"))
                .select("row", "n_bytes", "chunk", (F.col("chunk").cast("long") * step).alias("base"),
                        F.substring("text", F.col("chunk") * step + 1, F.lit(chunk)).alias("piece")))
        counted = (rows.repartition("row", "chunk").transform(map_batches, _encode_chunks(tokenizer_path, overlap), _CHUNK, f"pieces of {tokenizer_path}")
                   .groupBy("row").applyInPandas(_splice, "row long, n_bytes long, n_tokens long"))
        counted = stage_table(counted, "token-splices")
        out = out.union(counted.where("n_tokens IS NOT NULL").join(ids, "row").select("doc_id", "n_bytes", "n_tokens"))
        failed = counted.where("n_tokens IS NULL").select("row")
        if failed.isEmpty():
            return out.withColumn("over_limit", F.col("n_tokens") > limit)
        left = left.join(failed, "row", "left_semi")
        chunk, overlap = chunk * 8, overlap * 8
