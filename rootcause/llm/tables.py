"""Intermediate tables and connected components shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootcause.session import give_back, scratch_dir, small_batches


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema,
                keeps: str | None = None) -> DataFrame:
    """``df.mapInArrow(fn, schema)`` in small batches, with what the worker no
    longer needs given back at the end of a partition: workers live on.

    ``keeps`` names the object that ``fn`` holds by :func:`kept`; objects of
    other names are dropped before ``fn`` starts.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(keeps)
        try:
            yield from fn(batches)
        finally:
            give_back()
    return df.mapInArrow(run, schema)


_KEPT: dict[str, Any] = {}


def kept(name: str, build: Callable[[], Any]) -> Any:
    """``build()``, made once in a worker and held while its partitions are of
    functions that keep ``name``: a model, an automaton or a tokenizer."""
    if name not in _KEPT:
        drop_kept(None)
        _KEPT[name] = build()
    return _KEPT[name]


def drop_kept(but: str | None) -> None:
    others = [name for name in _KEPT if name != but]
    for name in others:
        del _KEPT[name]
    if others:
        give_back()


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    The lineage ends there: a lost executor costs the tasks it was running,
    not the work that led to the table.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Ids that may be broadcast to keep a join from shuffling texts: 8 bytes each.
BROADCAST_IDS = 2_000_000


def with_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi", key: str = "doc_id",
             at_most: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` with (or, by left_anti, without) the keys in ``ids``.

    The ids are counted: up to ``at_most`` are broadcast, more are joined by a
    shuffle. The rows are the same.
    """
    ids = ids.select(key).where(f"{key} IS NOT NULL").distinct()
    small = ids.count() <= at_most
    return docs.join(F.broadcast(ids) if small else ids, key, how)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node that has an edge.

    ``edges`` has long columns a and b. Alternating large-star and small-star
    steps: each replaces an edge by one to the smallest neighbour known, found
    by a partially aggregated min, so that a node with very many neighbours is
    reduced before the shuffle. Ends when a round changes nothing; the number
    of rounds grows with the logarithm of the longest chain.
    """
    edges = stage_table(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct(), name)
    before = _digest(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a != b").distinct())
        large = stage_table(large, name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stage_table(small.select("e.a", "e.b").where("a != b").distinct(), name)
        after = _digest(edges)
        if after == before:
            break
        before = after
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(edges.select("b", "b").distinct()))


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]
