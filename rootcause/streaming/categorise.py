"""Structured Streaming form of the labelling step (ops H1, H2).

H1 labels reviews as files land and appends them to a sink, exactly once per
file thanks to the checkpoint; with ``dedupe_within`` a review that lands again
(in another file) is labelled once. H2 keeps a running count per category, over
all reviews or by windows of event time, and publishes it as a versioned table:
a reader finds the version before or after a micro-batch, never none. All run with
``availableNow`` so a backlog drains and the query stops; on a cluster the same
code runs with a processing-time trigger. ``max_files`` caps the files per
micro-batch (unset: Spark takes what is available).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootcause.operators.classify import label_column
from rootcause.schemas import CATEGORY_COL
from rootcause.sources.versioned import publish, read_current, versions

#: What makes two landed rows the same review.
REVIEW_IDENTITY = ("userName", "at", "content")
DISTRIBUTION_SCHEMA = "Category string, Count long"
WINDOW_SCHEMA = "window_start timestamp_ntz, window_end timestamp_ntz, Category string, Count long, late_count long, max_at timestamp_ntz"


def _source(spark: SparkSession, src: str, schema: T.StructType, fmt: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(src)


def once_within(reviews: DataFrame, delay: str, identity=REVIEW_IDENTITY, at: str = "at") -> DataFrame:
    """A stream of reviews without those that landed before.

    The state is one digest a review and is dropped once the watermark (the
    largest event time less ``delay``) has passed it, so it is bounded by the
    reviews of that span. A review that lands later than that cannot be told
    from a new one and is left out; ``late_rows`` counts those. Nulls are equal
    to nulls.
    """
    parts = [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("null")) for c in identity]
    keyed = reviews.withColumn("_review", F.sha2(F.concat(*parts), 256)).withColumn("_event_time", F.col(at).cast("timestamp"))
    return (keyed.withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(["_review"])
            .drop("_review", "_event_time"))


def late_rows(query) -> int:
    """Rows that a query's state left out because they came after the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def stream_categorise(spark: SparkSession, src: str, sink: str, checkpoint: str, schema: T.StructType,
                      rules=None, fmt: str = "parquet", max_files: int | None = None,
                      text_col: str = "content", dedupe_within: str | None = None):
    """Label each landed review and append it to ``sink`` (op H1). Returns the
    started query; call ``awaitTermination()`` (availableNow stops by itself).

    ``rules`` is a rule list; without one the scope classifier labels. With
    ``dedupe_within`` (a span such as "7 days") a review that landed before is
    not labelled again (see ``once_within``).
    """
    reviews = _source(spark, src, schema, fmt, max_files)
    if dedupe_within:
        reviews = once_within(reviews, dedupe_within)
    labelled = reviews.withColumn(CATEGORY_COL, label_column(text_col, rules))
    return (labelled.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).option("path", sink)
            .trigger(availableNow=True).start())


def stream_distribution(spark: SparkSession, src: str, checkpoint: str, schema: T.StructType,
                        out_path: str, rules=None, fmt: str = "parquet", max_files: int | None = None,
                        text_col: str = "content"):
    """Running count per category over the landed reviews (op H2).

    Complete mode: after each micro-batch the whole (small: one row per
    category) result is published as the next version of the table at
    ``out_path`` (read it with ``current_distribution``). The version is the
    batch's number, so that a replayed batch after a failure publishes nothing
    twice; the counts themselves live in the checkpointed state store.
    """
    labelled = _source(spark, src, schema, fmt, max_files).withColumn(
        CATEGORY_COL, label_column(text_col, rules))
    counts = (labelled.where(F.col(CATEGORY_COL).isNotNull()).groupBy(CATEGORY_COL)
              .agg(F.count(F.lit(1)).alias("Count")).withColumnRenamed(CATEGORY_COL, "Category"))

    def publish_batch(batch: DataFrame, epoch: int) -> None:
        publish(batch, out_path, epoch)

    return (counts.writeStream.outputMode("complete").foreachBatch(publish_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_distribution(spark: SparkSession, out_path: str) -> DataFrame:
    """The published distribution; empty before the first batch."""
    return read_current(spark, out_path, DISTRIBUTION_SCHEMA)


def window_counts(labelled: DataFrame, width: str, at: str = "at") -> DataFrame:
    """Reviews per window of event time and category. Rows without event time
    are in the window null; null labels are in none."""
    span = F.window(F.col(at).cast("timestamp"), width)
    known = labelled.where(F.col(CATEGORY_COL).isNotNull())
    return (known.withColumn("w", F.when(F.col(at).isNotNull(), span))
            .groupBy(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                     F.col(CATEGORY_COL).alias("Category"))
            .agg(F.count(F.lit(1)).alias("Count"), F.max(F.col(at).cast("timestamp_ntz")).alias("max_at")))


def merge_windows(before: DataFrame, counts: DataFrame, delay: str) -> DataFrame:
    """The published windows with a batch's counts added.

    Rows of a window that ended before the watermark of the batches so far (the
    largest event time less ``delay``) are late: they are counted, and counted
    apart in late_count.
    """
    watermark = before.agg((F.max("max_at") - F.expr(f"INTERVAL '{delay}'")).alias("watermark"))
    late = F.when(F.col("window_end") <= F.col("watermark"), F.col("Count")).otherwise(F.lit(0).cast("long"))
    new = counts.join(F.broadcast(watermark)).withColumn("late_count", late).drop("watermark")
    return (before.unionByName(new).groupBy("window_start", "window_end", "Category")
            .agg(F.sum("Count").alias("Count"), F.sum("late_count").alias("late_count"), F.max("max_at").alias("max_at")))


def stream_windows(spark: SparkSession, src: str, checkpoint: str, schema: T.StructType, out_path: str,
                   width: str = "1 hour", delay: str = "1 day", rules=None, fmt: str = "parquet", max_files: int | None = None,
                   text_col: str = "content"):
    """Counts per window of event time and category (op H2 by event time).

    Each micro-batch is counted and added to the table published so far, and
    the sum appears as the version of the batch's number. A batch that is
    replayed finds its version there and adds nothing. Late reviews are never
    lost, whatever their delay: late_count tells how many came after the
    watermark had passed their window, so that a reader knows which windows
    changed after they counted as finished. The only state is the table: a row
    a window and category. Read it with ``current_windows``.
    """
    labelled = _source(spark, src, schema, fmt, max_files).withColumn(CATEGORY_COL, label_column(text_col, rules))

    def publish_batch(batch: DataFrame, epoch: int) -> None:
        if epoch not in versions(spark, out_path):
            before = read_current(batch.sparkSession, out_path, WINDOW_SCHEMA)
            publish(merge_windows(before, window_counts(batch, width), delay), out_path, epoch)

    return (labelled.writeStream.outputMode("append").foreachBatch(publish_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_windows(spark: SparkSession, out_path: str, delay: str = "1 day") -> DataFrame:
    """The published windows, with ``final`` for those that the watermark has passed."""
    rows = read_current(spark, out_path, WINDOW_SCHEMA)
    watermark = rows.agg((F.max("max_at") - F.expr(f"INTERVAL '{delay}'")).alias("watermark"))
    return (rows.join(F.broadcast(watermark)).withColumn("final", F.coalesce(F.col("window_end") <= F.col("watermark"), F.lit(False)))
            .drop("watermark", "max_at"))
