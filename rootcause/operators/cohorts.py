"""Cohort construction: exact splits and samples, weighted assignment, dense
ids and ticket generation (ops G1-G4, G10, G11).

Random draws are replaced by ``uniform(key, salt)`` so results do not depend
on partitioning or retries. Exact-k selection never funnels the candidates of
all partitions through one task: small k is merged in two levels, large k uses a
histogram threshold.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootcause.functions.uniform import uniform
from rootcause.session import reliable_checkpoint

# Up to this k the first k rows are merged in two levels (groups of partitions,
# then the groups); beyond it, the histogram threshold below.
TOPK_ROWS = 10_000
MERGE_GROUPS = 256
HIST_BINS = 1 << 20
# Rows that a bin of scores holds on average when draws are looked up in it.
RANK_ROWS = 64


def _smallest_k_flag(df: DataFrame, score: str, key: str, k: int, flag: str) -> DataFrame:
    """Mark the k rows with the smallest (score, key); score is in [0, 1) and
    ``key`` is unique.

    Small k: a bounded top-k in two levels, so that no task receives the
    candidates of all partitions. Otherwise: count rows per score bin (at most
    HIST_BINS groups, partial aggregation before the shuffle), find the
    boundary bin on that small table, then rank only the rows of the boundary
    bin. Bins are uniform in the score, so the boundary bin holds about
    n / HIST_BINS rows.
    """
    if k <= 0:
        return df.withColumn(flag, F.lit(False))
    if k <= TOPK_ROWS:
        of_group = Window.partitionBy("_group").orderBy(score, key)
        top = (df.select(key, score).withColumn("_group", F.spark_partition_id() % MERGE_GROUPS)
               .withColumn("_r", F.row_number().over(of_group)).where(F.col("_r") <= k)
               .orderBy(score, key).limit(k).select(key, F.lit(True).alias(flag)))
        return df.join(top, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))

    binned = df.withColumn("_bin", F.floor(F.col(score) * HIST_BINS).cast("long"))
    hist = binned.groupBy("_bin").agg(F.count("*").alias("_n"))
    # One ordered pass over at most HIST_BINS rows.
    w = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("_cum", F.sum("_n").over(w))
    boundary = cum.where(F.col("_cum") >= k).orderBy("_bin").limit(1).collect()
    if not boundary:
        return df.withColumn(flag, F.lit(True))
    b, n_b, cum_b = boundary[0]["_bin"], boundary[0]["_n"], boundary[0]["_cum"]
    need = k - (cum_b - n_b)
    edge = (binned.where(F.col("_bin") == b)
            .withColumn("_r", F.row_number().over(Window.partitionBy("_bin").orderBy(score, key)))
            .where(F.col("_r") <= need).select(key, F.lit(True).alias("_edge")))
    out = binned.join(edge, key, "left")
    return out.withColumn(flag, (F.col("_bin") < b) | F.coalesce(F.col("_edge"), F.lit(False))) \
              .drop("_bin", "_edge")


def split_flag(df: DataFrame, key: str, k: int, salt: str, flag: str) -> DataFrame:
    """``df`` with a column that marks the first k rows of the shuffle by
    ``uniform(key, salt)``: the split of op G1 in one pass."""
    return _smallest_k_flag(df.withColumn("_u", uniform(key, salt)), "_u", key, k, flag).drop("_u")


def split_exact(df: DataFrame, key: str, k: int, salt: str) -> tuple[DataFrame, DataFrame]:
    """Shuffle by ``uniform(key, salt)``; the first k rows vs the rest (op G1).

    The two parts are disjoint and together are the input.
    """
    flagged = split_flag(df, key, k, salt, "_first")
    first = flagged.where("_first").drop("_first")
    rest = flagged.where(~F.col("_first")).drop("_first")
    return first, rest


def sample_exact(df: DataFrame, key: str, k: int, salt: str) -> DataFrame:
    """k rows without replacement (op G2); different salts give independent,
    possibly overlapping samples."""
    return split_exact(df, key, k, salt)[0]


def weighted_bucket(u, labels: list[str], weights: list[float]):
    """Weighted categorical assignment from a uniform draw (op G3).

    Cumulative weights partition [0, 1); the last label takes the remainder.
    """
    u = F.col(u) if isinstance(u, str) else u
    cuts = list(accumulate(weights))
    out = F.lit(labels[-1])
    for label, c in reversed(list(zip(labels[:-1], cuts[:-1]))):
        out = F.when(u < F.lit(c), F.lit(label)).otherwise(out)
    return out


def surrogate_ids(df: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """Dense ids 1..n following ``order`` (op G10).

    A global sort (range partitioned, no single-task window), then each row's
    position inside its partition plus the row count of the earlier
    partitions. The sorted rows are checkpointed first so both uses see the
    same partitioning; the offset table has one row per partition.
    """
    sorted_df = reliable_checkpoint(
        df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_mid"), 33)
    counts = sorted_df.groupBy(pid.alias("_pid")).agg(F.count("*").alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (sorted_df.join(F.broadcast(offsets.select("_pid", "_off")), pid == F.col("_pid"))
            .withColumn(id_col, (F.col("_off") + local + 1).cast("long"))
            .drop("_mid", "_pid", "_off"))


def _score_bins(n: int) -> int:
    """Bins of about RANK_ROWS rows each, at most HIST_BINS."""
    return max(1, min(HIST_BINS, n // RANK_ROWS))


def sample_with_replacement(df: DataFrame, key: str, k: int, salt: str) -> DataFrame:
    """k draws with repeats (op G4): draw i picks the row at dense index
    floor(uniform(i, salt) * n) of the order by (uniform(key, salt), key).
    Returns (draw_id, <columns of df>); ``key`` is unique and not null.

    The table is not sorted. Its scores are counted by bins in one narrow pass;
    the running count of at most HIST_BINS bins turns each draw into a bin and
    a place in it. Then only rows of bins that were drawn from are shuffled, by
    bin, to be ranked there: for few draws that is a small part of the table,
    which a second scan picks out.
    """
    spark = df.sparkSession
    scored = df.withColumn("_u", uniform(key, salt))
    n = df.count() if k > 0 else 0
    if n == 0:
        return df.limit(0).select(F.lit(0).cast("long").alias("draw_id"), *df.columns)
    bins = _score_bins(n)
    bin_of = F.floor(F.col("_u") * bins).cast("long")
    counts = scored.groupBy(bin_of.alias("_bin")).count().toArrow()  # at most HIST_BINS rows
    held = np.zeros(bins, np.int64)
    held[counts["_bin"].to_numpy()] = counts["count"].to_numpy()
    ends_of = spark.sparkContext.broadcast(np.cumsum(held))

    def place(batches):
        for b in batches:
            at = b["_at"].to_numpy()
            hit = np.searchsorted(ends_of.value, at, "right")
            before = np.where(hit > 0, ends_of.value[hit - 1], 0)
            yield pa.RecordBatch.from_arrays([b["draw_id"], pa.array(hit), pa.array(at - before)], ["draw_id", "_bin", "_place"])

    draws = (spark.range(k).select(F.col("id").alias("draw_id"), F.floor(uniform("id", salt) * F.lit(n)).cast("long").alias("_at"))
             .mapInArrow(place, "draw_id long, _bin long, _place long"))
    binned = scored.withColumn("_bin", bin_of)
    if k * 4 < bins:
        # Few draws: rows of other bins are left out where they are read.
        binned = binned.join(F.broadcast(draws.select("_bin").distinct()), "_bin", "left_semi")
    ranked = binned.withColumn("_place", (F.row_number().over(Window.partitionBy("_bin").orderBy("_u", key)) - 1).cast("long"))
    return draws.join(ranked, ["_bin", "_place"]).select("draw_id", *df.columns)


def cohort_tickets(users: DataFrame, cohorts, stride: int) -> DataFrame:
    """One support ticket per (user, theme) whose cohort predicate holds (op G11).

    ``cohorts`` is a list of (theme, predicate SQL, base interaction count).
    A single scan of ``users`` emits every matching theme of a user (a
    generator over a short array), instead of a union of one scan per theme.
    """
    themes = F.array(*[F.lit(t) for t, _, _ in cohorts])
    bases = F.array(*[F.lit(b) for _, _, b in cohorts])
    hits = F.array(*[F.when(F.expr(p), F.lit(i)) for i, (_, p, _) in enumerate(cohorts)])
    t = users.select("user_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("_ti"))
    uid = F.col("user_id")
    return t.select(
        (F.col("_ti").cast("long") * F.lit(stride) + uid).alias("ticket_id"),
        uid,
        F.element_at(themes, F.col("_ti") + 1).alias("complaint_theme"),
        (F.lit(0.5) + (uid * 13 % 480) / F.lit(20.0)).alias("ticket_resolution_time_hours"),
        (F.element_at(bases, F.col("_ti") + 1) + uid % 3).cast("int").alias("support_interaction_count"),
    )
