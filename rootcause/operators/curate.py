"""Review curation: projection, length filter, previews, head/tail, per-score
batches and the stratified head (ops B1-B5, B8, C1, C2).

Row order is explicit: every head/tail takes the arrival sequence column, which
is unique.

Selection runs on the narrow (stratum, sequence) columns, in two levels: the
first k of each group of partitions, then the first k of those. No task merges
the candidates of all partitions, and no review text is moved to be ranked. The
chosen rows are then fetched by a semi join on their sequence numbers, which is
broadcast while the requested counts are small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootcause.functions.text import preview as _preview

REVIEW_COLS = ["userName", "score", "at", "content"]

# Per-rating fetch sizes and the stratified sample quotas.
FETCH_CAPS = {1: 1000, 2: 500, 3: 200}
QUOTAS = {1: 300, 2: 150, 3: 50}
MIN_CONTENT_CHARS = 50


def project_reviews(df: DataFrame, keep=("seq",)) -> DataFrame:
    """Keep the four review columns (op B1), plus ordering columns in ``keep``."""
    return df.select(*[c for c in keep if c in df.columns], *REVIEW_COLS)


def drop_short(df: DataFrame, col: str = "content", min_len: int = MIN_CONTENT_CHARS) -> DataFrame:
    """Keep texts strictly longer than ``min_len`` characters; null drops (op B2)."""
    return df.where(F.length(col) > min_len)


def with_preview(df: DataFrame, col: str = "content", n: int = 75, out: str = "preview") -> DataFrame:
    """Add the short preview of a text (op B3)."""
    return df.withColumn(out, _preview(col, n))


# Groups that partitions are dealt into for the first level of a ranking, and
# the number of keys up to which a fetch is broadcast.
MERGE_GROUPS = 256
BROADCAST_KEYS = 1_000_000


def _fetch(df: DataFrame, keys: DataFrame, seq: str, at_most: int) -> DataFrame:
    """Rows of ``df`` whose ``seq`` is among ``keys``, of which there are
    ``at_most``: matched map-side when that is few, so the wide columns stay
    in place."""
    keys = keys.select(seq)
    return df.join(F.broadcast(keys) if at_most <= BROADCAST_KEYS else keys, seq, "left_semi")


def _ranked(df: DataFrame, by: list[str], seq: str, cap: int, descending: bool = False) -> DataFrame:
    """The first ``cap`` rows of each stratum with their rank _rn. The literal
    bound lets Spark keep at most ``cap`` rows per stratum and task before
    either exchange."""
    order = f"`{seq}` {'DESC' if descending else 'ASC'}"
    strata = ", ".join(f"`{c}`" for c in by)
    first = (df.where(F.col(seq).isNotNull()).withColumn("_group", F.spark_partition_id() % MERGE_GROUPS)
             .selectExpr("*", f"row_number() OVER (PARTITION BY {', '.join([*([strata] if by else []), '_group'])} "
                              f"ORDER BY {order}) AS _rg")
             .where(f"_rg <= {cap}").drop("_rg", "_group"))
    return (first.selectExpr("*", f"row_number() OVER ({f'PARTITION BY {strata} ' if by else ''}ORDER BY {order}) AS _rn")
            .where(f"_rn <= {cap}"))


def _end_n(df: DataFrame, n: int, seq: str, descending: bool) -> DataFrame:
    keys = _ranked(df.select(seq), [], seq, n, descending)
    order = F.col(seq).desc() if descending else F.col(seq).asc()
    # A repeated sequence number fetches all its rows: the limit holds again.
    return _fetch(df, keys, seq, n).orderBy(order, *[c for c in df.columns if c != seq]).limit(n)


def head_n(df: DataFrame, n: int = 10, seq: str = "seq") -> DataFrame:
    """First n rows of the arrival order (op B4); rows without a sequence number have no place in it."""
    return _end_n(df, n, seq, descending=False)


def tail_n(df: DataFrame, n: int = 6, seq: str = "seq") -> DataFrame:
    """Last n rows of the arrival order (op B5); rows without a sequence number have no place in it."""
    return _end_n(df, n, seq, descending=True)


def score_filter(df: DataFrame, score: int, cap: int | None = None, seq: str = "seq") -> DataFrame:
    """Reviews with one star rating, at most ``cap`` of them in arrival order (op B8)."""
    out = df.where(F.col("score") == score)
    if cap is None:
        return out
    return _fetch(out, _ranked(out.select(seq), [], seq, cap), seq, cap)


def union_batches(dfs: list[DataFrame]) -> DataFrame:
    """Append batches, duplicates kept (op C1)."""
    return reduce(DataFrame.unionByName, dfs)


def union_score_batches(df: DataFrame, caps: dict[int, int] = FETCH_CAPS, seq: str = "seq") -> DataFrame:
    """The per-rating batches, each capped in arrival order, appended (B8 + C1).

    One two-level top-k per rating over the narrow keys; the batches (disjoint:
    one rating each) are appended as key sets and the reviews fetched once.
    """
    keys = union_batches([_ranked(df.where(F.col("score") == s).select(seq), [], seq, c) for s, c in caps.items()])
    return _fetch(df, keys, seq, sum(caps.values()))


def score_batches(df: DataFrame, caps: dict[int, int] = FETCH_CAPS, seq: str = "seq") -> DataFrame:
    """The same rows as ``union_score_batches`` from a single scan: the first
    cap(score) rows of each listed rating, as a stratified head."""
    return stratified_head(df, caps, "score", seq)


def _stratified_rows(df: DataFrame, quotas: dict[int, int], by: str, seq: str) -> DataFrame:
    """Rows of ``df`` (meant to be narrow) among the first quota(s) of their
    stratum s."""
    quota = "CASE " + " ".join(f"WHEN `{by}` = {s} THEN {q}" for s, q in quotas.items()) + " END"
    strata = ", ".join(str(s) for s in quotas)
    ranked = _ranked(df.where(f"`{by}` IN ({strata})"), [by], seq, max(quotas.values()))
    return ranked.where(f"_rn <= {quota}").drop("_rn")


def stratified_head(df: DataFrame, quotas: dict[int, int] = QUOTAS, by: str = "score",
                    seq: str = "seq") -> DataFrame:
    """First quota(s) rows of each stratum s in arrival order; other strata
    are dropped (op C2). Ranked on (stratum, sequence) only, then fetched."""
    return _fetch(df, _stratified_rows(df.select(by, seq), quotas, by, seq), seq, sum(quotas.values()))


def curate(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The whole curation: per-rating batches -> projection -> length filter ->
    stratified head.

    Both rankings run on one narrow projection (rating, sequence, long-enough
    flag); the chosen reviews are then fetched once.
    """
    narrow = df.select("score", seq, (F.length("content") > MIN_CONTENT_CHARS).alias("_long"))
    batches = _stratified_rows(narrow, FETCH_CAPS, "score", seq)
    keys = _stratified_rows(batches.where("_long"), QUOTAS, "score", seq)
    return project_reviews(_fetch(df, keys, seq, sum(QUOTAS.values())), keep=(seq,))
