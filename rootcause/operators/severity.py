"""How far a cohort's metrics lie from everybody else's (op F2).

For every metric of a theme the values of users without a ticket of that theme
are summarised by a mergeable quantile sketch (partial sketches in the map
tasks, one merge), in one pass over each telemetry table for all its themes.
A result row's severity is its distance from their median in robust standard
deviations, in the metric's bad direction; a count's is the distance of its
group's share in the cohort from the share outside it, in standard deviations of
one draw. Both say how unusual the row is, so that all metrics of a theme compare.

The sketch is exact up to half of ``accuracy`` values and off by at most
n / accuracy ranks beyond (one rank in 100 000). A task's sketch of one metric
holds at most about accuracy / 2 entries of 24 bytes, and all of them are merged
in one task, so with many thousands of tasks pass a smaller accuracy (10 000
gives 0.1 MB a task and metric).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootcause.operators.diagnose import cohort_fits_broadcast
from rootcause.plans.diagnostics import PLANS, DiagnosticPlan, Metric

ACCURACY = 100_000
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Standard deviations between the quartiles and between the outer quantiles of
#: a normal distribution.
INNER, OUTER = 1.349, 3.29


def cohort_masks(support: DataFrame, themes: list[str]) -> DataFrame:
    """(user_id, mask): bit i is set where the user has a ticket of theme i."""
    bit = "CASE complaint_theme " + " ".join(f"WHEN '{t}' THEN {1 << i}" for i, t in enumerate(themes)) + " END"
    return (support.where(F.col("complaint_theme").isin(themes) & F.col("user_id").isNotNull())
            .groupBy("user_id").agg(F.expr(f"bit_or({bit}) AS mask")))


def _entries(rows: list[dict[str, str]]) -> str:
    """SQL text: one row for each dict of column -> expression."""
    structs = ["named_struct(" + ", ".join(f"'{k}', {v}" for k, v in r.items()) + ")" for r in rows]
    return f"inline(array({', '.join(structs)}))"


def baseline(tables: dict[str, DataFrame], themes=None, accuracy: int = ACCURACY) -> DataFrame:
    """(complaint_theme, metric, median, scale, outside, outside_total) of the
    users outside each theme's cohort, one row a metric.

    ``scale`` is the larger of the two robust standard deviations (null where
    neither spreads); ``outside`` has the number of rows of each group, for counts.
    """
    themes = list(themes or PLANS)
    support = tables["customer_support"]
    masks = cohort_masks(support, themes)
    masks = F.broadcast(masks) if cohort_fits_broadcast(support, themes) else masks
    by_table: dict[str, list[tuple[int, DiagnosticPlan, Metric]]] = {}
    for i, theme in enumerate(themes):
        plan = PLANS[theme]
        for m in plan.metrics:
            by_table.setdefault("customer_support" if m.source == "support" else plan.target, []).append((i, plan, m))
    parts = []
    for table, metrics in by_table.items():
        groups = sorted({p.group_by for _, p, m in metrics if m.agg == "count" and p.group_by})
        measures = [x for x in metrics if x[2].agg != "count"]
        cols = ["user_id", *groups, *sorted({m.column for _, _, m in metrics} - {"user_id", *groups})]
        rows = tables[table].select(*cols).join(masks, "user_id", "left").withColumn("mask", F.expr("coalesce(mask, 0)"))
        if measures:
            quantiles = ", ".join(f"{q}D" for q in QUANTILES)
            sketches = rows.agg(*(F.expr(f"percentile_approx(CASE WHEN mask & {1 << i} = 0 THEN CAST({m.column} AS DOUBLE) END, "
                                         f"array({quantiles}), {accuracy}) AS q{k}") for k, (i, _, m) in enumerate(measures)))
            parts.append(sketches.selectExpr(_entries([
                {"complaint_theme": f"'{p.theme}'", "metric": f"'{m.alias}'", "median": f"q{k}[2]",
                 "scale": f"nullif(greatest((q{k}[3] - q{k}[1]) / {INNER}D, (q{k}[4] - q{k}[0]) / {OUTER}D), 0D)",
                 "outside": "CAST(NULL AS MAP<STRING, BIGINT>)", "outside_total": "CAST(NULL AS BIGINT)"}
                for k, (_, p, m) in enumerate(measures)])))
        for group in groups:
            mine = [(i, p, m) for i, p, m in metrics if m.agg == "count" and p.group_by == group]
            held = rows.groupBy(F.expr(f"coalesce(CAST({group} AS STRING), '') AS g")).agg(
                *(F.expr(f"count(CASE WHEN mask & {1 << i} = 0 THEN {m.column} END) AS n{k}") for k, (i, _, m) in enumerate(mine)))
            maps = held.agg(*(F.expr(x) for k in range(len(mine)) for x in (
                f"map_from_entries(collect_list(named_struct('g', g, 'n', n{k}))) AS m{k}", f"coalesce(sum(n{k}), 0L) AS t{k}")))
            parts.append(maps.selectExpr(_entries([
                {"complaint_theme": f"'{p.theme}'", "metric": f"'{m.alias}'", "median": "CAST(NULL AS DOUBLE)", "scale": "CAST(NULL AS DOUBLE)",
                 "outside": f"m{k}", "outside_total": f"t{k}"} for k, (_, p, m) in enumerate(mine)])))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def with_severity(long_df: DataFrame, base: DataFrame) -> DataFrame:
    """``long_df`` (of ``diagnose_long``) with the severity of each value; null
    for a missing value and for a metric without any outside value."""
    high = "CASE concat(complaint_theme, ' ', metric) " + " ".join(
        f"WHEN '{t} {m.alias}' THEN {str(m.high_is_bad).lower()}" for t, p in PLANS.items() for m in p.metrics) + " END"
    # A few result rows a theme; a join with their own sum would compute them twice.
    d = (long_df.withColumn("_cohort", F.expr("sum(n) OVER (PARTITION BY complaint_theme, metric)"))
         .join(F.broadcast(base), ["complaint_theme", "metric"], "left"))
    apart = "(value - median) / coalesce(scale, 1D)"
    # Half a row more than there are, so that a group unknown outside has a share.
    d = d.withColumn("_usual", F.expr("(coalesce(outside[coalesce(group_key, '')], 0L) + 0.5D) / (outside_total + 1D)"))
    unusual = "(try_divide(CAST(n AS DOUBLE), CAST(_cohort AS DOUBLE)) - _usual) / sqrt(_usual * (1D - _usual))"
    return d.selectExpr(*long_df.columns, f"CASE WHEN agg = 'count' THEN {unusual} WHEN {high} THEN {apart} ELSE -({apart}) END AS severity")
