"""Result interpretation (ops F1-F6) over the tidy diagnostics frame.

Input is ``diagnose_long`` output: (complaint_theme, group_key, metric, agg,
value, total, n). Numbers are rendered from the exact sum and count, so the
text does not depend on floating rounding. Everything is a small aggregate
per theme; the work that scales is the diagnostic join upstream.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootcause.functions.numeric import fmt_ratio_2dp_expr
from rootcause.functions.units import unit_suffix_expr
from rootcause.operators.severity import with_severity
from rootcause.plans.diagnostics import PLANS
from rootcause.themes import ACTION_OWNERS, ACTIONS_HEADING, INSIGHT_ERROR_PREFIX, INSIGHT_HEADING

# Fixed value: the request text handed to the summarising model.
INSIGHT_REQUEST = "The top user complaint is '{theme}'. Exact metrics:\n{text}\n\nPlease generate the Executive Summary."

BULLET_PATTERN = r"(?m)^[ \t]*[-*] "
# A sentence ends at a mark with a new beginning behind it, or at the end of the text; a mark
# inside a number, or after one of these abbreviations, ends nothing.
ABBREVIATION_PATTERN = r"(?i)(^|[^\p{L}])(vs|approx|incl|excl|avg|max|min|no|e\.g|i\.e)\."
SENTENCE_END_PATTERN = r"[.!?]+[\"')*_]*(\s+[^\sa-z]|\s*$)"
ENDED_PATTERN = r"(^|[.!?][\"')*_]*)\s*$"
# A number of basis points written as a percentage: '%' right beside 'bps', or
# in place of it after a metric named bps.
BPS_AS_PERCENT_PATTERN = r"(?i)(\d\s*%\s*\(?bps|bps\s*\)?%|_bps[^\n.;,]{0,20}\d\s*%)"


def with_display(long_df: DataFrame) -> DataFrame:
    """Add the unit-aware rendering of each value (op F3): counts as integers,
    sums and averages with 2 decimals, then ' bps', ' ms', '%', ' hours' or ' days'."""
    number = (f"CASE agg WHEN 'count' THEN CAST(n AS STRING) WHEN 'sum' THEN {fmt_ratio_2dp_expr('total', '1L')} "
              f"ELSE {fmt_ratio_2dp_expr('total', 'n')} END")
    return long_df.withColumn("display", F.expr(f"concat({number}, {unit_suffix_expr('metric')})"))


def metrics_to_text(long_df: DataFrame) -> DataFrame:
    """One text block per theme: a line per result row, 'key | metric=value | ...',
    lines and metrics in sorted order (op F1)."""
    d = with_display(long_df)
    cell = F.concat(F.col("metric"), F.lit("="), F.coalesce(F.col("display"), F.lit("null")))
    rows = (d.groupBy("complaint_theme", "group_key")
             .agg(F.array_join(F.array_sort(F.collect_list(cell)), " | ").alias("_cells"))
             .select("complaint_theme",
                     F.concat(F.coalesce(F.concat(F.col("group_key"), F.lit(" | ")), F.lit("")),
                              F.col("_cells")).alias("_line")))
    return rows.groupBy("complaint_theme").agg(
        F.array_join(F.array_sort(F.collect_list("_line")), "\n").alias("metrics_text"))


def worst_row(long_df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The most severe result row of each theme (op F2).

    Multi-row results are not averaged. With ``base`` (``severity.baseline``)
    the row and metric that lie farthest, in the bad direction, from the users
    outside the cohort win, over all metrics of the theme, and the distance is
    column ``severity``. Without it the row with the worst primary metric wins
    (high latency, drop or error rate, count, age; low balance or slippage).
    Ties are broken by the smaller group key and metric. A row without a value,
    or of the theme's healthy group, is chosen only where there is no other. One
    partial+final aggregate per theme.
    """
    healthy = "CASE complaint_theme " + " ".join(
        f"WHEN '{t}' THEN group_key <=> '{p.healthy_key}'" for t, p in PLANS.items() if p.healthy_key) + " ELSE false END"
    if base is None:
        metric = "CASE complaint_theme " + " ".join(
            f"WHEN '{t}' THEN '{p.severity_metric}'" for t, p in PLANS.items()) + " END"
        high = "CASE complaint_theme " + " ".join(
            f"WHEN '{t}' THEN {str(p.severity_high_is_bad).lower()}" for t, p in PLANS.items()) + " END"
        d = with_display(long_df).where(F.expr(f"metric = {metric}"))
        order, severity = f"CASE WHEN {high} THEN -value ELSE value END", []
    else:
        d = with_display(with_severity(long_df, base))
        order, severity = "-severity", ["_w.s AS severity"]
    best = F.expr(f"min(named_struct('n', value IS NULL, 'h', {healthy}, 'u', {order} IS NULL, 'b', {order}, "
                  f"'g', group_key, 'm', metric, 'v', value, 'd', display{', ' + chr(39) + 's' + chr(39) + ', severity' if severity else ''}))")
    return d.groupBy("complaint_theme").agg(best.alias("_w")).selectExpr(
        "complaint_theme", "_w.g AS group_key", "_w.m AS severity_metric", "_w.v AS severity_value",
        "_w.d AS severity_display", *severity)


def insight_request(theme, text) -> Column:
    """The summary request for a theme and its metrics text (op F4)."""
    head, rest = INSIGHT_REQUEST.split("{theme}")
    mid, tail = rest.split("{text}")
    theme = F.col(theme) if isinstance(theme, str) else theme
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(head), theme, F.lit(mid), text, F.lit(tail))


def template_summary(worst: DataFrame) -> DataFrame:
    """Built-in summariser: heading, a 2-sentence summary citing the worst
    row with its unit, and the three owner bullets (op F6 default)."""
    theme, metric, disp = F.col("complaint_theme"), F.col("severity_metric"), F.coalesce(
        F.col("severity_display"), F.lit("no data"))
    where = F.coalesce(F.concat(F.lit(" for "), F.col("group_key")), F.lit(""))
    s1 = F.concat(theme, F.lit(" complaints trace to "), metric, F.lit(" at "), disp, where, F.lit("."))
    s2 = F.lit("Act on this cohort before the complaint volume grows.")
    bullets = [
        F.concat(F.lit("- **Engineering**: fix the logic behind "), metric, F.lit(" for the affected cohort.")),
        F.concat(F.lit("- **Infrastructure**: add capacity and alerting on "), metric, F.lit(".")),
        F.concat(F.lit("- **Product**: notify the affected "), theme, F.lit(" cohort in-app while the fix ships.")),
    ]
    body = F.concat_ws("\n", F.lit(INSIGHT_HEADING), F.concat_ws(" ", s1, s2), F.lit(""),
                       F.lit(ACTIONS_HEADING), *bullets)
    return worst.select("complaint_theme", body.alias("summary"))


def summarise(long_df: DataFrame, infer: Callable[[pd.Series], pd.Series] | None = None,
              base: DataFrame | None = None) -> DataFrame:
    """Executive summary per theme (op F6), of the row that ``worst_row`` picks.

    Without ``infer`` the template summariser runs on the JVM. With ``infer``
    (a model, Series of requests -> Series of replies) the F4 requests are sent
    through ``batch_infer``; a failing call yields 'Error generating insight: ...'
    for its theme only.
    """
    if infer is None:
        return template_summary(worst_row(long_df, base))
    from rootcause.operators.classify import batch_infer

    req = metrics_to_text(long_df).select(
        "complaint_theme", insight_request("complaint_theme", "metrics_text").alias("request"))
    return batch_infer(req, "request", infer, out="summary", dedupe=False,
                       on_error=lambda e: f"{INSIGHT_ERROR_PREFIX}{e}").select("complaint_theme", "summary")


def summary_contract(df: DataFrame, col: str = "summary") -> DataFrame:
    """Checks on produced summaries (op F5).

    The text starts exactly with the heading (no preamble); two sentences
    stand between it and the actions heading; exactly three bullets follow, one
    for each owner, and nothing after them; no basis points written as '%'.
    """
    c = F.col(col)
    has_heading = F.startswith(c, F.lit(INSIGHT_HEADING + "\n"))
    body = F.substring_index(F.substring(c, len(INSIGHT_HEADING) + 1, 1_000_000), ACTIONS_HEADING, 1)
    body = F.regexp_replace(body, ABBREVIATION_PATTERN, "$1$2")
    # What stands after the last mark is a sentence without one.
    sentences = (F.regexp_count(body, F.lit(SENTENCE_END_PATTERN)) + (~body.rlike(ENDED_PATTERN)).cast("int")).cast("long")
    bullets = F.regexp_count(c, F.lit(BULLET_PATTERN)).cast("long")
    after = F.filter(F.split(F.trim(F.when(c.contains(ACTIONS_HEADING), F.substring_index(c, ACTIONS_HEADING, -1))
                                    .otherwise(F.lit(""))), "\n"), lambda line: F.trim(line) != "")
    owners = reduce(lambda acc, o: acc & F.exists(after, lambda line: line.rlike(rf"^\s*[-*] \*\*{o}\*\*")),
                    ACTION_OWNERS, F.lit(True))
    no_chatter = F.forall(after, lambda line: line.rlike(BULLET_PATTERN))
    bps_ok = ~c.rlike(BPS_AS_PERCENT_PATTERN)
    return df.select("complaint_theme", has_heading.alias("has_heading"), sentences.alias("sentence_count"),
                     bullets.alias("bullet_count"), owners.alias("has_owners"), no_chatter.alias("no_chatter"),
                     bps_ok.alias("bps_not_percent"),
                     (has_heading & (sentences == 2) & (bullets == 3) & owners & no_chatter & bps_ok).alias("ok"))
