"""End-to-end triage: reviews -> theme per review -> theme ranking ->
cohort diagnostics of every theme, as one lazy plan.

The ranking is a small aggregate (one row per label) and the diagnostics are
computed for all themes in one pass per telemetry table, so no driver-side
choice of "the" top theme is needed: the report carries every theme with its
rank and the caller picks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootcause.operators.classify import category_distribution, label_column, ranked_categories, with_category
from rootcause.operators.curate import curate
from rootcause.operators.diagnose import diagnose_long
from rootcause.operators.insight import summarise, with_display
from rootcause.operators.severity import baseline
from rootcause.schemas import CATEGORY_COL


def label_reviews(reviews: DataFrame, rules=None, curated: bool = False) -> DataFrame:
    """Every review with its theme, by the scope classifier or a rule list; with
    ``curated``, only the stratified sample of them."""
    df = curate(reviews) if curated else reviews
    return with_category(df, label_column("content", rules))


def theme_ranking(reviews: DataFrame, rules=None, curated: bool = False) -> DataFrame:
    """(complaint_theme, review_count, rank_idx), most frequent first."""
    ranked = ranked_categories(category_distribution(label_reviews(reviews, rules, curated), CATEGORY_COL))
    return ranked.select(F.col("Category").alias("complaint_theme"), F.col("Count").alias("review_count"),
                         F.col("idx").alias("rank_idx"))


def executive_report(reviews: DataFrame, tables: dict[str, DataFrame], rules=None, curated: bool = False,
                     infer=None) -> DataFrame:
    """(complaint_theme, review_count, rank_idx, summary): every diagnosed theme
    with its rank and its executive summary."""
    summaries = summarise(diagnose_long(tables), infer, baseline(tables))
    return (summaries.join(theme_ranking(reviews, rules, curated), "complaint_theme", "left")
            .select("complaint_theme", F.coalesce(F.col("review_count"), F.lit(0).cast("long")).alias("review_count"),
                    "rank_idx", "summary"))


def triage_report(reviews: DataFrame, tables: dict[str, DataFrame], rules=None,
                  curated: bool = False) -> DataFrame:
    """(complaint_theme, review_count, rank_idx, group_key, metric, value, display).

    Themes nobody complained about keep review_count 0; labels outside the
    diagnostic plans carry no metrics.
    """
    ranked = theme_ranking(reviews, rules, curated)
    diag = with_display(diagnose_long(tables)).select("complaint_theme", "group_key", "metric", "value", "display")
    return (diag.join(ranked, "complaint_theme", "full_outer")
                .withColumn("review_count", F.coalesce(F.col("review_count"), F.lit(0).cast("long")))
                .select("complaint_theme", "review_count", "rank_idx", "group_key", "metric", "value", "display"))
