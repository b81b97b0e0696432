"""Complaint labelling and ranking (ops B6, B7, C3-C5, D1-D4).

The rule classifier (D4) is a chain of JVM regex predicates, the scope classifier
reads a text once and decides on a string of tags. Model inference
(D2) goes through ``mapInPandas`` on the distinct texts only, so repeated texts
are sent once, and label extraction (D3) parses the replies in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootcause.functions.text import JSON_SPAN_PATTERN, wrap_review
from rootcause.plans.scoped import FINANCE_WORDS, label_sql, parted, tags_sql
from rootcause.schemas import CATEGORY_COL
from rootcause.session import BATCH_ROWS, give_back, small_batches
from rootcause.themes import DEFAULT_THEME, THEMES

_SPAN = re.compile(r"\{.*\}", re.DOTALL)


def _sql_str(s: str) -> str:
    if "'" in s:
        raise ValueError(f"quote in rule text: {s!r}")
    return f"r'{s}'"


def classify_by_rules_expr(col: str, rules, default: str = DEFAULT_THEME) -> str:
    """Spark SQL text of ``classify_by_rules`` (raw literals keep regexes verbatim)."""
    whens = " ".join(f"WHEN lower({col}) RLIKE {_sql_str(p)} THEN {_sql_str(label)}" for label, p in rules)
    # The outer test keeps lower(text) in an always-evaluated position, so
    # codegen computes it once per row and reuses it in every rule.
    return f"CASE WHEN lower({col}) IS NOT NULL THEN (CASE {whens} ELSE {_sql_str(default)} END) END"


def classify_by_rules(col: str, rules, default: str = DEFAULT_THEME) -> Column:
    """First matching rule's label on lower(text), else ``default``; null text
    stays null (op D4). ``rules`` is an ordered list of (label, regex)."""
    return F.expr(classify_by_rules_expr(f"`{col}`", rules, default))


def tag_string(col: str, words: dict[str, str] = FINANCE_WORDS) -> Column:
    """One character for each token of the text (see ``plans/scoped.py``); null for a null text."""
    return F.expr(parted(tags_sql(f"`{col}`", words)))


def classify_by_scope(col: str, words: dict[str, str] = FINANCE_WORDS, default: str = DEFAULT_THEME) -> Column:
    """The complaint's theme, each failure word judged with the noun of its
    clause (op D4); null text stays null.

    The text is read once, natively; the decisions are patterns over its tags.
    """
    # Two nested lambdas of SQL would compute the tags for each pattern again:
    # as the argument of a transform they are computed once a row.
    label = label_sql("t", lambda s, p: f"{s} RLIKE r'{p}'", lambda s, p, by: f"regexp_replace({s}, r'{p}', '$1')", default)
    return F.expr(f"CASE WHEN `{col}` IS NOT NULL THEN element_at(transform(array({parted(tags_sql(f'`{col}`', words))}), t -> {label}), 1) END")


def label_column(col: str, rules=None) -> Column:
    """The scope classifier, or the given rule list."""
    return classify_by_scope(col) if rules is None else classify_by_rules(col, rules)


def with_category(df: DataFrame, label: Column, out: str = CATEGORY_COL) -> DataFrame:
    """Append the label column (op B6)."""
    return df.withColumn(out, label)


def _strip_reply(r):
    return None if r is None else str(r).strip()


def _replies(prompts: pd.Series, infer, on_error) -> pd.Series:
    """One model call for the batch; where it fails, one for each prompt."""
    if on_error is None:
        return pd.Series(list(infer(prompts)), index=prompts.index)
    try:
        replies = pd.Series(list(infer(prompts)), index=prompts.index)
        return replies
    except Exception:  # noqa: BLE001 - which prompt failed is found below
        out = []
        for i in range(len(prompts)):
            try:
                out.append(list(infer(prompts.iloc[i:i + 1]))[0])
            except Exception as e:  # noqa: BLE001
                out.append(on_error(e))
        return pd.Series(out, index=prompts.index)


def _infer_frames(batches, col, out, infer, wrap, on_error=None, text=True):
    """The batches with their replies; without the texts if ``text`` is false."""
    try:
        for b in batches:
            for at in range(0, len(b), BATCH_ROWS):
                part = b.iloc[at:at + BATCH_ROWS]
                prompts = part[col]
                if wrap:
                    prompts = prompts.map(lambda t: None if t is None else f"<review>{t}</review>")
                replies = _replies(prompts, infer, on_error)
                yield (part if text else part.drop(columns=col)).assign(**{out: replies.map(_strip_reply)})
    finally:
        give_back()


def batch_infer(df: DataFrame, col: str, infer: Callable[[pd.Series], pd.Series],
                out: str = "reply", wrap: bool = False, dedupe: bool = True,
                on_error: Callable[[Exception], str | None] | None = None) -> DataFrame:
    """One model call per distinct text (op D2).

    ``infer`` maps a pandas Series of prompts to a Series of replies; replies
    are whitespace-stripped. With ``dedupe`` the distinct texts are inferred
    and joined back. Texts are keyed by their SHA-256: the distinct step
    shuffles on the 64-character digest (partial aggregation collapses copies
    of a text inside each map task first), and the join back moves only
    (digest, reply) pairs, never a second copy of the text. AQE splits a
    skewed digest on the review side. ``wrap`` sends '<review>' + text + '</review>'.
    A call has BATCH_ROWS prompts at most, and a worker holds the texts of one call.
    With ``on_error`` a failing call costs only its own prompt: the reply is
    what ``on_error`` makes of the exception. Without it the exception ends the
    job.
    """
    small_batches(df.sparkSession)
    if dedupe:
        key = "_text_sha256"
        keyed = df.withColumn(key, F.sha2(F.col(col), 256))
        texts = (keyed.where(F.col(col).isNotNull()).groupBy(key)
                 .agg(F.any_value(F.col(col)).alias(col)))
        replies = texts.mapInPandas(lambda it: _infer_frames(it, col, out, infer, wrap, on_error, text=False),
                                    f"`{key}` string, `{out}` string")
        return keyed.join(replies, key, "left").drop(key)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType())])
    return df.mapInPandas(lambda it: _infer_frames(it, col, out, infer, wrap, on_error), schema)


def _label_of(reply):
    if reply is None:
        return DEFAULT_THEME
    m = _SPAN.search(reply)
    if not m:
        return DEFAULT_THEME
    try:
        doc = json.loads(m.group(0))
        value = doc.get("category", DEFAULT_THEME)
    except Exception:  # noqa: BLE001 - any failure falls back to the default
        return DEFAULT_THEME
    return value if value is None or isinstance(value, str) else json.dumps(value)


@F.pandas_udf(T.StringType())
def _extract_label_udf(replies: pd.Series) -> pd.Series:
    return replies.map(_label_of)


def extract_label(col) -> Column:
    """Label from a model reply, exact rules (op D3, strict path).

    Greedy first '{' to last '}' across lines, strict JSON parse, then the
    ``category`` member. No span, invalid JSON, a missing key or a non-object
    give the default; an explicit null stays null; labels are not checked
    against the taxonomy. Runs as an Arrow-batched pandas UDF.
    """
    return _extract_label_udf(F.col(col) if isinstance(col, str) else col)


def categorise(df: DataFrame, col: str, infer: Callable[[pd.Series], pd.Series], out: str = CATEGORY_COL, store=None,
               calls=None) -> DataFrame:
    """Every review with the model's label (ops D1 + D2 + D3 + B6).

    A call that fails gives the default label for its review, as does a reply
    without a label; a null text has none. With ``store`` (a ``ReplyStore``)
    replies are kept and only texts without one are sent, as ``calls`` says.
    """
    if store is None:
        replied = batch_infer(df, col, infer, out="_reply", wrap=True, on_error=lambda e: None)
    else:
        from rootcause.operators.replies import Calls, infer_stored
        replied = infer_stored(df, col, infer, store, out="_reply", wrap=True, calls=calls or Calls())
    label = F.when(F.col(col).isNotNull(), extract_label("_reply"))
    return with_category(replied, label, out).drop("_reply")


UNLISTED = "UNLISTED"


def listed_label(col: str, known=THEMES) -> Column:
    """The label if it is one of ``known``, else UNLISTED; null stays null."""
    return F.when(F.col(col).isNull() | F.col(col).isin(list(known)), F.col(col)).otherwise(F.lit(UNLISTED))


def category_distribution(df: DataFrame, col: str = CATEGORY_COL, known=None) -> DataFrame:
    """Count per category, null categories ignored, renamed to
    (Category, Count) and ordered by count desc then name (ops C3, B7).

    Labels are counted as they are. A model may answer with anything, so for
    its labels pass the ``known`` ones: all others are counted as UNLISTED, and
    the result has a bounded number of rows.
    """
    if known is not None:
        df = df.withColumn(col, listed_label(col, known))
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("Count"))
              .withColumnRenamed(col, "Category")
              .orderBy(F.col("Count").desc(), F.col("Category").asc()))


def top_category(dist: DataFrame) -> DataFrame:
    """The most frequent category (op C4)."""
    return dist.orderBy(F.col("Count").desc(), F.col("Category").asc()).limit(1)


def ranked_categories(dist: DataFrame) -> DataFrame:
    """Pick list with a 0-based index; index 0 is the default choice (op C5).

    The window has no partition key: its input is a distribution, one row per
    distinct label. Labels that nobody chose must be counted with ``known``.
    """
    w = Window.orderBy(F.col("Count").desc(), F.col("Category").asc())
    return dist.withColumn("idx", (F.row_number().over(w) - 1).cast("int")) \
               .withColumn("is_default", F.col("idx") == 0)


__all__ = ["classify_by_rules", "classify_by_scope", "label_column", "tag_string", "with_category", "batch_infer", "categorise", "extract_label", "wrap_review",
           "category_distribution", "top_category", "ranked_categories", "JSON_SPAN_PATTERN"]
