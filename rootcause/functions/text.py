"""String operators: strip, preview, review wrapping, regex word patterns,
SQL-statement extraction and the native label-extraction fast path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rootcause.themes import DEFAULT_THEME, SQL_ERROR_SENTINEL

# The statement and JSON-span patterns of the reference's reply
# parsing (first SELECT up to the first ';' or the end; greedy first '{' to last '}').
SQL_STATEMENT_PATTERN = r"(?is)\bSELECT\b.*?(?:;|$)"
JSON_SPAN_PATTERN = r"(?s)\{.*\}"
STRIP_PATTERN = r"(?U)^\s+|\s+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Whitespace strip on both ends, Unicode white space included (``trim``
    only removes spaces)."""
    return F.regexp_replace(_col(c), STRIP_PATTERN, "")


def preview(c, n: int = 75) -> Column:
    """First ``n`` characters plus '...' when the text is longer (op B3)."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def wrap_review(c) -> Column:
    """'<review>' + text + '</review>' (op D1)."""
    return F.concat(F.lit("<review>"), _col(c), F.lit("</review>"))


def word_pattern(*words: str) -> str:
    """Regex matching any of ``words`` between non-letters.

    Boundaries are written with ``\\p{L}`` instead of ``\\b`` so every regex
    engine agrees on accented letters.
    """
    alt = "|".join(words)
    return rf"(^|[^\p{{L}}])({alt})([^\p{{L}}]|$)"


def extract_sql(c) -> Column:
    """Isolate the SQL statement in a model reply (op E8).

    First case-insensitive SELECT word up to the first ';' (kept) or the end,
    stripped; no match, or no reply, gives the sentinel, which fails later as
    an Error row.
    """
    stmt = strip(F.regexp_extract(_col(c), SQL_STATEMENT_PATTERN, 0))
    return F.coalesce(F.nullif(stmt, F.lit("")), F.lit(SQL_ERROR_SENTINEL))


def extract_label_native(c) -> Column:
    """JVM-only label extraction (op D3, fast path).

    Greedy '{'..'}' span, parsed with ``from_json``; missing/invalid gives the
    default. It differs from the strict path on replies with two objects or an
    extra closing brace (the JSON reader accepts the first object) and maps an
    explicit null category to the default; use ``extract_label`` for exact
    semantics.
    """
    span = F.regexp_extract(_col(c), JSON_SPAN_PATTERN, 0)
    parsed = F.from_json(span, "category string", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    return F.coalesce(parsed["category"], F.lit(DEFAULT_THEME))
