"""Cohort diagnostics (ops E0-E10).

A diagnostic joins a telemetry table to the support tickets of one complaint
theme on ``user_id`` and aggregates theme-specific metrics. The join is a
plain inner join (all telemetry rows of cohort users count, healthy ones
included), and tickets are not de-duplicated: repeated (user, theme) tickets
multiply rows exactly as in SQL.

Physical plan: the cohort side is projected to ``user_id`` (plus ticket columns
when a metric needs them) and filtered by theme before the join. A cohort
counted to be small is broadcast; a larger one is joined after both sides were
reduced per user. Aggregates are partial + final, so only one row per (task,
group) crosses the shuffle.

The all-theme plans and the single-theme plans (all but ``rows``) are one SQL
text over the bound frames (``spark.sql(text, support=df, t_<table>=df)``): Catalyst sees
the same plan as from composed DataFrame calls, built in a few driver round
trips.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootcause.functions.numeric import SUM_TYPE, exact_avg, exact_sum
from rootcause.functions.text import extract_sql
from rootcause.operators.keyfilter import MAX_KEYS, might_match
from rootcause.operators.statements import CHECKS, joins_without_equality, parse_query, plan_tree, statement_contract, wrapped
from rootcause.plans.diagnostics import ID_COLUMNS, PLANS, UNIT_SUFFIXES, DiagnosticPlan
from rootcause.schemas import TABLE_SCHEMAS
from rootcause.session import reliable_checkpoint

def theme_filter(support: DataFrame, theme: str) -> DataFrame:
    """Tickets of one complaint theme (op B9)."""
    return support.where(F.col("complaint_theme") == F.lit(theme))


def _support_cols(plan: DiagnosticPlan) -> list[str]:
    return [m.column for m in plan.metrics if m.source == "support"]


def _target_cols(plan: DiagnosticPlan) -> list[str]:
    cols = ["user_id"] + ([plan.group_by] if plan.group_by else [])
    cols += [m.column for m in plan.metrics if m.source == "target" and m.column not in cols]
    return cols


def _agg(m, prefix=""):
    c = F.col(prefix + m.column) if prefix else F.col(m.column)
    return {"count": F.count, "avg": exact_avg, "sum": lambda x: exact_sum(x).cast("double")}[m.agg](c)


def diagnose(tables: dict[str, DataFrame], theme: str, strategy: str = "auto") -> DataFrame:
    """The diagnostic result of one theme (op E0 dispatch, E1-E7 bodies), with
    the SQL result schema: the group column (if any) and one column per metric.

    ``rows`` is the SQL-shaped plan (join every telemetry row to the cohort,
    AQE picks the join). The other strategies (``auto``, ``broadcast``,
    ``filtered``, ``pre_aggregate``) run ``diagnose_long`` for this theme, which broadcasts
    only a cohort proven small and otherwise pre-aggregates per user, then pivot
    back to the same schema; results are identical.
    """
    if strategy != "rows":
        return _wide(tables, PLANS[theme], strategy)
    plan = PLANS[theme]
    cohort = theme_filter(tables["customer_support"], theme).select("user_id", *_support_cols(plan))
    target = tables[plan.target].select(*_target_cols(plan))
    # Support-side metric columns are renamed so a target column of the same
    # name cannot shadow them.
    for c in _support_cols(plan):
        cohort = cohort.withColumnRenamed(c, "cs_" + c)
    joined = target.join(cohort, "user_id", "inner")
    aggs = [_agg(m, "cs_" if m.source == "support" else "").alias(m.alias) for m in plan.metrics]
    if plan.group_by:
        return joined.groupBy(plan.group_by).agg(*aggs)
    return joined.agg(*aggs)


def _wide(tables: dict[str, DataFrame], plan: DiagnosticPlan, strategy: str) -> DataFrame:
    """One theme's result columns straight from its grouped aggregate (the
    grouped rows are already wide: one row per group key)."""
    if strategy == "auto":
        strategy = _chosen(tables["customer_support"], [plan.theme])
    if strategy not in ("broadcast", "filtered", "pre_aggregate"):
        raise ValueError(f"unknown strategy {strategy!r}")
    metrics = _metric_index([plan])
    cols = ([f"group_key AS {plan.group_by}"] if plan.group_by else []) + [
        f"{'n' if m.agg == 'count' else 'v'}{metrics[(m.column, m.source, m.agg)]} AS {m.alias}"
        for m in plan.metrics]
    sql = f"SELECT {', '.join(cols)} FROM ({_grouped_sql(plan.target, [plan], metrics, strategy)}) g"
    return tables["customer_support"].sparkSession.sql(
        sql, support=tables["customer_support"], **{f"t_{plan.target}": _telemetry(tables, plan.target, [plan], strategy)})


# Cohorts up to this many tickets are broadcast (user_id, theme and at most two
# numeric ticket columns: a few tens of MB). Checked with an exact count.
BROADCAST_MAX_TICKETS = 1_000_000


_FITS: "weakref.WeakKeyDictionary[DataFrame, dict]" = weakref.WeakKeyDictionary()


def cohort_fits_broadcast(support: DataFrame, themes, max_rows: int = BROADCAST_MAX_TICKETS) -> bool:
    """True when the themes' tickets number at most ``max_rows``."""
    return ticket_count(support, themes) <= max_rows


def ticket_count(support: DataFrame, themes) -> int:
    """Tickets of the themes, by exact counts (partial counts per task, so one row per task and theme
    reaches the final count; ``limit(max_rows + 1)`` would instead send up
    to max_rows rows per task into one task). One grouped count over the
    diagnosed themes (at most one row each) answers every subset; it is kept
    per support view (a view reads a fixed file listing), so it runs once."""
    counts = _FITS.get(support)
    if counts is None:
        rows = (support.where(F.col("complaint_theme").isin(list(PLANS)))
                .groupBy("complaint_theme").count().collect())
        counts = _FITS[support] = {r["complaint_theme"]: r["count"] for r in rows}
    unknown = [t for t in themes if t not in PLANS]
    if unknown:  # outside the plan table: count those directly
        extra = support.where(F.col("complaint_theme").isin(unknown)).count()
    else:
        extra = 0
    return sum(counts.get(t, 0) for t in themes if t in PLANS) + extra


def _chosen(support: DataFrame, themes) -> str:
    """The plan for a cohort of the counted size."""
    if cohort_fits_broadcast(support, themes):
        return "broadcast"
    return "filtered" if ticket_count(support, themes) <= MAX_KEYS else "pre_aggregate"


def _telemetry(tables: dict[str, DataFrame], target: str, plans: list[DiagnosticPlan], strategy: str) -> DataFrame:
    """The target table of a strategy: with ``filtered`` only the rows whose
    user may be in a cohort, so that no others are grouped and shuffled."""
    if strategy != "filtered":
        return tables[target]
    themes = [p.theme for p in plans]
    support = tables["customer_support"]
    cohort = support.where(F.col("complaint_theme").isin(themes)).select("user_id")
    return might_match(tables[target], "user_id", cohort, ticket_count(support, themes))


def diagnose_long(tables: dict[str, DataFrame], themes=None, strategy: str = "auto") -> DataFrame:
    """All requested themes in one tidy frame.

    Themes that share a target table are computed in one pass and grouped by
    (theme, group key). Output rows: (complaint_theme, group_key, metric, agg,
    value, total, n); ``total`` (a decimal) and ``n`` keep the exact sum and
    count behind a sum or an average for exact rendering. A global aggregate over an empty cohort
    still yields its row (nulls), as in SQL; keyed aggregates yield no rows.

    Strategies (identical results, bit for bit):

    - ``broadcast``: the cohort tickets are broadcast and every telemetry row
      is joined map-side, then aggregated. Telemetry is never shuffled and a
      hot user costs nothing extra. Chosen by ``auto`` only when the cohort is
      proven small (``cohort_fits_broadcast``).
    - ``filtered``: telemetry rows of users outside every cohort are dropped in
      the scan by a Bloom filter of the cohorts' users, then as
      ``pre_aggregate``. The plan for cohorts too large to broadcast, whose
      filter is not.
    - ``pre_aggregate``: both sides are reduced per user before the join:
      telemetry to (user, group column) partial sums and counts, tickets to
      (user, theme) counts. Partial aggregation collapses a hot user inside
      each map task, the join meets one row per user on each side, and totals
      are sums of ticket count x partial. Decimal sums keep this exact,
      repeated tickets included. The plan for cohorts too large to broadcast.
    - ``rows``: the plain row-level join; the join strategy is left to AQE.
    """
    themes = list(themes or PLANS)
    if strategy == "auto":
        strategy = _chosen(tables["customer_support"], themes)
    if strategy not in ("broadcast", "filtered", "pre_aggregate", "rows"):
        raise ValueError(f"unknown strategy {strategy!r}")
    by_target: dict[str, list[DiagnosticPlan]] = {}
    for t in themes:
        by_target.setdefault(PLANS[t].target, []).append(PLANS[t])
    # One SQL text for all targets: the plan is the same as composing
    # DataFrame calls, but it is built in a handful of driver round trips.
    parts = [_target_sql(target, plans, strategy) for target, plans in by_target.items()]
    frames = {"support": tables["customer_support"],
              **{f"t_{t}": _telemetry(tables, t, plans, strategy) for t, plans in by_target.items()}}
    spark = tables["customer_support"].sparkSession
    return spark.sql("\nUNION ALL\n".join(parts), **frames)


def _metric_index(plans):
    metrics = {}
    for p in plans:
        for m in p.metrics:
            metrics.setdefault((m.column, m.source, m.agg), len(metrics))
    return metrics


def _in_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _group_key_sql(plans) -> str:
    whens = " ".join(f"WHEN complaint_theme = '{p.theme}' THEN CAST({p.group_by} AS STRING)"
                     for p in plans if p.group_by)
    return f"CASE {whens} END" if whens else "CAST(NULL AS STRING)"


def _seeds_sql(plans, n_before: int, n_after: int) -> str:
    """A global aggregate over an empty cohort is still one row in SQL. One
    all-null seed row per global theme gives that row (counts 0, averages
    null) without touching any count or average of a non-empty cohort. The
    seed has ``n_before`` nulls, the theme, then ``n_after`` nulls (plain
    NULLs take the column types in the union)."""
    rows = []
    for p in plans:
        if p.group_by is None:
            cols = ["NULL"] * n_before + [f"'{p.theme}'"] + ["NULL"] * n_after
            rows.append("SELECT " + ", ".join(cols))
    return "".join(f"\n  UNION ALL {r}" for r in rows)


def _value_sql(agg: str, total: str, n: str) -> str:
    as_double = f"CAST({total} AS DOUBLE)"
    return f"try_divide({as_double}, {n})" if agg == "avg" else as_double


def _rows_sql(target, plans, metrics, broadcast_cohort: bool) -> str:
    """Row-level plan: join every telemetry row to the cohort, then aggregate."""
    support_cols = sorted({c for p in plans for c in _support_cols(p)})
    target_cols = []
    for p in plans:
        target_cols += [c for c in _target_cols(p) if c not in target_cols]
    cohort = (f"SELECT user_id, complaint_theme{''.join(f', {c} AS cs_{c}' for c in support_cols)} "
              f"FROM {{support}} WHERE complaint_theme IN ({_in_list(p.theme for p in plans)})")
    hint = "/*+ BROADCAST(c) */ " if broadcast_cohort else ""
    joined = (f"SELECT {hint}{', '.join('t.' + c for c in target_cols)}, c.complaint_theme"
              f"{''.join(f', c.cs_{c}' for c in support_cols)}, {_group_key_sql(plans)} AS group_key "
              f"FROM (SELECT {', '.join(target_cols)} FROM {{t_{target}}}) t JOIN ({cohort}) c "
              f"ON t.user_id = c.user_id"
              + _seeds_sql(plans, len(target_cols), len(support_cols) + 1))
    aggs = []
    for (col, source, agg), i in metrics.items():
        c = "cs_" + col if source == "support" else col
        aggs.append(f"count({c}) AS n{i}")
        if agg != "count":
            dec = f"sum(CAST({c} AS {SUM_TYPE}))"
            aggs += [f"{_value_sql(agg, dec, f'count({c})')} AS v{i}", f"CAST({dec} AS DECIMAL(38,6)) AS s{i}"]
    return (f"SELECT complaint_theme, group_key, {', '.join(aggs)} FROM ({joined}) j "
            f"GROUP BY complaint_theme, group_key")


def _preaggregated_sql(target, plans, metrics) -> str:
    """Eager-aggregation plan: reduce both sides per user, then join."""
    group_cols = sorted({p.group_by for p in plans if p.group_by})
    t_cols = sorted({c for (c, src, _) in metrics if src == "target"})
    s_cols = sorted({c for (c, src, _) in metrics if src == "support"})
    t_aggs = ["count(1) AS _rows"] + [f"sum(CAST({c} AS {SUM_TYPE})) AS ts_{c}, count({c}) AS tn_{c}"
                                      for c in t_cols]
    t_keys = ", ".join(["user_id", *group_cols])
    tpart = f"SELECT {t_keys}, {', '.join(t_aggs)} FROM {{t_{target}}} GROUP BY {t_keys}"
    s_aggs = ["count(1) AS _tickets"] + [f"sum(CAST({c} AS {SUM_TYPE})) AS ss_{c}, count({c}) AS sn_{c}"
                                         for c in s_cols]
    spart = (f"SELECT user_id, complaint_theme, {', '.join(s_aggs)} FROM {{support}} "
             f"WHERE complaint_theme IN ({_in_list(p.theme for p in plans)}) GROUP BY user_id, complaint_theme")
    tp_cols = ["user_id", *group_cols, "_rows", *[f"{x}_{c}" for c in t_cols for x in ("ts", "tn")]]
    sp_cols = ["_tickets", *[f"{x}_{c}" for c in s_cols for x in ("ss", "sn")]]
    joined = (f"SELECT {', '.join('tp.' + c for c in tp_cols)}, sp.complaint_theme, "
              f"{', '.join('sp.' + c for c in sp_cols)}, {_group_key_sql(plans)} AS group_key "
              f"FROM ({tpart}) tp JOIN ({spart}) sp ON tp.user_id = sp.user_id"
              + _seeds_sql(plans, len(tp_cols), len(sp_cols) + 1))
    aggs = []
    for (col, source, agg), i in metrics.items():
        weight, total, cnt = (("_rows", "ss_" + col, "sn_" + col) if source == "support"
                              else ("_tickets", "ts_" + col, "tn_" + col))
        n = f"coalesce(sum({weight} * {cnt}), CAST(0 AS BIGINT))"
        aggs.append(f"{n} AS n{i}")
        if agg != "count":
            total_sum = f"sum(CAST({weight} * {total} AS DECIMAL(38,6)))"
            aggs += [f"{_value_sql(agg, total_sum, n)} AS v{i}", f"CAST({total_sum} AS DECIMAL(38,6)) AS s{i}"]
    return (f"SELECT complaint_theme, group_key, {', '.join(aggs)} FROM ({joined}) j "
            f"GROUP BY complaint_theme, group_key")


def _grouped_sql(target: str, plans, metrics, strategy: str) -> str:
    """(complaint_theme, group_key, n<i>, v<i>, s<i>) per theme and group key."""
    if strategy in ("filtered", "pre_aggregate"):
        return _preaggregated_sql(target, plans, metrics)
    return _rows_sql(target, plans, metrics, broadcast_cohort=strategy == "broadcast")


def _target_sql(target: str, plans: list[DiagnosticPlan], strategy: str) -> str:
    """Tidy rows (complaint_theme, group_key, metric, agg, value, total, n)
    of the themes sharing one target table."""
    metrics = _metric_index(plans)
    grouped = _grouped_sql(target, plans, metrics, strategy)
    entries = []
    for p in plans:
        for m in p.metrics:
            i = metrics[(m.column, m.source, m.agg)]
            value, total = ((f"CAST(n{i} AS DOUBLE)", "CAST(NULL AS DECIMAL(38,6))") if m.agg == "count"
                            else (f"v{i}", f"s{i}"))
            entries.append(f"CASE WHEN complaint_theme = '{p.theme}' THEN named_struct('metric', '{m.alias}', "
                           f"'agg', '{m.agg}', 'value', {value}, 'total', {total}, 'n', n{i}) END")
    return (f"SELECT complaint_theme, group_key, inline(filter(array({', '.join(entries)}), x -> x IS NOT NULL)) "
            f"FROM ({grouped}) g")


# ---------------------------------------------------------------- SQL access

def load_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Expose the tables to SQL under their names (op A3)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def plan_sql(theme: str) -> str:
    """The fixed diagnostic of a theme as SQL text over the named tables."""
    p = PLANS[theme]
    t = p.target
    sel = []
    if p.group_by:
        sel.append(f"{t}.{p.group_by}")
    for m in p.metrics:
        ref = f"customer_support.{m.column}" if m.source == "support" else f"{t}.{m.column}"
        if m.agg == "count":
            sel.append(f"COUNT({ref}) AS {m.alias}")
        else:
            sel.append(f"{_value_sql(m.agg, f'SUM(CAST({ref} AS {SUM_TYPE.upper()}))', f'COUNT({ref})')} AS {m.alias}")
    sql = (f"SELECT {', '.join(sel)} FROM {t} JOIN customer_support "
           f"ON customer_support.user_id = {t}.user_id "
           f"WHERE customer_support.complaint_theme = '{theme}'")
    if p.group_by:
        sql += f" GROUP BY {t}.{p.group_by}"
    return sql + ";"


#: Rows that a statement's result may have: diagnostics are aggregates of a few.
MAX_RESULT_ROWS = 10_000


def _error_row(spark: SparkSession, message: str) -> DataFrame:
    return spark.createDataFrame([(message,)], "Error string")


def run_sql(spark: SparkSession, sql: str, max_rows: int = MAX_RESULT_ROWS) -> DataFrame:
    """Run one query over the registered tables; any failure becomes an Error row (op E9).

    The text stands in a subquery, so that nothing but a query can run: a
    command, a second statement or the sentinel is a parse error. A join
    without an equality between its sides is refused before anything runs, and
    a result of more than ``max_rows`` rows is an Error row, not a part of it.
    The result is materialised into the checkpoint folder so that runtime
    errors surface here as well.
    """
    try:
        parse_query(spark, sql or "")
        result = spark.sql(wrapped(sql))
        if joins_without_equality(plan_tree(result._jdf.queryExecution().optimizedPlan())):
            return _error_row(spark, "refused: a join without an equality between its sides")
        result = reliable_checkpoint(result.limit(max_rows + 1))
        if result.count() > max_rows:
            return _error_row(spark, f"refused: more than {max_rows} result rows")
        return result
    except Exception as e:  # noqa: BLE001 - parse, analysis and runtime errors alike
        lines = str(e).strip().splitlines()
        return _error_row(spark, lines[0] if lines else type(e).__name__)


def run_replies(spark: SparkSession, replies: DataFrame) -> DataFrame:
    """(complaint_theme, keeps_contract, broken_rules, failed, result_rows) of
    each theme's reply: statement extracted, checked and, if it keeps the
    contract, run (ops E8 + E10 + E9).

    A statement that breaks a rule is not run: it failed, with one Error row.
    One reply a theme, so the loop is bounded by the taxonomy.
    """
    statements = replies.select("complaint_theme", extract_sql("reply").alias("statement"))
    rows = []
    for r in statement_contract(statements).collect():
        broken = ",".join(c for c in CHECKS if not r[c])
        result = run_sql(spark, r["statement"]) if r["ok"] else _error_row(spark, f"breaks the contract: {broken}")
        rows.append((r["complaint_theme"], r["ok"], broken, result.columns == ["Error"], result.count()))
    return spark.createDataFrame(rows, "complaint_theme string, keeps_contract boolean, broken_rules string, failed boolean, "
                                       "result_rows long")


# ---------------------------------------------------------------- contracts

def result_contract(result: DataFrame, plan: DiagnosticPlan) -> list[tuple[str, str, bool]]:
    """Check a diagnostic result schema against its sources (op E10).

    Rules: an aggregate of a unit-suffixed column keeps the suffix in its alias;
    the result is not grouped by an id column; measures (suffixed columns) are
    aggregated with AVG/SUM/COUNT only, never COUNT DISTINCT.
    """
    return result_contract_of_columns(result.columns, plan)


def result_contract_of_columns(columns, plan: DiagnosticPlan) -> list[tuple[str, str, bool]]:
    cols = set(columns)
    source_cols = set(TABLE_SCHEMAS[plan.target].fieldNames()) | set(TABLE_SCHEMAS["customer_support"].fieldNames())
    out = []
    for m in plan.metrics:
        suffix = next((s for s in UNIT_SUFFIXES if m.column.endswith(s)), None)
        present = m.alias in cols and m.column in source_cols
        out.append((m.alias, "unit_suffix_kept", present and (suffix is None or m.alias.endswith(suffix))))
        out.append((m.alias, "allowed_aggregate", m.agg in ("avg", "sum", "count")))
    if plan.group_by:
        out.append((plan.group_by, "no_id_grouping", plan.group_by not in ID_COLUMNS and plan.group_by in cols))
    return out
