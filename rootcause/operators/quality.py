"""Data-quality checks (ops A6, G12).

Declared keys are not enforced by the storage, so they are checked here: a
primary-key check is a grouped count, a foreign-key check a match against the
parent's keys. The telemetry invariants of the generator (cohort isolation,
slippage sign, price and bps agreement, rejection override, final balance)
are checked the same way. Every check is one aggregate row (rule,
violations); nothing is collected to the driver.

Plans: child rows are counted per key (one count column per child table,
partial aggregation in the map tasks, so a hot key is one row at the join)
and only then matched against the other side's distinct keys. The match is an
aggregate followed by an outer join on purpose: written as a semi or anti
join, the optimizer pushes the join back below the aggregate. Each check set
is emitted as one SQL text over the bound tables, which builds the plan in a
few driver round trips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootcause.operators.keyfilter import flag_matches, might_match
from rootcause.schemas import FOREIGN_KEYS, PRIMARY_KEYS
from rootcause.themes import TIMEOUT_CODE, TIMEOUT_LATENCY_MS

RULE_SCHEMA = "table_name string, rule string, violations long"

# Width of the join buckets of the final-balance check, in currency units.
_BUCKET = 0.01
_KYC_THEME = "KYC_ONBOARDING_EFFICIENCY"


def _run(tables: dict[str, DataFrame], parts: list[str]) -> DataFrame:
    names = {n: df for n, df in tables.items() if "{" + n + "}" in "".join(parts)}
    spark = next(iter(names.values())).sparkSession
    return spark.sql("\nUNION ALL\n".join(parts), **names)


def _counts_sql(tagged: str, key: str, tables: list[str]) -> str:
    """One row per key with the number of rows of each table (``_n0``...)."""
    cols = ", ".join(f"count(CASE WHEN table_name = '{t}' THEN 1 END) AS _n{i}" for i, t in enumerate(tables))
    return f"SELECT {key}, {cols} FROM ({tagged}) x GROUP BY {key}"


def _match_sql(counts: str, keys: str, key: str, matched: bool) -> str:
    """Rows of ``counts`` whose key is (``matched``) or is not among ``keys``."""
    return (f"SELECT c.* FROM ({counts}) c LEFT JOIN (SELECT DISTINCT {key}, true AS _hit FROM ({keys}) k "
            f"WHERE {key} IS NOT NULL) p ON c.{key} = p.{key} "
            f"WHERE p._hit IS {'NOT NULL' if matched else 'NULL'}")


def _per_table_sql(rows: str, tables: list[str], rule: str) -> str:
    """Sum the per-table counts into one (table_name, rule, violations) row each."""
    sums = ", ".join(f"CAST(coalesce(sum(_n{i}), 0) AS BIGINT) AS _n{i}" for i in range(len(tables)))
    pairs = ", ".join(f"'{t}', _n{i}" for i, t in enumerate(tables))
    return (f"SELECT table_name, '{rule}' AS rule, violations FROM (SELECT stack({len(tables)}, {pairs}) "
            f"AS (table_name, violations) FROM (SELECT {sums} FROM ({rows}) r) s) st")


def constraint_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Duplicate primary keys and dangling foreign keys per table (op A6).

    PK: number of key values held by more than one row (null keys count as
    violations too). FK: child rows with a non-null user_id absent from users.
    Children that reference the same parent are checked together, so the
    parent is read and shuffled once.
    """
    parts = [f"SELECT '{t}' AS table_name, 'pk_unique:{pk}' AS rule, "
             f"CAST(coalesce(sum(CASE WHEN _n > 1 OR _k IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations "
             f"FROM (SELECT {pk} AS _k, count(1) AS _n FROM {{{t}}} GROUP BY {pk}) g"
             for t, pk in PRIMARY_KEYS.items()]
    by_parent: dict[tuple, list[str]] = {}
    for t, ref in FOREIGN_KEYS.items():
        by_parent.setdefault(ref, []).append(t)
    for (fk, parent, pkey), children in by_parent.items():
        tagged = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {fk} AS _k FROM {{{t}}} WHERE {fk} IS NOT NULL"
                                    for t in children)
        dangling = _match_sql(_counts_sql(tagged, "_k", children), f"SELECT {pkey} AS _k FROM {{{parent}}}",
                              "_k", matched=False)
        parts.append(_per_table_sql(dangling, children, f"fk:{fk}->{parent}.{pkey}"))
    return _run(tables, parts)


def _bucket(c: str) -> str:
    return f"CAST(floor(({c}) / CAST({_BUCKET!r} AS DOUBLE)) AS BIGINT)"


def _windows(users: DataFrame, tol: float) -> DataFrame:
    """(user_id, total_ledger_balance, _b, _key): the buckets that a balance
    within ``tol`` of the user's total can lie in, with a spare one on each side."""
    t = f"CAST({tol!r} AS DOUBLE)"
    return (users.where("total_ledger_balance IS NOT NULL").selectExpr(
        "user_id", "total_ledger_balance", f"explode(sequence({_bucket(f'total_ledger_balance - {t}')} - 1, "
        f"{_bucket(f'total_ledger_balance + {t}')} + 1)) AS _b").withColumn("_key", F.xxhash64("user_id", "_b")))


#: Buckets of one user at most.
_WINDOW_BUCKETS = 5


def _users_without_final_balance(ledger: DataFrame, users: DataFrame, tol: float, n_users: int | None = None) -> DataFrame:
    """Users with ledger rows none of which lies within ``tol`` of their
    total_ledger_balance (one row per such user).

    The ledger is read once. Rows whose (user, cent bucket) cannot be one of
    a user's windows, by a Bloom filter of those, collapse to one row a user in
    each map task; the few others go on as distinct balances. So what is
    shuffled grows with the users, not with the ledger, and a hot user is a few
    rows a task. The equi-join on (user, bucket) and the exact
    |balance - total| < tol test come after it.
    """
    n_users = users.count() if n_users is None else n_users
    windows = _windows(users, tol)
    rows = ledger.selectExpr("user_id", f"{_bucket('balance_after_txn')} AS _b", "balance_after_txn AS _bal").withColumn(
        "_key", F.when(F.col("_b").isNotNull(), F.xxhash64("user_id", "_b")))
    flagged = flag_matches(rows, "_key", windows, n_users * _WINDOW_BUCKETS, "_maybe")
    seen = flagged.groupBy("user_id", F.when(F.col("_maybe"), F.col("_b")).alias("_b"),
                           F.when(F.col("_maybe"), F.col("_bal")).alias("_bal")).agg(F.count(F.lit(1)).alias("_rows"))
    near = F.coalesce(F.abs(F.col("_bal") - F.col("total_ledger_balance")) < F.lit(tol), F.lit(False))
    hit = (seen.join(windows.select("user_id", "_b", "total_ledger_balance"), ["user_id", "_b"], "left")
           .groupBy("user_id").agg(F.max(near).alias("_hit")))
    return hit.where(~F.col("_hit")).join(users.select("user_id").distinct(), "user_id").select("user_id")


def telemetry_invariants(tables: dict[str, DataFrame], tolerance: float = 1e-6) -> DataFrame:
    """Counts of rows breaking the generator's invariants (op G12).

    - KYC-defective users (kyc_status <> APPROVED) have no trades, ledger or
      session rows, and hold no ticket of another theme;
    - market orders never show positive slippage, limit orders never negative;
    - stored bps agrees with the requested/executed prices (a requested price
      of 0 has no slippage and counts as a violation);
    - latency above the timeout always carries the timeout code;
    - a user's total_ledger_balance equals one of their balance_after_txn
      (the ledger's time order is not stored, so only membership is checked).
    Adapter data breaks some of these by construction: compare counts.
    """
    activity = ["trades", "financial_ledger", "app_performance"]
    n_users = tables["users"].count()
    # Only rows of users that may be defective are counted per user and shuffled.
    suspects = tables["users"].where("kyc_status <> 'APPROVED'").select("user_id")
    tables = tables | {f"of_{n}": might_match(tables[n].select("user_id"), "user_id", suspects, n_users) for n in activity}
    tables["without_final"] = _users_without_final_balance(tables["financial_ledger"], tables["users"], 0.005, n_users)
    tagged = " UNION ALL ".join(f"SELECT '{n}' AS table_name, user_id FROM {{of_{n}}}" for n in activity)
    defective = "SELECT user_id FROM {users} WHERE kyc_status <> 'APPROVED'"
    parts = [_per_table_sql(_match_sql(_counts_sql(tagged, "user_id", activity), defective, "user_id", True),
                            activity, "kyc_user_has_activity")]
    other = (f"SELECT 'customer_support' AS table_name, user_id FROM {{customer_support}} "
             f"WHERE complaint_theme <> '{_KYC_THEME}'")
    kyc = f"SELECT user_id FROM {{customer_support}} WHERE complaint_theme = '{_KYC_THEME}'"
    parts.append(_per_table_sql(_match_sql(_counts_sql(other, "user_id", ["customer_support"]), kyc, "user_id", True),
                                ["customer_support"], "kyc_cohort_overlaps_other_theme"))
    # The three trade rules share one pass over trades (slippage as in
    # functions.finance.slippage_bps).
    market = "endswith(order_type, 'MARKET')"
    side = "(CASE WHEN contains(order_type, 'BUY') THEN 1 ELSE -1 END)"
    recomputed = f"try_divide((-{side}) * (executed_price - requested_price), requested_price) * CAST(10000.0 AS DOUBLE)"
    rules = (f"CAST(coalesce(sum(CASE WHEN ({market} AND price_slippage_bps > 0) OR (NOT {market} AND price_slippage_bps < 0) "
             f"THEN 1 ELSE 0 END), 0) AS BIGINT) AS a, "
             f"CAST(coalesce(sum(CASE WHEN requested_price = 0 OR abs({recomputed} - price_slippage_bps) > "
             f"CAST({tolerance!r} AS DOUBLE) THEN 1 ELSE 0 END), 0) AS BIGINT) AS b, "
             f"CAST(coalesce(sum(CASE WHEN order_routing_latency_ms > {TIMEOUT_LATENCY_MS} AND "
             f"exchange_rejection_code <> '{TIMEOUT_CODE}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS c")
    parts.append("SELECT 'trades' AS table_name, rule, violations FROM (SELECT stack(3, 'slippage_sign', a, "
                 "'price_bps_agreement', b, 'timeout_code_override', c) AS (rule, violations) "
                 f"FROM (SELECT {rules} FROM {{trades}}) t) s")
    parts.append(f"SELECT 'users' AS table_name, 'final_balance_in_ledger' AS rule, "
                 f"CAST(count(1) AS BIGINT) AS violations FROM {{without_final}} f")
    return _run(tables, parts)
