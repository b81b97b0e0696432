from pyspark.sql import functions as F

from rootcause.operators import diagnose as D
from rootcause.operators import insight as IN
from rootcause.plans.diagnostics import PLANS
from rootcause.schemas import TABLE_SCHEMAS
from tests.conftest import rows


def _tables(spark, users, trades=(), support=(), perf=(), ledger=()):
    mk = lambda name, data: spark.createDataFrame(list(data), TABLE_SCHEMAS[name])
    return {"users": mk("users", users), "trades": mk("trades", trades),
            "customer_support": mk("customer_support", support), "app_performance": mk("app_performance", perf),
            "financial_ledger": mk("financial_ledger", ledger)}


def test_inner_join_keeps_healthy_rows_and_repeats(spark):
    users = [(1, "APPROVED", 1.0, 0.0, 0.0, "CLEARED"), (2, "APPROVED", 1.0, 0.0, 0.0, "CLEARED")]
    trades = [(10, 1, "BUY_MARKET", 100.0, 101.0, -100.0, 200.0, "NONE"),
              (11, 1, "BUY_LIMIT", 100.0, 100.0, 0.0, 100.0, "NONE"),
              (12, 2, "SELL_LIMIT", 100.0, 100.0, 0.0, 50.0, "NONE")]
    # user 1 holds two slippage tickets: rows multiply as in SQL
    support = [(1, 1, "EXECUTION_SLIPPAGE", 1.0, 1), (2, 1, "EXECUTION_SLIPPAGE", 1.0, 1),
               (3, 2, "LEDGER_DISPUTE", 1.0, 1)]
    T = _tables(spark, users, trades, support)
    r = D.diagnose(T, "EXECUTION_SLIPPAGE").first()
    assert r["avg_price_slippage_bps"] == -50.0
    assert r["avg_order_routing_latency_ms"] == 150.0


def test_empty_cohort_global_one_null_row_keyed_no_rows(spark):
    users = [(1, "APPROVED", 1.0, 0.0, 0.0, "CLEARED")]
    T = _tables(spark, users)
    g = D.diagnose(T, "SYSTEM_STABILITY").collect()
    assert len(g) == 1 and g[0]["avg_api_5xx_error_rate_pct"] is None
    assert D.diagnose(T, "LOGIN_AND_2FA_ISSUE").count() == 0
    long = D.diagnose_long(T)
    glob = long.where(F.col("complaint_theme") == "SYSTEM_STABILITY").collect()
    assert len(glob) == 2 and all(r["value"] is None and r["n"] == 0 for r in glob)
    assert long.where(F.col("complaint_theme") == "LOGIN_AND_2FA_ISSUE").count() == 0


def test_long_equals_wide_for_every_theme(spark, tables):
    long = {(r["complaint_theme"], r["group_key"], r["metric"]): r["value"] for r in D.diagnose_long(tables).collect()}
    for theme, plan in PLANS.items():
        for r in D.diagnose(tables, theme).collect():
            key = r[plan.group_by] if plan.group_by else None
            for m in plan.metrics:
                assert long[(theme, key, m.alias)] == (float(r[m.alias]) if r[m.alias] is not None else None)


def test_partition_invariance(spark, tables):
    spread = {k: v.repartition(7) for k, v in tables.items()}
    single = {k: v.repartition(1) for k, v in tables.items()}
    assert rows(D.diagnose_long(spread)) == rows(D.diagnose_long(single))
    assert rows(IN.metrics_to_text(D.diagnose_long(spread))) == rows(IN.metrics_to_text(D.diagnose_long(single)))


def test_run_sql_success_and_errors(spark, tables):
    D.load_tables(spark, tables)
    ok = D.run_sql(spark, D.plan_sql("LEDGER_DISPUTE"))
    assert rows(ok) == rows(D.diagnose(tables, "LEDGER_DISPUTE"))
    for bad in ["ERROR_GENERATING_SQL", "SELECT * FROM no_such_table", "SELECT 1/0 AS x", None, "",
                "CREATE TEMP VIEW made AS SELECT 1 AS x", "DROP VIEW users", "SELECT 1; SELECT 2", "SHOW TABLES"]:
        err = D.run_sql(spark, bad)
        assert err.columns == ["Error"] and err.count() == 1


def test_result_contract(spark, tables):
    for theme, plan in PLANS.items():
        assert all(ok for _, _, ok in D.result_contract(D.diagnose(tables, theme), plan))
    bad = D.diagnose(tables, "EXECUTION_SLIPPAGE").withColumnRenamed("avg_order_routing_latency_ms", "avg_latency")
    checks = D.result_contract(bad, PLANS["EXECUTION_SLIPPAGE"])
    assert not all(ok for _, _, ok in checks)


def test_worst_row_and_summary_contract(spark, tables):
    long = D.diagnose_long(tables)
    worst = {r["complaint_theme"]: r for r in IN.worst_row(long).collect()}
    ledger = D.diagnose(tables, "LEDGER_DISPUTE").orderBy("avg_balance_after_txn", "txn_type").first()
    assert worst["LEDGER_DISPUTE"]["group_key"] == ledger["txn_type"]
    summaries = IN.summarise(long)
    assert all(r["ok"] for r in IN.summary_contract(summaries).collect())
    good = summaries.first()["summary"]
    cases = [("chatter", good + "\nHope this helps!"), ("no owner", good.replace("**Product**", "**Sales**")),
             ("four", good.replace("Act on", "More. And more. Act on")), ("percent", good.replace("Act on", "A 14% bps move, act on")),
             ("fine", good.replace("Act on this cohort", "With 14 bps and 3% lost, act on this cohort"))]
    got = {r["complaint_theme"]: r["ok"] for r in IN.summary_contract(
        spark.createDataFrame(cases, "complaint_theme string, summary string")).collect()}
    assert got == {"chatter": False, "no owner": False, "four": False, "percent": False, "fine": True}
    bad = spark.createDataFrame([("X", "Preamble\n### 📊 AI Product Recommendation\n- a\n- b\nslip 14% bps")],
                                "complaint_theme string, summary string")
    r = IN.summary_contract(bad).first()
    assert not r["has_heading"] and r["bullet_count"] == 2 and not r["bps_not_percent"] and not r["ok"]


def test_summarise_with_model_and_failure(spark, tables):
    import pandas as pd
    long = D.diagnose_long(tables, ["EXECUTION_SLIPPAGE"])

    def echo(req: pd.Series) -> pd.Series:
        return req.map(lambda s: "### 📊 AI Product Recommendation\n" + s.splitlines()[0])

    def broken(req: pd.Series) -> pd.Series:
        raise RuntimeError("model down")

    assert "EXECUTION_SLIPPAGE" in IN.summarise(long, echo).first()["summary"]
    assert IN.summarise(long, broken).first()["summary"].startswith("Error generating insight: model down")


def test_strategies_agree(spark, tables):
    want = rows(D.diagnose_long(tables, strategy="rows"))
    assert rows(D.diagnose_long(tables, strategy="pre_aggregate")) == want
    assert rows(D.diagnose_long(tables, strategy="broadcast")) == want
    assert rows(D.diagnose_long(tables)) == want


def test_broadcast_bound_is_checked(spark, tables):
    assert D.cohort_fits_broadcast(tables["customer_support"], ["GENERAL_INQUIRY"])
    assert not D.cohort_fits_broadcast(tables["customer_support"], ["GENERAL_INQUIRY"], max_rows=3)


def test_pre_aggregation_with_repeated_tickets_and_hot_user(spark):
    users = [(u, "APPROVED", 1.5, 0.0, 0.0, "CLEARED") for u in range(1, 4)]
    perf = [(i, 1 if i < 90 else 2, "iOS", 0, float(i % 13) + 0.25, float(i % 5), 1, float(i % 7) * 1.1, i % 3)
            for i in range(100)]
    support = [(1, 1, "SYSTEM_STABILITY", 1.5, 1), (2, 1, "SYSTEM_STABILITY", 2.5, 2),
               (3, 2, "CHARTING_UI_GLITCH", 3.5, 1), (4, 3, "GENERAL_INQUIRY", 4.5, 3),
               (5, 3, "GENERAL_INQUIRY", 0.5, 1), (6, 2, "LOGIN_AND_2FA_ISSUE", 1.0, 1)]
    T = _tables(spark, users, perf=perf, support=support)
    assert rows(D.diagnose_long(T, strategy="pre_aggregate")) == rows(D.diagnose_long(T, strategy="rows"))
    r = D.diagnose(T, "SYSTEM_STABILITY").first()
    long = {x["metric"]: x["value"] for x in D.diagnose_long(T, ["SYSTEM_STABILITY"]).collect()}
    assert long["avg_api_5xx_error_rate_pct"] == r["avg_api_5xx_error_rate_pct"]


def test_single_theme_strategies_agree(spark, tables):
    for theme in D.PLANS:
        want = D.diagnose(tables, theme, strategy="rows")
        for strategy in ("auto", "broadcast", "pre_aggregate"):
            got = D.diagnose(tables, theme, strategy=strategy)
            assert got.columns == want.columns, (theme, strategy)
            assert rows(got) == rows(want), (theme, strategy)


def test_worst_row_skips_missing_values_and_the_healthy_group(spark):
    users = [(1, "APPROVED", 1.0, 0.0, 0.0, "CLEARED"), (2, "APPROVED", 1.0, 0.0, 0.0, "CLEARED"),
             (3, "APPROVED", 1.0, 0.0, 0.0, "2FA/OTP_NOT_RECEIVED")]
    ledger = [(1, 1, "DEPOSIT", 1.0, None, 1.0, 1.0, 1), (2, 2, "WITHDRAWAL", 1.0, -20000.0, 1.0, 1.0, 1)]
    support = [(i, i, "LOGIN_AND_2FA_ISSUE", 1.0, 1) for i in (1, 2, 3)] + [(10 + i, i, "LEDGER_DISPUTE", 1.0, 1) for i in (1, 2)]
    worst = {r["complaint_theme"]: r for r in IN.worst_row(D.diagnose_long(_tables(spark, users, support=support, ledger=ledger))).collect()}
    assert worst["LEDGER_DISPUTE"]["group_key"] == "WITHDRAWAL" and worst["LEDGER_DISPUTE"]["severity_display"] == "-20000.00"
    assert worst["LOGIN_AND_2FA_ISSUE"]["group_key"] == "2FA/OTP_NOT_RECEIVED"


def test_sums_on_all_strategies_and_beyond_64_bits(spark, monkeypatch):
    import pytest
    from rootcause.plans.diagnostics import DiagnosticPlan, Metric
    plan = DiagnosticPlan("EXECUTION_SLIPPAGE", "trades", None,
                          (Metric("sum_price_slippage_bps", "sum", "price_slippage_bps"),
                           Metric("avg_price_slippage_bps", "avg", "price_slippage_bps")), "avg_price_slippage_bps", False)
    monkeypatch.setitem(PLANS, "EXECUTION_SLIPPAGE", plan)
    users = [(1, "APPROVED", 1.0, 0.0, 0.0, "CLEARED")]
    trades = [(i, 1, "BUY_MARKET", 1.0, 1.0, 3e16, 1.0, "NONE") for i in range(40)]
    T = _tables(spark, users, trades, [(1, 1, "EXECUTION_SLIPPAGE", 1.0, 1)])
    for strategy in ("rows", "broadcast", "pre_aggregate"):
        assert tuple(D.diagnose(T, "EXECUTION_SLIPPAGE", strategy).first()) == (1.2e18, 3e16)
        long = D.diagnose_long(T, ["EXECUTION_SLIPPAGE"], strategy)
        assert {r["metric"]: r["value"] for r in long.collect()} == {"sum_price_slippage_bps": 1.2e18, "avg_price_slippage_bps": 3e16}
        assert {r["metric"]: r["display"] for r in IN.with_display(long).collect()} == {
            "sum_price_slippage_bps": "1200000000000000000.00 bps", "avg_price_slippage_bps": "30000000000000000.00 bps"}
    with pytest.raises(ValueError):
        Metric("x", "median", "price_slippage_bps")


def test_statement_contract(spark):
    ok = "SELECT users.auth_bottleneck, AVG(users.kyc_processing_age_days) AS avg_age_days FROM users GROUP BY users.auth_bottleneck;"
    cases = {
        ok: set(),
        ok.replace("avg_age_days", "avg_age"): {"unit_suffix_kept"},
        ok.replace("GROUP BY users.auth_bottleneck", "GROUP BY users.user_id"): {"no_id_grouping"},
        ok.replace("AVG(users", "COUNT(DISTINCT users"): {"no_count_distinct"},
        ok.replace("AVG(", "MEDIAN("): {"allowed_aggregates"},
        ok.replace("AVG(users.", "AVG("): {"qualified_columns"},
        "SELECT 1 AS x": {"has_aggregate"},
        "DROP TABLE users": {"is_query", "has_aggregate"},
        "SELECT COUNT(users.user_id) AS n FROM users; DROP TABLE users": {"is_query"},
    }
    df = spark.createDataFrame([(s,) for s in cases], "statement string")
    for r in D.statement_contract(df).collect():
        failed = {k for k, v in r.asDict().items() if v is False and k != "ok"}
        assert failed == cases[r["statement"]] and r["ok"] == (not failed), (r["statement"], failed)


def test_zero_prices_are_counted_and_empty_trades_are_zero(spark):
    from rootcause.operators import quality as Q
    users = [(1, "APPROVED", 1.0, 0.0, 0.0, "CLEARED")]
    trades = [(1, 1, "BUY_MARKET", 0.0, 1.0, 0.0, 1.0, "NONE"), (2, 1, "BUY_MARKET", 1.0, 1.0, 0.0, 1.0, "NONE")]
    got = {r["rule"]: r["violations"] for r in Q.telemetry_invariants(_tables(spark, users, trades)).collect()}
    assert got["price_bps_agreement"] == 1
    none = {r["rule"]: r["violations"] for r in Q.telemetry_invariants(_tables(spark, users)).collect()}
    assert none["slippage_sign"] == none["price_bps_agreement"] == none["timeout_code_override"] == 0


def test_one_failing_request_costs_one_summary(spark, tables):
    import pandas as pd

    def model(req: pd.Series) -> pd.Series:
        if req.str.contains("LEDGER_DISPUTE").any():
            raise RuntimeError("model down")
        return req.map(lambda s: "fine")

    got = {r["complaint_theme"]: r["summary"] for r in IN.summarise(D.diagnose_long(tables).coalesce(1), model).collect()}
    assert got.pop("LEDGER_DISPUTE").startswith("Error generating insight: model down") and set(got.values()) == {"fine"}
