"""Statement contract on Spark's plans, and what the runner refuses."""

import pytest

from rootcause.operators import diagnose as D
from rootcause.operators.statements import check_statement

JOINED = "FROM trades JOIN customer_support ON customer_support.user_id = trades.user_id WHERE customer_support.complaint_theme = 'EXECUTION_SLIPPAGE'"
SOUND = [
    f"SELECT COUNT(*) AS n {JOINED}",
    f"SELECT AVG(trades.price_slippage_bps) AS avg_slippage_bps, AVG(trades.order_routing_latency_ms) AS avg_latency_ms {JOINED};",
    f"select avg(cast(trades.order_routing_latency_ms as double)) as y_ms {JOINED}",
    # the tables as comma list, the equality in WHERE
    "SELECT AVG(trades.price_slippage_bps) AS a_bps FROM trades, customer_support WHERE customer_support.user_id = trades.user_id",
    # an alias of the table, an output's name in ORDER BY and HAVING, a group by ordinal
    "SELECT l.txn_type, COUNT(l.txn_id) AS n FROM financial_ledger l GROUP BY l.txn_type HAVING n > 3 ORDER BY n DESC",
    "SELECT users.auth_bottleneck, COUNT(users.user_id) AS n FROM users GROUP BY 1 ORDER BY auth_bottleneck",
    "SELECT users.auth_bottleneck AS why, COUNT(*) AS n FROM users GROUP BY why",
    # a condition on a measure leaves no unit in a count
    "SELECT SUM(CASE WHEN trades.order_routing_latency_ms > 5000 THEN 1 ELSE 0 END) AS slow_orders FROM trades",
    # a WITH, a nested query, two units in one output
    "WITH t AS (SELECT trades.price_slippage_bps AS p_bps FROM trades) SELECT AVG(t.p_bps) AS p_bps FROM t",
    "SELECT SUM(s.x_ms) AS x_ms FROM (SELECT trades.order_routing_latency_ms AS x_ms FROM trades) s",
    "SELECT AVG(trades.price_slippage_bps / trades.order_routing_latency_ms) AS bps_per_ms_bps FROM trades",
    "SELECT AVG(users.margin_balance) AS m FROM users WHERE users.user_id IN (SELECT trades.user_id FROM trades)",
]
BROKEN = {
    # the four probes
    f"SELECT AVG(trades.price_slippage_bps) AS a_bps, MAX(trades.price_slippage_bps * 2) AS m_bps {JOINED}": {"allowed_aggregates"},
    f"SELECT AVG(CAST(trades.order_routing_latency_ms AS DOUBLE)) AS y {JOINED}": {"unit_suffix_kept"},
    "SELECT COUNT(DISTINCT trades.order_routing_latency_ms, trades.price_slippage_bps) AS n_ms_bps FROM trades": {"no_count_distinct"},
    "SELECT users.user_id, COUNT(*) AS n FROM users GROUP BY 1": {"no_id_grouping"},
    # ids under another name, through a cast, in a nested query, by DISTINCT
    "SELECT users.user_id AS who, COUNT(*) AS n FROM users GROUP BY who": {"no_id_grouping"},
    "SELECT CAST(users.user_id AS STRING) AS u, COUNT(*) AS n FROM users GROUP BY CAST(users.user_id AS STRING)": {"no_id_grouping"},
    "SELECT AVG(t.n) AS n FROM (SELECT COUNT(*) AS n FROM trades GROUP BY trades.user_id) t": {"no_id_grouping"},
    "SELECT COUNT(*) AS n FROM (SELECT DISTINCT trades.order_id FROM trades) t": {"no_id_grouping"},
    # units lost on the way up, under an expression, or in an unnamed output
    "SELECT AVG(s.x) AS x FROM (SELECT trades.order_routing_latency_ms AS x FROM trades) s": {"unit_suffix_kept"},
    "SELECT ROUND(AVG(trades.price_slippage_bps), 2) AS slippage FROM trades": {"unit_suffix_kept"},
    "SELECT AVG(trades.price_slippage_bps) FROM trades": {"unit_suffix_kept"},
    "SELECT AVG(trades.price_slippage_bps / trades.order_routing_latency_ms) AS ratio_ms FROM trades": {"unit_suffix_kept"},
    # other aggregates under any name
    "SELECT percentile_approx(trades.price_slippage_bps, 0.5) AS p_bps FROM trades": {"allowed_aggregates"},
    "SELECT approx_count_distinct(users.user_id) AS n FROM users": {"allowed_aggregates"},
    "SELECT SUM(DISTINCT trades.price_slippage_bps) AS s_bps FROM trades": {"no_count_distinct"},
    # names without a table
    "SELECT AVG(price_slippage_bps) AS a_bps FROM trades": {"qualified_columns"},
    "SELECT COUNT(*) AS n FROM trades WHERE order_type = 'BUY_MARKET'": {"qualified_columns"},
    "SELECT COUNT(*) AS n FROM trades JOIN users USING (user_id)": {"qualified_columns"},
    "SELECT COUNT(*) AS n FROM trades NATURAL JOIN users": {"qualified_columns"},
    # joins of everything with everything
    "SELECT COUNT(*) AS n FROM trades CROSS JOIN users": {"equality_joins"},
    "SELECT COUNT(*) AS n FROM trades, users": {"equality_joins"},
    "SELECT COUNT(*) AS n FROM trades JOIN users ON trades.user_id = trades.user_id": {"equality_joins"},
    "SELECT COUNT(*) AS n FROM trades JOIN users ON trades.user_id < users.user_id": {"equality_joins"},
    "SELECT COUNT(*) AS n FROM trades JOIN users ON trades.user_id = users.user_id OR trades.order_id = users.user_id": {"equality_joins"},
    # rows instead of aggregates, commands, nothing
    "SELECT trades.order_type FROM trades": {"has_aggregate"},
    "SELECT SUM(trades.requested_price) OVER () AS s FROM trades": {"has_aggregate"},
    "INSERT INTO users SELECT * FROM users": {"is_query", "has_aggregate"},
    "I cannot help with that.": {"is_query", "has_aggregate"},
    "": {"is_query", "has_aggregate"},
    "SELECT COUNT(*) AS n FROM users -- ; DROP TABLE users\n; DROP TABLE users": {"is_query"},
    # over an unknown table the names are judged
    "SELECT MAX(tickets.wait_ms) AS worst FROM tickets GROUP BY tickets.user_id": {"allowed_aggregates", "unit_suffix_kept", "no_id_grouping"},
}


@pytest.mark.parametrize("statement", SOUND)
def test_sound_statements_keep_the_contract(spark, statement):
    assert {k for k, ok in check_statement(spark, statement).items() if not ok} == set()


@pytest.mark.parametrize("statement", BROKEN)
def test_broken_rules_are_named(spark, statement):
    assert {k for k, ok in check_statement(spark, statement).items() if not ok} == BROKEN[statement]


def test_fixed_diagnostics_keep_the_contract(spark):
    from rootcause.plans.diagnostics import PLANS
    for theme in PLANS:
        assert all(check_statement(spark, D.plan_sql(theme)).values()), theme


def test_contract_of_a_table_keeps_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, SOUND[0]), (2, SOUND[0]), (3, None), (4, "SELECT 1 AS x")], "i int, statement string")
    got = {r["i"]: r["ok"] for r in D.statement_contract(df).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}
    assert D.statement_contract(df.limit(0)).count() == 0


def test_runner_refuses_cross_joins_and_large_results(spark, tables):
    D.load_tables(spark, tables)
    for text in ("SELECT COUNT(*) AS n FROM trades CROSS JOIN users", "SELECT trades.user_id FROM trades, users WHERE trades.user_id <> users.user_id"):
        r = D.run_sql(spark, text)
        assert r.columns == ["Error"] and "equality" in r.first()["Error"]
    n = tables["users"].count()
    assert D.run_sql(spark, "SELECT user_id FROM users", max_rows=n).count() == n
    refused = D.run_sql(spark, "SELECT user_id FROM users", max_rows=n - 1)
    assert refused.columns == ["Error"] and refused.count() == 1


def test_a_statement_that_breaks_a_rule_is_not_run(spark, tables):
    D.load_tables(spark, tables)
    hits = spark.sparkContext.accumulator(0)

    def told(x):
        hits.add(1)
        return x
    spark.udf.register("told", told, "long")
    replies = spark.createDataFrame([("A", "SELECT users.user_id, SUM(told(users.user_id)) AS s FROM users GROUP BY users.user_id"),
                                     ("B", "SELECT COUNT(users.user_id) AS n FROM users"), ("C", None)], "complaint_theme string, reply string")
    got = {r["complaint_theme"]: r for r in D.run_replies(spark, replies).collect()}
    assert hits.value == 0 and got["A"]["failed"] and not got["A"]["keeps_contract"] and "no_id_grouping" in got["A"]["broken_rules"]
    assert tuple(got["B"])[1:] == (True, "", False, 1) and got["C"]["failed"]
