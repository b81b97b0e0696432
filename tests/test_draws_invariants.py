"""Draws without a sort of the table, and the ledger check that shuffles users, not rows."""

import random

import pytest
from pyspark.sql import functions as F

from rootcause.functions.uniform import uniform
from rootcause.operators import cohorts as G
from rootcause.operators import quality as Q


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("n, k, rank_rows", [(50, 200, 64), (3000, 40, 4), (3000, 5000, 4), (1, 3, 64)])
def test_draws_pick_the_rows_of_the_sorted_order(spark, monkeypatch, n, k, rank_rows):
    monkeypatch.setattr(G, "RANK_ROWS", rank_rows)
    df = spark.range(n).select((F.col("id") * 3 + 1).alias("user_id"), F.concat(F.lit("v"), F.col("id")).alias("_place")).repartition(4)
    scored = df.select("user_id", uniform("user_id", "s").alias("u")).collect()
    order = [r["user_id"] for r in sorted(scored, key=lambda r: (r["u"], r["user_id"]))]
    at = {r["id"]: int(r["u"] * n) for r in spark.range(k).select("id", uniform("id", "s").alias("u")).collect()}
    got = G.sample_with_replacement(df.select("user_id", F.lit(7).alias("v")), "user_id", k, "s").collect()
    assert sorted((r["draw_id"], r["user_id"], r["v"]) for r in got) == [(i, order[at[i]], 7) for i in range(k)]


def test_draws_from_nothing(spark):
    df = spark.range(5).withColumnRenamed("id", "user_id")
    for out in (G.sample_with_replacement(df.limit(0), "user_id", 3, "s"), G.sample_with_replacement(df, "user_id", 0, "s")):
        assert out.count() == 0 and out.columns == ["draw_id", "user_id"]


def test_the_table_is_not_range_partitioned(spark, monkeypatch):
    df = spark.range(100_000).withColumnRenamed("id", "user_id")
    few = plan_of(G.sample_with_replacement(df, "user_id", 10, "s"))
    assert "rangepartitioning" not in few.lower() and "LeftSemi" in few
    many = plan_of(G.sample_with_replacement(df, "user_id", 100_000, "s"))
    assert "rangepartitioning" not in many.lower() and "LeftSemi" not in many


def brute(ledger, users, tol):
    totals = {u: t for u, t in users}
    seen = {u for u, _ in ledger if u in totals}
    hit = {u for u, b in ledger if u in totals and b is not None and totals[u] is not None and abs(b - totals[u]) < tol}
    return sorted(seen - hit)


@pytest.mark.parametrize("bound", [16_000_000, 0])
def test_final_balance_against_brute_force(spark, monkeypatch, bound):
    from rootcause.operators import keyfilter
    monkeypatch.setattr(keyfilter, "MAX_KEYS", bound)
    rnd = random.Random(4)
    users = [(u, rnd.choice([None, round(rnd.uniform(-50, 50), 2), 0.0, 1e9 + 0.01])) for u in range(1, 120)]
    ledger = [(1, round(rnd.uniform(-50, 50), 2)) for _ in range(3000)]
    for u, total in users:
        for _ in range(rnd.randrange(4)):
            near = None if total is None else total + rnd.choice([0.0, 0.004, -0.004, 0.005, 0.006, 0.011, -0.02])
            ledger.append((u, rnd.choice([near, near, None, rnd.uniform(-99, 99)])))
    ledger += [(999, 1.0), (None, 2.0)]
    ldf = spark.createDataFrame(ledger, "user_id long, balance_after_txn double").repartition(5)
    udf = spark.createDataFrame(users, "user_id long, total_ledger_balance double")
    got = sorted(r["user_id"] for r in Q._users_without_final_balance(ldf, udf, 0.005).collect())
    assert got == brute(ledger, users, 0.005)


def test_a_hot_user_is_a_few_rows_at_the_shuffle(spark):
    n = 200_000
    ledger = spark.range(n).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500).alias("user_id"),
                                   (F.col("id") * 1.37).alias("balance_after_txn")).repartition(8)
    users = spark.range(500).select(F.col("id").alias("user_id"), (F.col("id") * 2.0).alias("total_ledger_balance"))
    df = Q._users_without_final_balance(ledger, users, 0.005)
    plan = plan_of(df)
    assert plan.count("_key") and plan.count("balance_after_txn") and plan.count("Range (0, 200000") == 1
    windows = Q._windows(users, 0.005)
    assert windows.groupBy("user_id").count().agg(F.max("count")).first()[0] <= Q._WINDOW_BUCKETS
    rows = ledger.selectExpr("user_id", f"{Q._bucket('balance_after_txn')} AS _b").withColumn("_key", F.xxhash64("user_id", "_b"))
    passed = Q.flag_matches(rows, "_key", windows, 500 * Q._WINDOW_BUCKETS, "m").where("m").count()
    assert passed < 0.1 * n


def test_activity_of_approved_users_is_not_shuffled(spark, tables):
    plan = plan_of(Q.telemetry_invariants(tables))
    assert plan.count("BroadcastHashJoin [_page") >= 4 and "rangepartitioning" not in plan.lower()
