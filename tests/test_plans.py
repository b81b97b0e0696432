"""Physical-plan properties the design relies on."""

import re

from rootcause.operators import cohorts as G
from rootcause.operators import curate as K
from rootcause.operators import diagnose as D
from rootcause.sources import adapters as A
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _read_schemas(plan: str) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


def test_diagnostic_scans_read_only_needed_columns(spark, tables):
    plan = _plan(D.diagnose(tables, "EXECUTION_SLIPPAGE"))
    lineitem = [s for s in _read_schemas(plan) if "l_orderkey" in s]
    assert lineitem and all("l_shipdate" not in s and "l_suppkey" not in s and "l_linenumber" not in s
                            for s in lineitem)
    customer = [s for s in _read_schemas(plan) if "c_custkey" in s]
    assert customer and all("c_name" not in s for s in customer)


def test_broadcast_only_behind_the_size_check(spark, tables):
    def hinted(df):
        return "strategy=broadcast" in df._jdf.queryExecution().optimizedPlan().toString()
    assert hinted(D.diagnose_long(tables, strategy="broadcast"))
    assert not hinted(D.diagnose_long(tables, strategy="pre_aggregate"))
    assert not hinted(D.diagnose_long(tables, strategy="rows"))
    assert D.cohort_fits_broadcast(tables["customer_support"], list(D.PLANS))
    assert hinted(D.diagnose_long(tables))


def test_pre_aggregation_happens_before_the_join_shuffle(spark, tables):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(D.diagnose_long(tables, ["EXECUTION_SLIPPAGE"], strategy="pre_aggregate"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # partial aggregate by user_id feeds the exchange on user_id
    assert re.search(r"Exchange hashpartitioning\(user_id#\d+L, \d+\)[^\n]*\n[ :|]*\+- \*\(\d+\) "
                     r"HashAggregate\(keys=\[user_id#\d+L\], functions=\[partial_", plan)


def test_group_limits_bound_strata(spark):
    feed = A.review_feed(spark, SF_SMALL)
    assert "WindowGroupLimit" in _plan(K.score_batches(feed))
    assert "WindowGroupLimit" in _plan(K.curate(feed))


def test_small_k_is_merged_in_two_levels(spark):
    df = spark.range(1000).withColumnRenamed("id", "user_id")
    plan = _plan(G.split_exact(df, "user_id", 10, "s")[0])
    assert "TakeOrderedAndProject" in plan and "WindowGroupLimit" in plan and "hashpartitioning(_group#" in plan


def test_hot_ledger_users_are_range_partitioned(spark):
    from pyspark.sql import functions as F
    from rootcause.operators import ledger as LG
    events = spark.range(400).select(
        F.when(F.col("id") < 300, 1).otherwise(F.col("id") % 7 + 2).cast("long").alias("user_id"),
        F.col("id").alias("txn_id"), F.lit("DEPOSIT").alias("txn_type"), F.lit(1.0).alias("amount"),
        F.col("id").alias("txn_ts"))
    starts = spark.range(1, 10).select(F.col("id").alias("user_id"), F.lit(0.0).alias("start_balance"))
    hot = LG._event_units(events.where("user_id = 1"), ["txn_ts"])
    assert LG._segments(hot, ["user_id", "txn_ts", "txn_id"], 6).select("_pid").distinct().count() >= 3
    rows = LG.replay_ledger(starts, events, ["txn_ts"], hot_rows=100, segment_rows=40).where("user_id = 1")
    assert sorted(r.txn_seq for r in rows.collect()) == list(range(1, 301))


def test_curation_ranks_narrow_keys_and_fetches_once(spark):
    feed = A.review_feed(spark, SF_SMALL)
    plan = _plan(K.curate(feed))
    assert "LeftSemi" in plan and "BroadcastExchange" in plan
    # the projection feeding the per-rating window exchange outputs no review
    # text (the text is only read to compute its length)
    proj = re.search(r"Exchange hashpartitioning\(score#\d+, \d+\).*?Project \[([^\n]*)\]", plan, re.S).group(1)
    assert "content" not in proj and "text#" not in re.sub(r"length\(text#\d+\)", "", proj)
    # a first level by group of partitions, so no task merges all partitions' candidates
    assert re.search(r"Exchange hashpartitioning\(score#\d+, _group#\d+", plan)


def test_no_task_merges_the_heads_of_all_partitions(spark):
    feed = A.review_feed(spark, SF_SMALL)
    for df in (K.head_n(feed, 10), K.score_filter(feed, 1, 5), K.union_score_batches(feed)):
        plan = _plan(df)
        assert "hashpartitioning(_group#" in plan and "WindowGroupLimit" in plan
