from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rootcause.operators import cohorts as G
from rootcause.operators import ledger as LG
from rootcause.functions.uniform import uniform
from rootcause.sources import adapters as A
from tests.conftest import SF_SMALL


def test_fold_rules():
    assert LG.apply_txn(100, "DEPOSIT", 50) == 150
    assert LG.apply_txn(100, "WITHDRAWAL", 150) == 0      # capped at the balance
    assert LG.apply_txn(100, "WITHDRAWAL", 30) == 70
    assert LG.apply_txn(-5, "WITHDRAWAL", 30) == -5       # no-op at <= 0
    assert LG.apply_txn(0, "WITHDRAWAL", 30) == 0
    assert LG.apply_txn(10, "WITHDRAWAL", -30) == 10      # a negative withdrawal takes nothing
    assert LG.apply_txn(10, "MARGIN_PENALTY", 30) == -20
    assert LG.apply_txn(10, "AMC_FEE", 3) == 7


def _units(x):
    return None if x is None else round(x * LG.UNITS)


def _brute_force(starts, events):
    by_user = defaultdict(list)
    for e in events:
        by_user[e["user_id"]].append(e)
    out = {}
    for uid, evs in by_user.items():
        if uid not in starts:
            continue
        bal = _units(starts[uid])
        for i, e in enumerate(sorted(evs, key=lambda e: (e["txn_ts"], e["txn_id"])), 1):
            bal = LG.apply_txn(bal, e["txn_type"], _units(e["amount"]))
            out[e["txn_id"]] = (uid, i, None if bal is None else bal / LG.UNITS)
    return out


def test_replay_matches_brute_force(spark):
    src = A.read_sources(spark, SF_SMALL, ("customer", "orders"))
    starts_df = src["customer"].select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("start_balance"))
    events_df = A.ledger_events(src["orders"])
    starts = {r["user_id"]: r["start_balance"] for r in starts_df.collect()}
    expected = _brute_force(starts, events_df.collect())
    got = {r["txn_id"]: (r["user_id"], r["txn_seq"], r["balance_after_txn"])
           for r in LG.replay_ledger(starts_df, events_df.repartition(5), ["txn_ts"]).collect()}
    assert got == expected


def test_replay_hot_user_across_batches(spark):
    # One user with many events, Arrow batches far smaller than the group.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        n = 500
        events = spark.range(n).select(
            F.lit(1).cast("long").alias("user_id"), F.col("id").alias("txn_id"),
            F.when(F.col("id") % 3 == 0, "DEPOSIT").when(F.col("id") % 3 == 1, "WITHDRAWAL")
             .otherwise("AMC_FEE").alias("txn_type"),
            (F.col("id") % 17 * 10.0).alias("amount"), F.col("id").alias("txn_ts"))
        starts = spark.createDataFrame([(1, 25.0), (2, 5.0)], "user_id long, start_balance double")
        got = {r["txn_id"]: (r["user_id"], r["txn_seq"], r["balance_after_txn"])
               for r in LG.replay_ledger(starts, events, ["txn_ts"]).collect()}
        assert got == _brute_force({1: 25.0, 2: 5.0}, events.collect())
        final = LG.final_balances(starts, events, ["txn_ts"]).collect()
        assert {r["user_id"]: r["n_txns"] for r in final} == {1: n, 2: 0}
        assert [r["total_ledger_balance"] for r in final if r["user_id"] == 2] == [5.0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("k", [0, 1, 37, 149, 150, 400])
@pytest.mark.parametrize("force_hist", [False, True])
def test_split_exact_matches_sort(spark, k, force_hist, monkeypatch):
    if force_hist:
        monkeypatch.setattr(G, "TOPK_ROWS", 0)
        monkeypatch.setattr(G, "HIST_BINS", 16)
    df = spark.range(150).withColumnRenamed("id", "user_id")
    first, rest = G.split_exact(df, "user_id", k, "s")
    ranked = sorted((r["u"], r["user_id"]) for r in df.select("user_id", uniform("user_id", "s").alias("u")).collect())
    want = {uid for _, uid in ranked[:k]}
    got_first = {r["user_id"] for r in first.collect()}
    got_rest = {r["user_id"] for r in rest.collect()}
    assert got_first == want
    assert got_rest == set(range(150)) - want


def test_surrogate_ids_dense_and_ordered(spark):
    df = spark.range(1000).repartition(9).withColumn("u", uniform("id", "x"))
    out = G.surrogate_ids(df, ["u", "id"], "sid").collect()
    ids = sorted(r["sid"] for r in out)
    assert ids == list(range(1, 1001))
    by_order = [r["id"] for r in sorted(out, key=lambda r: (r["u"], r["id"]))]
    assert by_order == [r["id"] for r in sorted(out, key=lambda r: r["sid"])]


def test_sample_with_replacement_and_weights(spark):
    df = spark.range(50).withColumnRenamed("id", "user_id")
    draws = G.sample_with_replacement(df, "user_id", 200, "d").collect()
    assert len(draws) == 200 and {r["draw_id"] for r in draws} == set(range(200))
    assert {r["user_id"] for r in draws} <= set(range(50))
    w = spark.range(20000).select(G.weighted_bucket(uniform("id", "w"), ["a", "b", "c"], [0.5, 0.3, 0.2]).alias("l"))
    counts = {r["l"]: r["count"] for r in w.groupBy("l").count().collect()}
    assert abs(counts["a"] / 20000 - 0.5) < 0.02 and abs(counts["c"] / 20000 - 0.2) < 0.02


def test_cohort_tickets_match_predicates(spark, tables):
    users = {r["user_id"]: r for r in tables["users"].collect()}
    tickets = tables["customer_support"].collect()
    assert len({r["ticket_id"] for r in tickets}) == len(tickets)
    for r in tickets:
        u = users[r["user_id"]]
        if r["complaint_theme"] == "KYC_ONBOARDING_EFFICIENCY":
            assert u["kyc_status"] != "APPROVED" and 4 <= r["support_interaction_count"] <= 6
        else:
            assert 1 <= r["support_interaction_count"] <= 3


def _random_ledger(seed, users, rows):
    import random
    rnd = random.Random(seed)
    types = ["DEPOSIT", "WITHDRAWAL", "WITHDRAWAL", "AMC_FEE", "MARGIN_PENALTY"]
    events = []
    for t in range(rows):
        uid = 1 if rnd.random() < 0.4 else rnd.randint(2, users)   # user 1 holds ~40% of rows
        amt = None if rnd.random() < 0.003 else rnd.choice([round(rnd.uniform(0, 300), 2), 0.0, 50.0])
        events.append((uid, 10_000 + t, rnd.choice(types), amt, rnd.randint(0, rows // 3)))
    starts = {u: (None if u == 3 else round(rnd.uniform(-200, 400), 2)) for u in range(1, users + 1) if u != 4}
    return starts, events


@pytest.mark.parametrize("hot_rows,segment_rows", [(40, 20), (1, 7), (200, 1000)])
def test_split_replay_matches_brute_force(spark, hot_rows, segment_rows):
    starts, events = _random_ledger(11, 12, 1500)
    sdf = spark.createDataFrame(list(starts.items()), "user_id long, start_balance double")
    edf = spark.createDataFrame(events, "user_id long, txn_id long, txn_type string, amount double, txn_ts long")
    want = _brute_force(starts, [dict(user_id=u, txn_id=t, txn_type=k, amount=a, txn_ts=ts)
                                 for u, t, k, a, ts in events])
    got = {r["txn_id"]: (r["user_id"], r["txn_seq"], r["balance_after_txn"])
           for r in LG.replay_ledger(sdf, edf.repartition(6), ["txn_ts"], hot_rows, segment_rows).collect()}
    assert got == want


def test_hot_user_is_split_with_a_realistic_mix(spark):
    """Half deposits, two fifths withdrawals, a tenth fees: every segment is summarised."""
    import random
    rnd = random.Random(3)
    kinds = rnd.choices(["DEPOSIT", "WITHDRAWAL", "AMC_FEE"], [0.5, 0.4, 0.1], k=200_000)
    amounts = {"DEPOSIT": (1000, 150000), "WITHDRAWAL": (1000, 50000), "AMC_FEE": (100, 450)}
    rows = [(1, t, k, round(rnd.uniform(*amounts[k]), 2), t) for t, k in enumerate(kinds)]
    events = spark.createDataFrame(rows, "user_id long, txn_id long, txn_type string, amount double, txn_ts long")
    starts = spark.createDataFrame([(1, 25.5)], "user_id long, start_balance double")
    ev = LG._event_units(events, ["txn_ts"])
    split = LG._replay_split(LG._start_units(starts), ev, ["txn_ts"], 16)
    sizes = [r["count"] for r in LG._segments(ev, ["user_id", "txn_ts", "txn_id"], 16).groupBy("_pid").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 50_000
    got = {r["txn_id"]: (1, r["txn_seq"], r["balance_after_txn"]) for r in split.collect()}
    assert got == _brute_force({1: 25.5}, [dict(user_id=1, txn_id=t, txn_type=k, amount=a, txn_ts=t)
                                           for _, t, k, a, _ in rows])


def test_margin_levers_the_unrounded_balance(spark):
    starts = spark.createDataFrame([(1, 100.004), (9, -3.0)], "user_id long, start_balance double")
    events = spark.createDataFrame([(1, 5, "AMC_FEE", 0.0, 1)],
                                   "user_id long, txn_id long, txn_type string, amount double, txn_ts long")
    got = {r["user_id"]: (r["total_ledger_balance"], r["n_txns"], r["margin_balance"])
           for r in LG.final_balances(starts, events, ["txn_ts"], leverage=F.lit(5.0)).collect()}
    assert got == {1: (100.0, 1, 500.02), 9: (-3.0, 0, -3.0)}


def test_step_summary_equals_fold():
    import random
    rnd = random.Random(5)
    types = ["DEPOSIT", "WITHDRAWAL", "AMC_FEE"]
    for _ in range(200):
        steps = [(rnd.choice(types), rnd.choice([rnd.randrange(-20, 120), 0, 30])) for _ in range(rnd.randint(0, 30))]
        f = LG.StepSummary()
        for t, a in steps:
            f.step(t, a)
        assert len(f) <= sum(t == "WITHDRAWAL" for t, _ in steps)
        for b in [-150, -30, -1, 0, 1, 10, 30, 45, 99, 500] + [rnd.randrange(-200, 200) for _ in range(5)]:
            want = b
            for t, a in steps:
                want = LG.apply_txn(want, t, a)
            assert f(b) == want, (steps, b, f(b), want)


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_duplicate_starts_take_the_largest(spark, hot_rows):
    starts = spark.createDataFrame([(1, 5.0), (1, 50.0), (1, None), (2, None)], "user_id long, start_balance double")
    events = spark.createDataFrame([(1, 10, "WITHDRAWAL", 20.0, 1), (1, 11, "DEPOSIT", 1.0, 2), (1, 12, "AMC_FEE", 1.0, 3),
                                    (2, 20, "DEPOSIT", 1.0, 1)],
                                   "user_id long, txn_id long, txn_type string, amount double, txn_ts long")
    got = {r.txn_id: r.balance_after_txn
           for r in LG.replay_ledger(starts, events.repartition(3), ["txn_ts"], hot_rows=hot_rows).collect()}
    assert got == {10: 30.0, 11: 31.0, 12: 30.0, 20: None}


def test_step_summary_property():
    from hypothesis import given, settings, strategies as st
    amounts = st.one_of(st.none(), st.integers(-500, 500), st.sampled_from([0, 10, 50]))
    steps = st.lists(st.tuples(st.sampled_from(["DEPOSIT", "WITHDRAWAL", "AMC_FEE", "MARGIN_PENALTY"]), amounts),
                     max_size=25)
    entries = st.one_of(st.none(), st.integers(-1000, 1000), st.sampled_from([0, 10, 50, -10]))

    @settings(max_examples=400, deadline=None)
    @given(steps, entries)
    def check(seq, b):
        f = LG.StepSummary()
        want = b
        for t, a in seq:
            f.step(t, a)
            want = LG.apply_txn(want, t, a)
        assert f(b) == want, (seq, b, f(b), want)

    check()
