"""A ledger that arrives in loads gives the bits of one replay."""

import random

import pytest
from pyspark.sql import functions as F

from rootcause.operators import ledger as LG
from tests.test_ledger_and_cohorts import _random_ledger

EVENT = "user_id long, txn_id long, txn_type string, amount double, txn_ts long"


def summary(steps):
    f = LG.StepSummary()
    for t, a in steps:
        f.step(t, a)
    return f


def test_composition_is_the_run_of_both_and_associative():
    rnd = random.Random(9)
    kinds = ["DEPOSIT", "WITHDRAWAL", "WITHDRAWAL", "AMC_FEE"]
    for _ in range(400):
        parts = [[(rnd.choice(kinds), rnd.choice([rnd.randrange(-20, 120), 0, 30, None if rnd.random() < 0.02 else 7]))
                  for _ in range(rnd.randint(0, 12))] for _ in range(3)]
        f, g, h = map(summary, parts)
        whole = summary([s for p in parts for s in p])
        left, right = LG.compose(LG.compose(f, g), h), LG.compose(f, LG.compose(g, h))
        assert left.dead == right.dead == whole.dead
        if not whole.dead:
            assert left.flats() == right.flats() == whole.flats() and left.shift == right.shift == whole.shift
        for b in [-200, -30, -1, 0, 1, 10, 45, 99, 500] + [rnd.randrange(-200, 200) for _ in range(5)]:
            assert left(b) == right(b) == whole(b) == h(g(f(b)))
        assert len(left) <= sum(t == "WITHDRAWAL" for p in parts for t, _ in p)


@pytest.mark.parametrize("cuts, hot_rows, segment_rows", [((), 10**6, 10), ((120, 300), 10**6, 10), ((50, 51, 200, 420), 30, 15)])
def test_any_number_of_loads_in_any_order(spark, tmp_path, cuts, hot_rows, segment_rows):
    starts, events = _random_ledger(5, 12, 1500)
    sdf = spark.createDataFrame(list(starts.items()), "user_id long, start_balance double")
    edf = spark.createDataFrame(events, EVENT).repartition(4).cache()
    want = sorted(map(tuple, LG.replay_ledger(sdf, edf, ["txn_ts"]).collect()))
    bounds = [-1, *cuts, 10**9]
    loads = {n: edf.where((F.col("txn_ts") > a) & (F.col("txn_ts") <= b)) for n, (a, b) in enumerate(zip(bounds, bounds[1:]))}
    ledger = LG.LedgerLoads(spark, f"file://{tmp_path}/ledger", sdf, ["txn_ts"])
    order = list(loads)
    random.Random(1).shuffle(order)
    hot = {"hot_rows": hot_rows, "segment_rows": segment_rows}
    for n in order:
        ledger.add(n, loads[n].limit(3) if n == order[0] else loads[n], **hot)
    ledger.add(order[0], loads[order[0]], **hot)  # added again, now whole
    assert ledger.loads() == list(loads)
    got = sorted(tuple(r) for n in loads for r in ledger.balances(n, loads[n], **hot).collect())
    assert got == want
    last = {u: (b, s) for _, u, s, b in sorted(want, key=lambda r: r[2])}
    state = {r["user_id"]: r for r in ledger.state().collect()}
    assert set(state) == set(starts)
    for u, r in state.items():
        balance = None if r["balance_units"] is None else r["balance_units"] / LG.UNITS
        assert (balance, r["n_txns"]) == last.get(u, (starts[u], 0)), u
    # Compacted loads reach the same state, and the next load continues from it.
    ledger.compact(len(cuts) - 1)
    assert {r["user_id"]: tuple(r) for r in ledger.state().collect()} == {u: tuple(r) for u, r in state.items()}
    n = len(cuts)
    assert sorted(tuple(r) for r in ledger.balances(n, loads[n]).collect()) == sorted(
        r for r in want if r[0] in {e["txn_id"] for e in loads[n].select("txn_id").collect()})


def test_no_load_and_empty_loads(spark, tmp_path):
    sdf = spark.createDataFrame([(1, 2.5), (1, 1.0), (2, None)], "user_id long, start_balance double")
    ledger = LG.LedgerLoads(spark, f"file://{tmp_path}/ledger", sdf, ["txn_ts"])
    assert sorted(map(tuple, ledger.state().collect())) == [(1, 25000, 0), (2, None, 0)]
    empty = spark.createDataFrame([], EVENT)
    ledger.add(0, empty)
    assert ledger.balances(0, empty).count() == 0
    ledger.add(1, spark.createDataFrame([(1, 5, "WITHDRAWAL", 9.0, 3), (3, 6, "DEPOSIT", 1.0, 3)], EVENT))
    assert sorted(map(tuple, ledger.state().collect())) == [(1, 0, 1), (2, None, 0)]
    ledger.compact(7)
    assert ledger.loads() == [7] and sorted(map(tuple, ledger.state().collect())) == [(1, 0, 1), (2, None, 0)]
