"""Severity against the users outside a cohort, and the Bloom filter below the first exchange."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rootcause.operators import diagnose as D
from rootcause.operators import insight as IN
from rootcause.operators import severity as SV
from rootcause.operators.keyfilter import build_filter, might_match
from rootcause.plans.diagnostics import PLANS
from tests.test_diagnose import _tables


def world(spark, n=60):
    rng = random.Random(7)
    users = [(u, "APPROVED", rng.random() * 5, 0.0, 0.0, rng.choice(["CLEARED", "CLEARED", "2FA/OTP_NOT_RECEIVED", None])) for u in range(1, n)]
    trades = [(i, rng.choice([1, rng.randrange(1, n)]), "BUY_MARKET", 1.0, 1.0, rng.gauss(-2, 3), rng.choice([None, rng.random() * 900]), "NONE")
              for i in range(900)]
    ledger = [(i, rng.randrange(1, n), rng.choice(["DEPOSIT", "WITHDRAWAL", "AMC_FEE"]), 1.0, rng.gauss(500, 200), 1.0, float(rng.randrange(30)), 1)
              for i in range(700)]
    perf = [(i, rng.randrange(1, n), "iOS", 0, rng.random() * 200, float(rng.randrange(9)), 1, rng.random() * 20, rng.randrange(4)) for i in range(500)]
    support = [(i, rng.randrange(1, n), rng.choice(list(PLANS)), rng.random() * 40, rng.randrange(1, 6)) for i in range(80)]
    support += [(1000 + i, 1, "EXECUTION_SLIPPAGE", 1.0, 1) for i in range(3)] + [(2000, None, "GENERAL_INQUIRY", 2.0, 2)]
    return _tables(spark, users, trades, support, perf, ledger), {"users": users, "trades": trades, "financial_ledger": ledger, "app_performance": perf,
                                                                  "customer_support": support}


def plain_severity(raw, long_rows):
    """The definition, over lists."""
    from rootcause.schemas import TABLE_SCHEMAS
    rows = {t: [dict(zip(TABLE_SCHEMAS[t].fieldNames(), r)) for r in rs] for t, rs in raw.items()}
    out = {}
    for r in long_rows:
        plan = PLANS[r["complaint_theme"]]
        m = next(m for m in plan.metrics if m.alias == r["metric"])
        cohort = {s["user_id"] for s in rows["customer_support"] if s["complaint_theme"] == plan.theme}
        outside = [x for x in rows["customer_support" if m.source == "support" else plan.target] if x["user_id"] is None or x["user_id"] not in cohort]
        if m.agg == "count":
            total = sum(x["n"] for x in long_rows if x["complaint_theme"] == plan.theme and x["metric"] == m.alias)
            held = sum((x[plan.group_by] or "") == (r["group_key"] or "") for x in outside)
            u = (held + 0.5) / (len(outside) + 1)
            s = (r["n"] / total - u) / math.sqrt(u * (1 - u))
        else:
            v = sorted(float(x[m.column]) for x in outside if x[m.column] is not None)
            q = {p: v[max(1, math.ceil(p * len(v))) - 1] for p in SV.QUANTILES}
            scale = max((q[0.75] - q[0.25]) / 1.349, (q[0.95] - q[0.05]) / 3.29) or 1.0
            s = None if r["value"] is None else (r["value"] - q[0.5]) / scale * (1 if m.high_is_bad else -1)
        out[r["complaint_theme"], r["group_key"], r["metric"]] = s
    return out


@pytest.mark.parametrize("bound", [10**6, 0])
def test_severity_is_the_distance_from_outside(spark, monkeypatch, bound):
    T, raw = world(spark)
    monkeypatch.setattr(D.cohort_fits_broadcast, "__defaults__", (bound,))
    long = D.diagnose_long(T)
    got = SV.with_severity(long, SV.baseline(T)).collect()
    want = plain_severity(raw, long.collect())
    assert len(got) == len(want)
    for r in got:
        w = want[r["complaint_theme"], r["group_key"], r["metric"]]
        assert (r["severity"] is None) == (w is None) and (w is None or math.isclose(r["severity"], w, rel_tol=1e-12, abs_tol=1e-12)), (r, w)
    worst = {r["complaint_theme"]: r for r in IN.worst_row(long, SV.baseline(T)).collect()}
    for theme, plan in PLANS.items():
        mine = {k: s for k, s in want.items() if k[0] == theme and s is not None and (plan.healthy_key is None or k[1] != plan.healthy_key)}
        assert math.isclose(worst[theme]["severity"], max(mine.values()), rel_tol=1e-12)


def test_the_unusual_metric_wins_not_the_fixed_one(spark):
    users = [(u, "APPROVED", 1.0, 0.0, 0.0, "CLEARED") for u in range(1, 40)]
    # Error rates of the cohort are as everybody's, crashes are far beyond.
    perf = [(i, i % 39 + 1, "iOS", 0, 100.0 + i % 7, float(i % 5), 1, 5.0 + i % 3, 9 if i % 39 < 5 else i % 2) for i in range(390)]
    support = [(i, i + 1, "SYSTEM_STABILITY", 1.0, 1) for i in range(5)]
    T = _tables(spark, users, support=support, perf=perf)
    r = IN.worst_row(D.diagnose_long(T, ["SYSTEM_STABILITY"]), SV.baseline(T, ["SYSTEM_STABILITY"])).first()
    assert r["severity_metric"] == "avg_crash_loop_count_per_session" and r["severity"] > 5
    assert IN.worst_row(D.diagnose_long(T, ["SYSTEM_STABILITY"])).first()["severity_metric"] == "avg_api_5xx_error_rate_pct"


def test_nobody_outside_and_nobody_inside(spark):
    users = [(1, "APPROVED", 1.0, 0.0, 0.0, "CLEARED")]
    T = _tables(spark, users, support=[(1, 1, t, 1.0, 1) for t in PLANS])
    assert IN.worst_row(D.diagnose_long(T), SV.baseline(T)).count() == 6  # no ledger row, so no row of that theme
    none = _tables(spark, users)
    assert {r["severity"] for r in IN.worst_row(D.diagnose_long(none), SV.baseline(none)).collect()} == {None}


def test_sketch_error_is_within_its_bound(spark):
    n = 400_000
    df = spark.range(n).repartition(13).select(((F.col("id") * 7919) % n).cast("double").alias("x"))
    got = df.agg(F.percentile_approx("x", list(SV.QUANTILES), SV.ACCURACY)).first()[0]
    for p, x in zip(SV.QUANTILES, got):
        assert abs(x - (math.ceil(p * n) - 1)) <= n / SV.ACCURACY
    small = df.where("x < 49000").agg(F.percentile_approx("x", list(SV.QUANTILES), SV.ACCURACY)).first()[0]
    assert small == [math.ceil(p * 49_000) - 1 for p in SV.QUANTILES]


# -- key filter -------------------------------------------------------------

def test_filter_loses_no_key_and_few_others_pass(spark):
    keys = spark.range(5000).select((F.col("id") * 37).alias("user_id"))
    rows = spark.range(200_000).select(F.col("id").alias("user_id"), F.lit("x").alias("page"), F.lit(1).alias("w0"))
    kept = might_match(rows, "user_id", keys, 5000)
    assert kept.columns == rows.columns
    ids = {r["user_id"] for r in kept.collect()}
    assert {37 * i for i in range(5000)} <= ids
    assert len(ids) - 5000 < 0.08 * 195_000
    # Nulls, no keys, a bound that is too low, and too many keys.
    odd = spark.createDataFrame([(None, 1), (5, 2), (6, 3)], "user_id long, v int")
    assert [r["user_id"] for r in might_match(odd, "user_id", odd.where("v = 2").union(odd.where("v = 1")), 1).collect()] == [5]
    assert might_match(odd, "user_id", odd.limit(0), 0).count() == 0
    assert might_match(odd, "user_id", odd, 10**9).count() == 3
    assert build_filter(keys, "user_id", 5000).count() <= -(-5000 * 8 // 512)


def test_telemetry_is_filtered_below_the_first_exchange(spark, tables):
    for frame in (D.diagnose_long(tables, ["LEDGER_DISPUTE"], "filtered"), D.diagnose(tables, "LEDGER_DISPUTE", "filtered")):
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        lines = plan.split("\n")
        test = next(i for i, line in enumerate(lines) if "BroadcastHashJoin [_page" in line)
        # Above the test (nearer the root) stand the aggregates by user, below it the ledger.
        above = [line for line in lines[:test] if "HashAggregate(keys=[user_id" in line]
        assert len(above) == 2, plan
        depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
        assert all(depth[lines.index(a)] < depth[test] for a in above)


def test_hot_users_outside_the_cohort_are_not_shuffled(spark):
    T, _ = world(spark)
    for theme in PLANS:
        assert sorted(map(str, D.diagnose(T, theme, "filtered").collect())) == sorted(map(str, D.diagnose(T, theme, "rows").collect()))
    long = [sorted(map(str, D.diagnose_long(T, strategy=s).collect())) for s in ("rows", "filtered", "pre_aggregate", "broadcast")]
    assert all(x == long[0] for x in long)


def test_the_plan_follows_the_counted_cohort(spark, monkeypatch):
    T, _ = world(spark)
    assert D._chosen(T["customer_support"], list(PLANS)) == "broadcast"
    monkeypatch.setattr(D.cohort_fits_broadcast, "__defaults__", (0,))
    assert D._chosen(T["customer_support"], list(PLANS)) == "filtered"
    monkeypatch.setattr(D, "MAX_KEYS", 1)
    assert D._chosen(T["customer_support"], list(PLANS)) == "pre_aggregate"
