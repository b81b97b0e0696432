import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from rootcause.functions import numeric as N
from rootcause.functions import text as X
from rootcause.functions.units import format_metric

SQL_REPLIES = [
    ("```sql\nSELECT a FROM t;\n```", "SELECT a FROM t;"),
    ("select a from t", "select a from t"),
    ("```sql\nSELECT a FROM t\n```", "SELECT a FROM t\n```"),
    ("WITH c AS (SELECT 1) SELECT * FROM c;", "SELECT 1) SELECT * FROM c;"),
    ("SELECT 'a;b' FROM t;", "SELECT 'a;"),
    ("I cannot write that query.", "ERROR_GENERATING_SQL"),
    ("selection of SELECTED items", "ERROR_GENERATING_SQL"),
    ("  \n SELECT x FROM y  \n", "SELECT x FROM y"),
]


@pytest.mark.parametrize("reply,expected", SQL_REPLIES)
def test_extract_sql(spark, reply, expected):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(X.extract_sql("r")).first()[0] == expected


def test_preview_and_wrap(spark):
    df = spark.createDataFrame([("a" * 75,), ("b" * 76,), (None,)], "t string")
    got = [tuple(r) for r in df.select(X.preview("t"), X.wrap_review("t")).collect()]
    assert got[0] == ("a" * 75, "<review>" + "a" * 75 + "</review>")
    assert got[1] == ("b" * 75 + "...", "<review>" + "b" * 76 + "</review>")
    assert got[2] == (None, None)


def _py_fmt(s_e4: int, n: int) -> str:
    q = (Decimal(s_e4) / Decimal(10000) / Decimal(n)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    return f"{q:.2f}" if q != 0 else "0.00"


def test_fmt_ratio_2dp_exact(spark):
    rnd = random.Random(7)
    cases = [(5, 1), (-5, 1), (50, 1), (-50, 1), (12345, 2), (-12345, 2), (0, 3), (1, 3), (10050, 1),
             (-10050, 1), (None, 2), (7, 0)]
    cases += [(rnd.randint(-10**12, 10**12), rnd.randint(1, 10**6)) for _ in range(300)]
    df = spark.createDataFrame(cases, "s long, n long").withColumn("t", F.expr("CAST(s AS DECIMAL(20,0)) / 10000").cast("decimal(38,6)"))
    got = df.select("s", "n", N.fmt_ratio_2dp("t", "n").alias("f")).collect()
    for r in got:
        if r["s"] is None or r["n"] == 0:
            assert r["f"] is None
        else:
            assert r["f"] == _py_fmt(r["s"], r["n"]), (r["s"], r["n"])


def test_exact_avg_is_partition_independent(spark):
    vals = [(i % 7, round(random.Random(i).uniform(-1e4, 1e4), 2)) for i in range(5000)]
    df = spark.createDataFrame(vals, "k int, v double")
    a = sorted(df.repartition(1).groupBy("k").agg(N.exact_avg("v").alias("a")).collect())
    b = sorted(df.repartition(7).groupBy("k").agg(N.exact_avg("v").alias("a")).collect())
    assert a == b


@pytest.mark.parametrize("name,text,expected", [
    ("avg_price_slippage_bps", "-14.00", "-14.00 bps"),
    ("avg_order_routing_latency_ms", "150.25", "150.25 ms"),
    ("avg_api_5xx_error_rate_pct", "3.10", "3.10%"),
    ("websocket_drop_rate", "2.00", "2.00%"),
    ("avg_withdrawal_processing_latency_hours", "96.00", "96.00 hours"),
    ("avg_kyc_processing_age_days", "20.10", "20.10 days"),
    ("avg_crash_loop_count_per_session", "2.50", "2.50"),
    ("items", "3", "3"),
    ("msgs_total", "3", "3"),
])
def test_format_metric_units(spark, name, text, expected):
    df = spark.createDataFrame([(name, text)], "m string, t string")
    assert df.select(format_metric("m", "t")).first()[0] == expected
