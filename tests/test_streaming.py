"""Landed twice, landed late, landed again after a crash."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rootcause.queries import _FEED_SCHEMA
from rootcause.sources.versioned import publish, read_current, versions
from rootcause.streaming import categorise as ST

DAY = dt.datetime(2026, 2, 9)
RULES = [("LEDGER_DISPUTE", "deposit"), ("EXECUTION_SLIPPAGE", "order")]


def land(spark, path, rows):
    spark.createDataFrame(rows, _FEED_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def review(i, minutes, text="my deposit"):
    return (i, f"user {i}", 1, None if minutes is None else DAY + dt.timedelta(minutes=minutes), text)


@pytest.fixture
def at(tmp_path):
    return lambda name: f"file://{tmp_path}/{name}"


def test_a_review_that_lands_twice_is_labelled_once_and_state_is_bounded(spark, at):
    run = lambda: ST.stream_categorise(spark, at("in"), at("out"), at("ckpt"), _FEED_SCHEMA, RULES, dedupe_within="60 minutes")
    land(spark, at("in"), [review(i, i) for i in range(10)] + [review(3, 3), review(4, 4, "my order")])
    run().awaitTermination()
    land(spark, at("in"), [review(i, i) for i in range(5, 15)])
    run().awaitTermination()
    got = sorted((r["seq"], r["ai_complaint_category"]) for r in spark.read.parquet(at("out")).collect())
    assert got == sorted([(i, "LEDGER_DISPUTE") for i in range(15)] + [(4, "EXECUTION_SLIPPAGE")])
    # Much later reviews move the watermark: the old digests leave the state, and a review
    # that is older than it is left out and counted.
    land(spark, at("in"), [review(100, 1000)])
    query = run()
    query.awaitTermination()
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 1
    land(spark, at("in"), [review(200, 20), review(100, 1000), review(101, 1001)])
    query = run()
    query.awaitTermination()
    assert ST.late_rows(query) == 1
    assert {r["seq"] for r in spark.read.parquet(at("out")).where("seq > 50").collect()} == {100, 101}


def test_windows_with_replayed_and_late_files_give_the_batch_result(spark, at):
    loads = [[review(i, i % 50) for i in range(40)], [review(i, 60 + i, "my order") for i in range(30)],
             [review(1, 2), review(2, 3, "nothing"), review(3, None), review(4, 1, None)], [review(9, 200)]]
    run = lambda: ST.stream_windows(spark, at("in"), at("ckpt"), _FEED_SCHEMA, at("w"), "10 minutes", "30 minutes", RULES)
    for rows in loads:
        land(spark, at("in"), rows)
        run().awaitTermination()
    assert versions(spark, at("w")) == [2, 3]
    labelled = (spark.read.schema(_FEED_SCHEMA).parquet(at("in")).withColumn("ai_complaint_category", ST.label_column("content", RULES)))
    want = sorted(map(str, ST.window_counts(labelled, "10 minutes").select("window_start", "window_end", "Category", "Count").collect()))
    rows = ST.current_windows(spark, at("w"), "30 minutes").collect()
    assert sorted(str(r) for r in ST.current_windows(spark, at("w"), "30 minutes").select("window_start", "window_end", "Category", "Count").collect()) == want
    # 89 minutes had been seen, so windows up to 59 were past: the two rows at 2 and 3 minutes came late.
    assert sum(r["late_count"] for r in rows) == 2
    assert {r["final"] for r in rows if r["window_start"] == DAY} == {True}
    assert {r["final"] for r in rows if r["window_start"] and r["window_start"] > DAY + dt.timedelta(minutes=180)} == {False}
    # The last batch is replayed, as after a crash between its publication and its commit.
    ckpt = at("ckpt")[7:]
    for name in ("3", ".3.crc"):
        os.remove(f"{ckpt}/commits/{name}")
    run().awaitTermination()
    assert sorted(str(r) for r in ST.current_windows(spark, at("w"), "30 minutes").collect()) == sorted(map(str, rows))
    # And one that dies before its publication is counted when it comes again.
    land(spark, at("in"), [review(77, 5)])
    whole = ST.publish

    def dies(*a, **k):
        raise RuntimeError("lost")
    ST.publish = dies
    with pytest.raises(Exception):  # noqa: B017
        run().awaitTermination()
    ST.publish = whole
    run().awaitTermination()
    assert sum(r["Count"] for r in ST.current_windows(spark, at("w")).collect()) == sum(r["Count"] for r in rows) + 1


def test_versions_appear_at_once_and_stay_for_their_readers(spark, at):
    with pytest.raises(FileNotFoundError):
        read_current(spark, at("t"))
    assert read_current(spark, at("t"), "i long").count() == 0
    assert publish(spark.range(3), at("t")) == 0
    old = read_current(spark, at("t"))
    assert publish(spark.range(5), at("t")) == 1
    assert old.count() == 3 and read_current(spark, at("t")).count() == 5
    assert publish(spark.range(9), at("t"), version=1) == 1 and read_current(spark, at("t")).count() == 5
    broken = spark.range(4).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception):  # noqa: B017
        publish(broken, at("t"))
    assert read_current(spark, at("t")).count() == 5 and versions(spark, at("t")) == [0, 1]
    for _ in range(3):
        publish(spark.range(1), at("t"))
    assert versions(spark, at("t")) == [3, 4]


def test_distribution_is_published_in_versions(spark, at):
    run = lambda: ST.stream_distribution(spark, at("in"), at("ckpt"), _FEED_SCHEMA, at("d"), RULES)
    assert ST.current_distribution(spark, at("d")).count() == 0
    land(spark, at("in"), [review(1, 1), review(2, 2, "order"), review(3, 3, None)])
    run().awaitTermination()
    held = ST.current_distribution(spark, at("d"))
    land(spark, at("in"), [review(5, 5)])
    run().awaitTermination()
    assert {r["Category"]: r["Count"] for r in held.collect()} == {"LEDGER_DISPUTE": 1, "EXECUTION_SLIPPAGE": 1}
    assert {r["Category"]: r["Count"] for r in ST.current_distribution(spark, at("d")).collect()} == {"LEDGER_DISPUTE": 2, "EXECUTION_SLIPPAGE": 1}
