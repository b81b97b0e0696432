"""Kept replies: what is sent, what is not sent again, and what a failure costs."""

import collections
import os
import time

import pandas as pd
import pytest

from rootcause.operators import classify as C
from rootcause.operators.replies import Calls, ReplyStore, _call, infer_stored

TEXTS = [f"text {i % 40}" for i in range(100)] + [None]


@pytest.fixture
def feed(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, content string").repartition(5)


def logging_model(log, answer=lambda p: p.upper()):
    """A model that writes down what it is asked, one file a call."""
    def model(prompts: pd.Series) -> pd.Series:
        path = os.path.join(log, f"{time.monotonic_ns()}-{os.getpid()}")
        with open(path, "w") as f:
            f.write("\n".join(prompts))
        return prompts.map(answer)
    return model


def asked(log):
    return collections.Counter(line for name in os.listdir(log) for line in open(os.path.join(log, name)).read().split("\n"))


def folder(tmp_path, name):
    path = tmp_path / name
    path.mkdir()
    return str(path)


def test_each_text_is_sent_once_however_often_it_is_used(spark, feed, tmp_path):
    log = folder(tmp_path, "log")
    store = ReplyStore(spark, f"file://{tmp_path}/store")
    out = infer_stored(feed, "content", logging_model(log), store, wrap=True, calls=Calls(batch=4))
    for _ in range(3):
        got = {r["i"]: r["reply"] for r in out.collect()}
    assert got == {i: None if t is None else f"<REVIEW>{t.upper()}</REVIEW>" for i, t in enumerate(TEXTS)}
    more = feed.unionByName(spark.createDataFrame([(200, "another"), (201, "text 7")], "i int, content string"))
    again = infer_stored(more, "content", logging_model(log), store, wrap=True, calls=Calls(batch=4))
    assert again.where("i >= 200").count() == 2
    assert asked(log) == {f"<review>{t}</review>": 1 for t in {*TEXTS, "another"} - {None}}
    store.compact()
    assert store.rows().count() == store.state().count() == 41
    assert infer_stored(more, "content", logging_model(log), store, wrap=True).where("reply IS NOT NULL").count() == 102
    assert sum(asked(log).values()) == 41


def test_a_dying_task_costs_its_own_call_only(spark, tmp_path):
    log, marker = folder(tmp_path, "log"), tmp_path / "died"
    df = spark.createDataFrame([(i, f"prompt {i}") for i in range(120)], "i int, content string")
    store = ReplyStore(spark, f"file://{tmp_path}/store")
    plain = logging_model(log)

    def model(prompts: pd.Series) -> pd.Series:
        if not marker.exists() and len(os.listdir(log)) > 20:
            marker.write_text("x")
            os._exit(1)  # the worker is gone, as when its machine is lost
        return plain(prompts)

    with pytest.raises(Exception):  # noqa: B017 - a local session does not repeat tasks
        infer_stored(df, "content", model, store, calls=Calls(batch=2))
    kept = {r["digest"] for r in store.state().collect()}
    assert 0 < len(kept) < 120
    before = asked(log)
    got = infer_stored(df, "content", model, store, calls=Calls(batch=2)).collect()
    assert all(r["reply"] == r["content"].upper() for r in got)
    import hashlib
    for text, times in asked(log).items():
        if hashlib.sha256(text.encode()).hexdigest() in kept:
            assert times == before[text] == 1, text
    assert store.rows().where("reply IS NOT NULL").count() == 120


def test_failures_are_kept_and_asked_again_until_given_up(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["fine", "bad", "fine too"])], "i int, content string").coalesce(1)
    store = ReplyStore(spark, f"file://{tmp_path}/store")

    def model(prompts: pd.Series) -> pd.Series:
        if "bad" in set(prompts):
            raise TimeoutError("no reply")
        return prompts.map(lambda p: None if p == "fine too" else p)

    calls = Calls(batch=50, tries=2, pause=0.001, give_up=6)
    got = {r["content"]: r["reply"] for r in infer_stored(df, "content", model, store, calls=calls).collect()}
    assert got == {"fine": "fine", "bad": None, "fine too": ""}
    state = {r["reply"]: r for r in store.state().collect()}
    assert state[None]["error"] == "TimeoutError: no reply" and state[None]["attempt"] == 3
    for _ in range(4):
        infer_stored(df, "content", model, store, calls=calls)
    assert store.rows().where("error IS NOT NULL").count() == 3  # 3, 5 and 7 attempts: then no more
    assert infer_stored(df, "content", lambda p: p, store, calls=Calls(give_up=99)).where("reply IS NULL").count() == 0


def test_calls_are_repeated_with_pauses_and_paced():
    tries = []

    class Busy(Exception):
        retry_after = 0.2

    def model(prompts):
        tries.append(time.monotonic())
        if len(tries) < 3:
            raise Busy()
        return prompts

    replies, errors, n = _call(pd.Series(["a", "b"]), model, Calls(tries=3, pause=30.0), 0.0)
    assert (replies, errors, n) == (["a", "b"], [None, None], 3)
    assert all(b - a >= 0.2 for a, b in zip(tries, tries[1:])) and tries[-1] - tries[0] < 5
    at = []
    for _ in range(4):
        _call(pd.Series(["a"]), lambda p: at.append(time.monotonic()) or p, Calls(), 0.05)
    assert all(b - a >= 0.045 for a, b in zip(at, at[1:]))
    # A wrong number of replies is a failure.
    assert _call(pd.Series(["a"]), lambda p: [], Calls(tries=1), 0.0)[1][0].startswith("ValueError")


def test_many_prompts_are_sent_in_several_jobs_and_empty_feeds_send_none(spark, feed, tmp_path):
    log = folder(tmp_path, "log")
    store = ReplyStore(spark, f"file://{tmp_path}/store")
    infer_stored(feed, "content", logging_model(log), store, calls=Calls(batch=4, tasks=7))
    assert asked(log) == {t: 1 for t in set(TEXTS) - {None}}
    assert infer_stored(feed.limit(0), "content", logging_model(log), store).count() == 0
    assert ReplyStore(spark, f"file://{tmp_path}/nothing").state().count() == 0


def test_categorise_with_a_store(spark, feed, tmp_path):
    store = ReplyStore(spark, f"file://{tmp_path}/store")

    def model(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: '{"category": "LEDGER_DISPUTE"}' if "text 1" in p else "?")

    got = {r["content"]: r["ai_complaint_category"] for r in C.categorise(feed, "content", model, store=store).collect()}
    assert got[None] is None and got["text 1"] == got["text 12"] == "LEDGER_DISPUTE" and got["text 2"] == "GENERAL_INQUIRY"

    def no_model(prompts):
        raise AssertionError("asked again")

    assert C.categorise(feed, "content", no_model, store=store).where("ai_complaint_category = 'LEDGER_DISPUTE'").count() > 0
