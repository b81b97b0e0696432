"""The scope classifier on sentences, and its plan."""

import pytest

from rootcause.operators import classify as C
from tests.test_classify import GOLDEN

X, L, S, G, K, U, O = ("EXECUTION_SLIPPAGE", "LEDGER_DISPUTE", "SYSTEM_STABILITY", "LOGIN_AND_2FA_ISSUE", "KYC_ONBOARDING_EFFICIENCY",
                       "CHARTING_UI_GLITCH", "GENERAL_INQUIRY")
SENTENCES = [
    # the code is there, something else fails
    ("I entered my pin and the buy button is missing", X),
    ("Got the sms, but the deposit never came", L),
    ("otp works, withdrawal delayed for a week", L),
    ("The otp came at once and then my order was rejected", X),
    ("Typed the T-PIN; funds still not received", L),
    ("My pin is fine. The app crashes on every start.", S),
    ("sms arrived, documents are missing they say", K),
    ("With the otp entered, the order page was not loading", X),
    ("I use 2fa, the chart never came up", U),
    # the code fails, whatever was meant to be done
    ("tried to sell all day, the otp is not coming", G),
    ("I want to withdraw but did not get any sms", G),
    ("my deposit is blocked because the otp never arrives", G),
    ("Order stuck, waiting for the tpin since morning", G),
    ("SMS missing again, cannot buy", G),
    ("without an otp I cannot withdraw my funds", G),
    ("They don't send the pin, so my sip was skipped", G),
    ("the 2fa sms has still not been delivered", G),
    ("Unable to get the otp, ipo closes today", G),
    # a display that is wrong although the action succeeded
    ("My order was executed but the amc fee was wrong value", L),
    ("Deposit successful. The dashboard shows wrong balance", U),
    ("the portfolio is not updating although my order was executed", U),
    ("Withdrawal completed, screen still frozen", U),
    ("money was credited but holdings are not reflecting", U),
    ("order went through, yet the watchlist is stale", U),
    ("my withdrawal has not been credited and the dashboard is not updating", L),
    ("order failed and the chart is not updating", X),
    ("my deposit has not yet been credited and the dashboard is not updating", L),
    # success of one thing, complaint about another
    ("Order executed fine, but the withdrawal is pending", L),
    ("My buy order was completed. Why is there a margin penalty?", L),
    ("Deposit completed, login fails every time", G),
    ("order was executed at a wrong price", X),
    ("sold successfully but verification is stuck", K),
    ("All orders executed", X),
    # codes of others, words inside words, other phrases
    ("spinning wheel, no smser", O),
    ("Re KYC demanded after ten years, orders blocked", K),
    ("auto square off hit me at noon", L),
    ("stop loss did not trigger", X),
    ("servers are down again", S),
    ("It does not open since the update", S),
    ("I was logged out in the middle", G),
    ("segment activation takes forever", K),
    ("the bank transfer is lost", L),
    ("Balance of power, nice theme", O),
    ("my balance went negative", L),
    ("no complaints, great support", O),
    ("The charges of 20.50 per call are high, brokerage too", O),
    ("", O),
]


@pytest.mark.parametrize("cases", [GOLDEN, SENTENCES], ids=["golden", "own"])
def test_sentences(spark, cases):
    df = spark.createDataFrame([(t,) for t, _ in cases], "content string")
    rows = df.select("content", C.classify_by_scope("content").alias("label"), C.tag_string("content").alias("tags")).collect()
    wrong = [(r["content"], r["label"], dict(cases)[r["content"]], r["tags"]) for r in rows if r["label"] != dict(cases)[r["content"]]]
    assert not wrong, wrong


def test_one_sentence_of_each_decision_rule(spark):
    cases = [("Asked for a payout on Monday; the withdrawal has not yet been credited, and the app crawls.", L),
             ("Wanted to sell before noon, the T-PIN was never delivered to my phone.", G),
             ("First they took my buy order, now selling needs a rekyc.", K),
             ("No allotment in the OFS because of some glitch, and nobody answers.", X)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "content string")
    assert [r[0] for r in df.select(C.classify_by_scope("content")).collect()] == [w for _, w in cases]


def test_null_and_long_texts(spark):
    df = spark.createDataFrame([(None,), ("word " * 100_000 + "the otp never came",)], "content string")
    assert [r[0] for r in df.select(C.classify_by_scope("content")).collect()] == [None, G]


def test_the_text_is_read_once(spark):
    df = spark.createDataFrame([("x",)], "content string").select(C.classify_by_scope("content").alias("c"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("lower(") <= 1


def test_no_word_has_two_tags():
    from rootcause.plans.scoped import _GROUPS
    words = [w for ws in _GROUPS.values() for w in ws.split()]
    assert sorted(words) == sorted(set(words))
