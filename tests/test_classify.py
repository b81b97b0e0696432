import pandas as pd
import pytest
from pyspark.sql import functions as F

from rootcause.operators import classify as C
from rootcause.plans.lexicons import FINANCE_RULES
from rootcause.plans.reply_models import failing_label_model, label_reply
from rootcause.queries import CORPUS_RULES

GOLDEN = [
    # a code that does not come overrides what the user was doing
    ("The otp never came so my sell order stayed pending.", "LOGIN_AND_2FA_ISSUE"),
    ("No SMS is arriving when I try to move money out", "LOGIN_AND_2FA_ISSUE"),
    ("Still waiting for the pin, withdrawal blocked", "LOGIN_AND_2FA_ISSUE"),
    ("T-PIN not received since Monday, cannot sell", "LOGIN_AND_2FA_ISSUE"),
    ("I logged in with my pin and my sell order was not executed", "EXECUTION_SLIPPAGE"),
    ("Entered the otp at once. The withdrawal is still pending.", "LEDGER_DISPUTE"),
    # a demanded re-KYC
    ("They stopped my buy order and ask me to do re-kyc", "KYC_ONBOARDING_EFFICIENCY"),
    ("rekyc again and again, funds locked", "KYC_ONBOARDING_EFFICIENCY"),
    # the action succeeded, the display is wrong
    ("My deposit was successful but the dashboard is not refreshing", "CHARTING_UI_GLITCH"),
    ("Order executed fine yet the portfolio shows wrong quantity", "CHARTING_UI_GLITCH"),
    ("Money credited, screen not updating", "CHARTING_UI_GLITCH"),
    ("order rejected because the price was not updating", "EXECUTION_SLIPPAGE"),
    # priority order
    ("Stop-loss did not trigger and the chart froze", "EXECUTION_SLIPPAGE"),
    ("IPO application failed twice", "EXECUTION_SLIPPAGE"),
    ("My SIP was skipped this month", "EXECUTION_SLIPPAGE"),
    ("Bank transfer took ten days", "LEDGER_DISPUTE"),
    ("AMC charged twice, give back my funds", "LEDGER_DISPUTE"),
    ("account balance went negative overnight", "LEDGER_DISPUTE"),
    ("margin penalty for no reason and the app crashed", "LEDGER_DISPUTE"),
    ("good balance of features", "GENERAL_INQUIRY"),
    ("App crashes at nine every morning", "SYSTEM_STABILITY"),
    ("server down during market hours", "SYSTEM_STABILITY"),
    ("It is not opening since the update", "SYSTEM_STABILITY"),
    ("cannot login, password reset loops", "LOGIN_AND_2FA_ISSUE"),
    ("account opening stuck for two weeks", "KYC_ONBOARDING_EFFICIENCY"),
    ("segment activation pending", "KYC_ONBOARDING_EFFICIENCY"),
    ("my documents were rejected again", "KYC_ONBOARDING_EFFICIENCY"),
    ("indicators vanish from the chart", "CHARTING_UI_GLITCH"),
    ("How much brokerage do you take?", "GENERAL_INQUIRY"),
    ("awful support, laggy, feels like fraud", "GENERAL_INQUIRY"),
    ("love the new colours", "GENERAL_INQUIRY"),
]


def test_finance_rules_golden(spark):
    df = spark.createDataFrame([(t,) for t, _ in GOLDEN], "content string")
    got = df.select("content", C.classify_by_rules("content", FINANCE_RULES).alias("c")).collect()
    assert {r["content"]: r["c"] for r in got} == dict(GOLDEN)


def test_word_boundaries_use_letters(spark):
    # 'pin' inside 'spinning' and 'que' inside 'quelque' must not fire; accented
    # neighbours are letters.
    df = spark.createDataFrame([("spinning wheel",), ("quelque chose",), ("éque",), ("x que y",)], "content string")
    got = [r[0] for r in df.select(C.classify_by_rules("content", FINANCE_RULES + CORPUS_RULES)).collect()]
    assert got == ["GENERAL_INQUIRY", "GENERAL_INQUIRY", "GENERAL_INQUIRY", "LEDGER_DISPUTE"]


def test_null_text_gets_null_label(spark):
    df = spark.createDataFrame([(None,)], "content string")
    assert df.select(C.classify_by_rules("content", FINANCE_RULES)).first()[0] is None


REPLIES = [
    ('{"reasoning": "r", "category": "LEDGER_DISPUTE"}', "LEDGER_DISPUTE"),
    ('Sure:\n```json\n{"reasoning": "r", "category": "SYSTEM_STABILITY"}\n```', "SYSTEM_STABILITY"),
    ("no braces at all", "GENERAL_INQUIRY"),
    ('{"reasoning": "r"}', "GENERAL_INQUIRY"),
    ('{"Category": "LEDGER_DISPUTE"}', "GENERAL_INQUIRY"),
    ("{'category': 'LEDGER_DISPUTE'}", "GENERAL_INQUIRY"),
    ('{"category": "LEDGER_DISPUTE",}', "GENERAL_INQUIRY"),
    ('{"reasoning": "a\nb", "category": "LEDGER_DISPUTE"}', "GENERAL_INQUIRY"),
    ('{"category": "A"} {"category": "B"}', "GENERAL_INQUIRY"),
    ('{"category": "A"}}', "GENERAL_INQUIRY"),
    ('{"category": null}', None),
    ('{"category": "A", "category": "B"}', "B"),
    ('{"category": "NOT_IN_TAXONOMY"}', "NOT_IN_TAXONOMY"),
    ("[1, 2]", "GENERAL_INQUIRY"),
    (None, "GENERAL_INQUIRY"),
]


@pytest.mark.parametrize("reply,expected", REPLIES)
def test_label_rule_python(reply, expected):
    assert C._label_of(reply) == expected


def test_extract_label_udf(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, reply string")
    got = {r["i"]: r["label"] for r in df.select("i", C.extract_label("reply").alias("label")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(REPLIES)}


def test_native_label_fast_path_known_differences(spark):
    from rootcause.functions.text import extract_label_native
    df = spark.createDataFrame([('{"category": "A"}',), ('x {"category": "B"} y',), ("none",)], "reply string")
    assert [r[0] for r in df.select(extract_label_native("reply")).collect()] == ["A", "B", "GENERAL_INQUIRY"]


def test_batch_infer_calls_model_once_per_distinct_text(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(prompts: pd.Series) -> pd.Series:
        seen.add(len(prompts))
        return prompts.map(lambda p: f"  {p.upper()}  ")

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", "a", None, "b"])], "i int, content string")
    out = C.batch_infer(df, "content", model, wrap=True).collect()
    assert seen.value == 2
    got = {r["i"]: r["reply"] for r in out}
    assert got == {0: "<REVIEW>A</REVIEW>", 1: "<REVIEW>B</REVIEW>", 2: "<REVIEW>A</REVIEW>",
                   3: "<REVIEW>A</REVIEW>", 4: None, 5: "<REVIEW>B</REVIEW>"}


def test_label_model_covers_all_shapes():
    shapes = {C._label_of(label_reply("x" * n)) for n in range(0, 7 * 11 * 2)}
    assert None in shapes and "GENERAL_INQUIRY" in shapes
    assert any(s and s.startswith("OTHER_") for s in shapes)


def test_distribution_rank_and_top(spark):
    df = spark.createDataFrame([("A",), ("B",), ("B",), (None,), ("C",), ("C",)], "ai_complaint_category string")
    dist = C.category_distribution(df)
    assert [tuple(r) for r in dist.collect()] == [("B", 2), ("C", 2), ("A", 1)]
    assert C.top_category(dist).first()["Category"] == "B"
    ranked = C.ranked_categories(dist).collect()
    assert [(r["Category"], r["idx"], r["is_default"]) for r in ranked] == [("B", 0, True), ("C", 1, False),
                                                                          ("A", 2, False)]


def test_a_failing_call_costs_only_its_review(spark):
    texts = ["x" * n for n in range(1, 60)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string").coalesce(1)
    got = {r["i"]: r["ai_complaint_category"] for r in C.categorise(df, "content", failing_label_model).collect()}
    for i, t in enumerate(texts):
        prompt = None if t is None else f"<review>{t}</review>"
        want = None if t is None else "GENERAL_INQUIRY" if len(prompt) % 10 == 3 else C._label_of(label_reply(prompt))
        assert got[i] == want, (i, t)


@pytest.mark.parametrize("dedupe", [True, False])
def test_a_call_has_few_prompts(spark, dedupe):
    """Whole texts go to a worker, and to the model, in batches of bounded size."""
    def model(prompts):
        if len(prompts) > 1024:
            raise MemoryError(f"{len(prompts)} prompts in one call")
        return prompts.map(len)

    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "10000")
    try:
        df = spark.range(5000).selectExpr("id", "concat('text ', id % 4500) AS content").coalesce(1)
        got = {r["id"]: r["reply"] for r in C.batch_infer(df, "content", model, wrap=True, dedupe=dedupe).collect()}
        assert int(spark.conf.get(conf)) <= 1024
    finally:
        spark.conf.set(conf, before)
    assert got == {i: str(len(f"<review>text {i % 4500}</review>")) for i in range(5000)}
