"""Sentence counts, labels nobody listed, large CSV files, and the entry's guard."""

import importlib
import sys

import pytest

from rootcause.operators import classify as C
from rootcause.operators import insight as IN
from rootcause.sources import reviews as RV
from rootcause.themes import ACTION_OWNERS, ACTIONS_HEADING, INSIGHT_HEADING

SENTENCES = {
    "Slippage is 14 bps vs. 3 bps outside. Act now.": 2,
    "Latency rose to 12.5 ms. Route orders elsewhere": 2,
    "One. Two! Three?": 3,
    "It costs approx. 3 days, e.g. Mondays. 40 users left.": 2,
    'They say "it fails." Nobody knows why.': 2,
    "v2.1 is slow": 1,
    "**Bold.** Next one.": 2,
    "": 0,
}


def test_sentences_are_counted_by_their_ends(spark):
    bullets = "\n".join(f"- **{o}**: do it." for o in ACTION_OWNERS)
    df = spark.createDataFrame([(s, f"{INSIGHT_HEADING}\n{s}\n\n{ACTIONS_HEADING}\n{bullets}") for s in SENTENCES], "complaint_theme string, summary string")
    got = {r["complaint_theme"]: (r["sentence_count"], r["ok"]) for r in IN.summary_contract(df).collect()}
    assert got == {s: (n, n == 2) for s, n in SENTENCES.items()}


def test_labels_that_nobody_listed_are_one_category(spark):
    df = spark.createDataFrame([("LEDGER_DISPUTE",), ("whatever",), ("anything else",), (None,), ("LEDGER_DISPUTE",), ("x",)], f"{C.CATEGORY_COL} string")
    got = [tuple(r) for r in C.category_distribution(df, known=C.THEMES).collect()]
    assert got == [(C.UNLISTED, 3), ("LEDGER_DISPUTE", 2)]
    assert C.category_distribution(df).count() == 4


def test_large_csv_files_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("u", 1, None, "a text\nof two lines" * 50)], RV.REVIEW_SCHEMA)
    RV.write_reviews(rows, f"file://{tmp_path}/csv")
    assert RV.read_reviews(spark, f"file://{tmp_path}/csv").count() == 1
    for path in (f"file://{tmp_path}/csv", f"file://{tmp_path}/c*"):
        with pytest.raises(ValueError, match="one task"):
            RV.read_reviews(spark, path, max_file_bytes=100)
    assert RV.largest_file(spark, f"file://{tmp_path}/csv")[0] > 100


def test_a_broken_import_is_no_missing_subpackage(monkeypatch):
    import __spark_entry__ as E
    monkeypatch.setitem(sys.modules, "rootcause.llm", None)  # as if the folder were not there
    monkeypatch.delitem(sys.modules, "rootcause.llm.queries", raising=False)
    try:
        importlib.import_module("rootcause.llm.queries")
    except ModuleNotFoundError as e:
        assert e.name in ("rootcause.llm", "rootcause.llm.queries")
    assert "triage_report" in E.queries() and not any(n.startswith("op") for n in E.queries())

    class Broken:
        def find_spec(self, name, path=None, target=None):
            if name == "rootcause.llm.queries":
                raise ModuleNotFoundError("No module named 'xyz'", name="xyz")

    monkeypatch.undo()
    if importlib.util.find_spec("rootcause.llm"):
        monkeypatch.delitem(sys.modules, "rootcause.llm.queries", raising=False)
        monkeypatch.setattr(sys, "meta_path", [Broken(), *sys.meta_path])
        with pytest.raises(ModuleNotFoundError):
            E.queries()
