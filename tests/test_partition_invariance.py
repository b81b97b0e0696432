"""Registered queries give identical results whether their source tables
arrive as 1 partition or as 7 (order-dependent results would differ)."""

import weakref

import pytest

import __spark_entry__ as E
from rootcause.sources import adapters as A
from tests.conftest import SF_SMALL, rows

QUERIES = ["diagnose_all_themes", "diagnose_ledger_dispute", "curated_sample", "score_batches",
           "ledger_replay", "ledger_final_state", "split_kyc_cohort", "sample_cohorts",
           "draws_with_replacement", "session_surrogate_ids", "extract_labels", "metrics_text",
           "worst_rows", "triage_report", "constraint_violations", "telemetry_invariants",
           "diagnose_general_inquiry", "diagnose_kyc_onboarding_efficiency", "executive_summaries", "union_score_batches",
           "head_reviews", "tail_reviews"]


def _run(spark, monkeypatch, name, n):
    original = A.read_sources

    def read(spark_, sf_dir, names=A.SOURCE_TABLES, spread=False):
        return {k: v.repartition(n) for k, v in original(spark_, sf_dir, names, False).items()}

    monkeypatch.setattr(A, "read_sources", read)
    monkeypatch.setattr(A, "_VIEWS", weakref.WeakKeyDictionary())
    return rows(E.queries()[name](spark, SF_SMALL))


@pytest.mark.parametrize("name", QUERIES)
def test_same_result_for_1_and_7_partitions(spark, monkeypatch, name):
    assert _run(spark, monkeypatch, name, 1) == _run(spark, monkeypatch, name, 7)
