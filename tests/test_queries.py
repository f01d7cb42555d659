"""Each query beside its DuckDB check. VERILENS_ALL=1 runs every one of them."""

import os

import pytest
from check import compare, duck

from verilens.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
USUAL = """unit_vectors cosine_trials eer_by_label det_curve mixing_metrics csbg_lexical transition_counts llr_scores lexicon_prefix_join
gold_score fusion_decision attack_cells fit_policy operating_point cluster_bootstrap integrity_audit session_split budget_prefix
stratified_split exact_dups throttle_wait challenge_consume curvature_spikes level_steps answer_match phrase_match fuzzy_vocab_pairs
wer scores_trimmed triples poc_protocol operating_points enrollee_eval reported_interval
erase_subjects protocol_hash fact_state fact_completeness mean_duration""".split()


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("VERILENS_ALL") else USUAL)
def test_query_matches_sql(spark, name):
    status, _ = compare(spark, duck(SF), name, SF)
    assert status in ("ok", "rows"), status


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
