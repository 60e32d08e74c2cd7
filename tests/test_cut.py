"""Reports on candidates under the limits of production: no plan joins all pairs that share a token."""

import importlib

import pytest

CUT = [
    "absent_rate_whole",
    "assemble_matches_whole",
    "best_probability_whole",
    "best_threshold_whole",
    "block_cand_dist_whole",
    "block_recall_whole",
    "block_reduction_whole",
    "err_confusion_whole",
    "err_feature_means_whole",
    "err_fn_split_whole",
    "err_fp_by_source_whole",
    "err_rank_buckets_whole",
    "pair_labels_whole",
    "pair_numeric_whole",
    "decide_bijective_whole",
    "decide_threshold_whole",
    "err_entity_ok_whole",
    "block_coverage_whole",
    "pair_list_lengths_whole",
]


@pytest.mark.parametrize("name", CUT)
def test_pairs_are_cut_in_the_task(spark, small, name):
    plan = importlib.import_module("__spark_entry__").queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sum((v" not in plan
