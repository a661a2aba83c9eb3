"""Registered queries against their SQL on the smallest tables; TESSERA_ALL=1 runs every one."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tessera.queries import QUERIES

from .oracle import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
QUICK = """restrict_any semijoin natural_join update_rows delete_cascade assert_disjoint_cover merge_keys alias_conflicts quality_flag
quadrant_category normalize_soft anatomical_position hex_grid explode_zip sampling_step detrend_poly smooth_fir downsample_blocks blocked_kfold
lag_matrix significant_intervals asof_setting nearest_sample segments_near_cells label_iou strided_kernel repeat_quality median_member
histogram kruskal_wallis mann_whitney order_by_similarity band_power_index line_threshold resize_nearest center_surround_masks hull_area
density_map length_per_cell spike_triggered_average rf_moments projection_variance cluster_mean preferred_file read_ini preprocess length_split count_split distance_split with_without_mix random_sides seeds_per_key random_rows dedupe_nodes region_irregularity stream_interval_join distance_to_root path_lengths export_datasets
augment_flips accuracy_table stream_block_mean stream_triggers register_table table_function""".split()
NAMES = sorted(n for n in oracle_sql() if n in QUERIES) if os.environ.get("TESSERA_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    assert spark_rows(queries()[name](spark, SF)) == sql_rows(duck, oracle_sql()[name])


# Queries whose plans scan, number, rank or take percentiles; TESSERA_ALL=1 runs every query this way.
SCANS = """detect_triggers snippet_join kruskal_wallis quality_total clip_low_percentile subtract_baseline find_peaks asof_setting nearest_sample
resample_linear order_by_similarity distance_to_root length_split count_split with_without_mix detrend_poly significant_intervals""".split()


@pytest.mark.parametrize("name", NAMES if os.environ.get("TESSERA_ALL") else SCANS)
def test_blocks_give_the_same_answer(spark, duck, name):
    spark.conf.set("tessera.task.rows", "40")
    try:
        assert spark_rows(queries()[name](spark, SF)) == sql_rows(duck, oracle_sql()[name])
    finally:
        spark.conf.unset("tessera.task.rows")


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
