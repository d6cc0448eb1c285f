"""Registered queries against their check queries on the smallest tables.

A sample over all families by default; TALLYWORKS_ALL=1 runs every query.
"""

import os

import oracle
import pytest

from tallyworks.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "agg_01_outlet_features", "agg_04_brand_rollup", "agg_28_column_profile", "agg_31_state_rollup", "agg_41_state_dashboard",
    "agg_55_rule_packs", "dat_01_parse_dates", "flt_14_range_slice", "geo_03_point_in_polygon", "geo_04_largest_overlap",
    "grf_02_edge_explorer", "jn_12_exact_duplicates", "jn_13_near_duplicates", "jn_20_officer_assignment", "jsn_01_parse_extractions",
    "rul_01_opportunity_score", "rul_02_relevance", "rul_09_verification_report", "rul_10_building_scrutiny", "rul_15_bid_evaluation",
    "rul_17_draft_validation", "rul_19_url_policy", "set_01_merge_feeds", "set_05_action_union", "snk_06_keyed_upsert",
    "snk_12_state_changes", "str_10_canonical_url", "ts_06_errors", "ts_08_forward_forecast", "txt_05_repeated_trigrams",
    "txt_08_records", "vec_03_group_match_all", "win_11_upper_peer_median", "win_14_page_windows",
)
NAMES = list(QUERIES) if os.environ.get("TALLYWORKS_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        msg = oracle.compare(df, con, ORACLES[name])
        assert msg in ("", "both empty"), msg
    else:
        assert df.count() > 0


def test_names_and_columns():
    assert not set(ORACLES) - set(QUERIES)
    assert len(QUERIES) > 270
