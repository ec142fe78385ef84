"""Queries against their DuckDB twins.  Set PAGELOOM_ALL_QUERIES=1 to run every one."""

import os

import pytest

from pageloom.plans import ORACLES, QUERIES
from tests.compare import compare
from tests.conftest import SMALL

SAMPLE = ["a08_page_outcome", "j03_overlap_join", "j06_layout_tree", "j14_delta", "j16_merge3", "p20_text_work_request", "a02_window_stats",
          "a10_union_area", "a12_page_version", "a14_uniformity", "w05_sync_pending", "w09_page_context", "w12_split_gutters", "t04_review_tiles",
          "x02_preserved_conflicts", "m01_rasterise", "m16_mask_change", "f29_point_in_polygon", "s03_validate_members", "k09_lease_sessions"]
NAMES = sorted(ORACLES) if os.environ.get("PAGELOOM_ALL_QUERIES") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, duck, name):
    text, ok = compare(spark, duck, name, QUERIES[name], ORACLES[name], SMALL)
    assert ok or text.startswith("ok rows=0"), text


def test_entry_contract(spark):
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
